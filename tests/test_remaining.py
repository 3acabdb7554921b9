from pyspark.sql import functions as F

from factsieve.operators import ocr, quality
from factsieve.session import scratch
from factsieve.sources.sinks import audit_buckets, report_tables, write_buckets, write_results


def test_quality(spark):
    pages = spark.createDataFrame(
        [("p", ["급여 300만원", "근무지 서울"], [("급여", "300만원"), ("근무지", "부산")], ["급여", "근무지"], "급여 300만원\n근무지 서욜")],
        "id string, truth array<string>, pairs array<struct<k:string,v:string>>, items array<string>, text string")
    s = quality.image_scores(pages).first()
    assert (s.lines_ok, s.pairs_ok, s.nums_ok, s.items_ok) == (1, 1, 1, 2)
    sets = spark.createDataFrame([("x", ["첫 줄", "끝 줄"], "첫 줄\n끝 줄"), ("y", ["끝 줄", "첫 말"], "첫 말\n끝 줄")], "set_name string, marks array<string>, text string")
    assert {r.set_name: r.ordered for r in quality.order_kept(sets).collect()} == {"x": True, "y": False}
    a = spark.createDataFrame([("s", 0.5)], "k string, v double")
    b = spark.createDataFrame([("s", 0.75), ("t", 1.0)], "k string, v double")
    assert {r.k: r.v_change for r in quality.before_after(a, b, ["k"], ["v"]).collect()} == {"s": 0.25, "t": None}
    runs = spark.createDataFrame([("image", 0.89), ("photo", 0.89)], "kind string, char_acc double")
    assert [r.kind for r in quality.threshold_check(runs).collect()] == ["image"]


def test_results_are_read_back(spark):
    df = spark.range(500).withColumn("t", F.concat(F.lit("x"), F.col("id")))
    audit = write_results(df, scratch(spark, "res"), "id", 8).collect()
    assert sum(r.rows for r in audit) == 500 and all(r.ok for r in audit)
    report_tables(df, scratch(spark, "rep"))


def test_lost_and_changed_buckets_are_noticed(spark):
    df = spark.range(400).selectExpr("CASE WHEN id < 390 THEN id END AS id", "concat('x', id % 7) AS t", "cast(id AS double) / 3 AS v")
    path = scratch(spark, "res")
    counts = write_buckets(df, path, "id", 8).cache()
    assert all(r.ok and r.rows == r.rows_read for r in audit_buckets(counts, path, df).collect()) and counts.agg(F.sum("rows")).first()[0] == 400
    written = spark.read.parquet(path)
    lost = counts.first().bucket
    for part, broken in ((written.filter(F.col("bucket") != lost), {lost}), (written.unionByName(written.filter(F.col("bucket") == lost)), {lost}),
                         (written.withColumn("v", F.when(F.col("bucket") == lost, F.col("v") + 1).otherwise(F.col("v"))), {lost}),
                         (written.withColumn("bucket", F.when(F.col("bucket") == lost, 99).otherwise(F.col("bucket"))), {lost, 99})):
        other = scratch(spark, "res")
        part.write.partitionBy("bucket").parquet(other)
        audit = audit_buckets(counts, other, df).collect()
        assert {r.bucket for r in audit if not r.ok} == broken
    empty = scratch(spark, "res")
    assert write_results(df.limit(0), empty, "id", 4).count() == 0


def words(spark, rows):
    return spark.createDataFrame([("p", i, l, t, float(c), 0.0, 0.0, 1.0, 1.0, True) for i, (l, t, c) in enumerate(rows)],
                                 "page_id string, word_no int, line_id int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, space boolean")


def test_ocr_words(spark):
    w = words(spark, [(1, "근무지", 90), (1, "|", 20), (1, "서울", 90), (2, "B", 10), (3, "(", 90), (3, "5일", 40)])
    assert {r.line_id: r.text for r in ocr.drop_noise(w).collect()} == {1: "근무지 서울", 3: "( 5일"}
    lines = spark.createDataFrame([("p", 1, "근무지 | 서울")], "page_id string, line_id int, line_text string")
    at = {r.word_no: (r.at, r.space) for r in ocr.word_offsets(w.filter("line_id = 1"), lines).collect()}
    assert at == {0: (0, False), 1: (4, True), 2: (6, True)}
    readings = spark.createDataFrame([("a", 0, "가나", 50.0), ("a", 1, "가다", 60.0), ("a", 2, "가나다라마바사", 99.0), ("b", 0, "x", 80.0), ("b", 1, "y", 85.0)],
                                     "k string, attempt int, text string, score double")
    assert {r.k: r.text for r in ocr.best_reading(readings, ["k"]).collect()} == {"a": "가다", "b": "x"}


def test_icon_and_two_line_value(spark):
    box = [("B", 20, 40, 60, 82, 75, 9), ("수습기간", 100, 50, 170, 72, 93, 1), ("중", 180, 50, 200, 72, 93, 1), ("급여", 210, 50, 260, 72, 93, 1),
           ("월", 400, 20, 420, 50, 93, 2), ("300만원", 430, 20, 540, 50, 93, 2), ("(세전)", 550, 20, 640, 50, 93, 2),
           ("(수습기간", 400, 70, 520, 95, 93, 3), ("3개월)", 530, 70, 600, 95, 93, 3)]
    w = spark.createDataFrame([("p", i, l, t, float(c), float(a), float(b), float(x), float(y), True) for i, (t, a, b, x, y, c, l) in enumerate(box)],
                              "page_id string, word_no int, line_id int, text string, confidence double, x0 double, y0 double, x1 double, y1 double, space boolean")
    th = spark.createDataFrame([("p", 40.0)], "page_id string, th double")
    layout = ocr.page_layout(ocr.column_cells(w, ocr.row_bands(w, th)))
    lines = ocr.assemble_lines(ocr.place_words(w, layout)).orderBy("row", "grp", "sub").collect()
    assert [r.text for r in lines] == ["수습기간 중 급여 월 300만원 (세전)", "(수습기간 3개월)"]
