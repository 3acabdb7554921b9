import random

from pyspark.sql import functions as F

from factsieve.operators import intervals, issues, spans, usage
from factsieve.session import scratch
from factsieve.streaming import jobs


def log(spark, n=400, seed=1):
    rng = random.Random(seed)
    ms, rows = 1_700_000_000_000, []
    for i in range(n):
        ms += rng.choice([0, 500, 4_000, 9_000, 59_999, 60_000])
        rows.append((i, rng.choice("ab") if i % 3 else "hot", ms, rng.choice([1, 1, 2])))
    return rows, spark.createDataFrame(rows, "event_id bigint, ip string, ms bigint, cost int")


def expected(rows):
    kept, out = {}, {}
    for eid, ip, ms, cost in rows:
        recent = [t for t in kept.get(ip, []) if ms - t < 60_000]
        ok = len(recent) + cost <= 5
        kept[ip] = recent + [ms] * cost if ok else recent
        out[eid] = ok
    return out


def test_admission_batch_and_stream(spark):
    rows, df = log(spark)
    want = expected(rows)
    got = {r.event_id: r.admitted for r in usage.admit_batch(df, slice_ms=30_000).collect()}
    assert got == want
    src, out, ck = (scratch(spark, n) for n in ("src", "out", "ck"))
    df.coalesce(1).write.parquet(src)
    hits = spark.readStream.schema(df.schema).parquet(src)
    q = jobs.admit_stream(hits).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert {r.event_id: r.admitted for r in spark.read.parquet(out).collect()} == want


def test_merge_intervals_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(str(i % 3), s, s + rng.randint(1, 40)) for i in range(300) for s in [rng.randint(0, 3000)]]
    got = sorted(tuple(r) for r in intervals.merge_intervals(spark.createDataFrame(rows, "k string, start int, end int"), ["k"], block=50).collect())
    want = []
    for k in "012":
        out = []
        for s, e in sorted((s, e) for kk, s, e in rows if kk == k):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        want += [(k, s, e) for s, e in out]
    assert got == sorted(want)


def test_edits_keep_track_of_uncertain_words(spark):
    text = "임금: 월 280만원. 매월 2O일 지급\n주소: 상도로 77"
    docs = spark.createDataFrame([(d, text) for d in "abc"], "doc_id string, text string")
    words = docs.select("doc_id", F.explode(F.array(F.lit("2O"), F.lit("77"))).alias("word"))
    seeds = spans.locate_uncertain(docs, words).withColumn("span_id", F.col("start").cast("bigint"))
    after = {"a": text.replace("280만원", "2,800,000원"), "b": text.replace("2O일", "20일"), "c": "새 글 " * 40 + "2O"}
    edits = spark.createDataFrame([(d, 1, text, t, None) for d, t in after.items()], "doc_id string, rev bigint, before string, after string, confirm_id bigint")
    done = spans.apply_edits(seeds, edits)
    summary = {r.doc_id: (r.pending, r.edited) for r in spans.span_summary(done).collect()}
    assert summary["a"] == (2, 0) and summary["b"] == (1, 1) and summary["c"][1] == 0
    now = spark.createDataFrame(list(after.items()), "doc_id string, text string")
    ranges = {}
    for r in spans.pending_ranges(done, now).collect():
        ranges.setdefault(r.doc_id, []).append(after[r.doc_id][r.start : r.end])
    assert sorted(ranges["a"]) == ["2O", "77"] and ranges["b"] == ["77"] and ranges["c"] == [after["c"]]


def test_supplements_go_to_their_places(spark):
    text = "1쪽\n\n2쪽 15일"
    docs = spark.createDataFrame([("d", text, [(text.index("15"), len(text))])], "doc_id string, text string, low_confidence array<struct<start:int,end:int>>")
    suspect = spark.createDataFrame([("d", 1, "partial", 2)], "doc_id string, page_no int, reason string, anchor int")
    failed = spark.createDataFrame([], "doc_id string, page_no int, code string, anchor int, previewed boolean")
    ev = spark.createDataFrame([("d", "suspect-1", 1, None, "휴게"), ("d", "suspect-1", 2, "supplemented", None), ("d", "suspect-9", 3, "supplemented", None)],
                               "doc_id string, issue_id string, event_no int, resolution string, supplement string")
    settled, rejected = issues.resolve_issues(issues.build_issues(failed, suspect, "pdf"), ev)
    assert [r.code for r in rejected.collect()] == ["unknown_issue"]
    out = issues.assemble_text(docs, settled).first()
    assert out.text == "1쪽\n\n휴게\n\n2쪽 15일"
    assert out.text[out.low_confidence[0].start : out.low_confidence[0].end] == "15일"


def test_supplements_at_both_ends_together_and_beside_white_space(spark):
    docs = spark.createDataFrame([("d", "ab\ncd", [(3, 5), (0, 1)]), ("e", "same", [(0, 2)]), ("f", "", []), ("g", "x\n\ny", None)],
                                 "doc_id string, text string, low_confidence array<struct<start:int,end:int>>")
    rows = [("d", 1, 0, " A "), ("d", 2, 3, "B"), ("d", 3, 3, "C"), ("d", 4, None, "Z"), ("e", 1, 0, "  "), ("f", 1, 9, "F"), ("g", 1, 1, "G"), ("g", 2, 3, "H")]
    marks = spark.createDataFrame([(d, p, a, "supplemented", s) for d, p, a, s in rows], "doc_id string, position int, anchor int, resolution string, supplement string")
    out = {r.doc_id: r for r in issues.assemble_text(docs, marks).collect()}
    assert out["d"].text == "A\n\nab\n\nB\n\nC\n\ncd\n\nZ"
    assert [out["d"].text[r.start : r.end] for r in out["d"].low_confidence] == ["cd", "a"]
    assert (out["e"].text, out["f"].text, out["g"].text) == ("same", "F", "x\n\nG\n\nH\n\ny") and out["g"].low_confidence is None


def test_documents_stream_matches_batch(spark):
    from factsieve.operators import facets, relate

    rows = [("d1", "r1", 1, "offer", "연봉 3,600만원"), ("d2", "r1", 2, "contract", "연봉 3,200만원"), ("d3", "r2", 3, "offer", "주 40시간")]
    docs = spark.createDataFrame(rows, "doc_id string, record_id string, seq bigint, doc_type string, text string")
    src, out, ck = (scratch(spark, n) for n in ("src", "out", "ck"))
    for d in ("d1", "d2", "d3"):
        docs.filter(F.col("doc_id") == d).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.documents_stream(stream, out, ck).awaitTermination()
    pick = lambda df: sorted((r.record_id, r.facet_id, r.relation or "") for r in df.collect())
    batch = relate.facet_relations(facets.facet_values(jobs.analyse(docs), "record_id", "doc_id", "seq", "doc_type"))
    assert pick(jobs.current_relations(spark, out)) == pick(batch)
    assert ("r1", "01-a", "different_stated") in pick(batch)
