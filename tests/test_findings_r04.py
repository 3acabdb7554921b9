"""Findings of round 4, each on a small case that failed before."""

import itertools
import random

import duckdb
from pyspark.sql import functions as F

from checks.queries import ORACLE, QUERIES
from factsieve import plans
from factsieve.operators import facets, intervals, relate, status
from factsieve.packs import rule_pack
from factsieve.sources.derived import notices


def sql_rows(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(map(repr, con.execute(ORACLE[name]).fetchall()))


def test_documents_without_text_are_counted(spark, tmp_path):
    rows = [(1, "write to a@b.example.com with care"), (2, ""), (3, " \n\t "), (4, None), (5, " 　")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["topic_counts_en"](spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sql_rows("topic_counts_en", documents=f"{tmp_path}/documents.parquet")
    assert {r.topic_id: r.documents for r in got if r.status == "MAIN_MISSING"}["01"] == 4


def orders(spark, path, n=400):
    o = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 37).alias("o_custkey"),
                              F.timestamp_seconds(F.lit(800_000_000) + F.col("id") * 86400).alias("o_orderdate"))
    o.coalesce(1).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_compared_documents_are_not_gathered_in_the_driver(spark, tmp_path):
    sf = orders(spark, tmp_path)
    for name in ("facet_compare_ko", "compare_questions_ko", "highlights_ko", "item_state_counts_ko"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


ODD = [
    None, "", " \n ", "기타 사항은 별도 안내", "주휴일: 매주 일요일(유급)\n휴일 없음\n토·일 휴무", "토·일 휴무", "휴무\n주 5일 근무, 휴무", "수습 없음\n수습 중 급여 90%", "수습 없음\n수습 3개월",
    "수습 2개월\n수습 중 급여는 지급하지 않음, 미지급", "연차 없음\n연차 15일 부여", "연차는 법령에 따름\n연차 유급휴가: 1개월 개근 시 1일", "연차는 내규에 따라 부여",
    "기간의 정함이 없는 근로계약\n계약기간: 12개월", "계약기간은 추후 안내\n계약기간 6개월", "단시간 근로, 계약기간 3개월", "계약 형태: 기간을\n계약 기간: 정한 1년", "급여 250만원", "급여 250만원\n월급", "급여 협의\r\n시급  10,000 원\t\n연봉",
    "근무시간은 09:00~18:00\n소정근로시간 주 40시간", "휴게시간 없음\n휴게 60분", "기타 급여는 추후 안내\n나머지 수당은 별도 공지", "기타 계약 종료는 추후 안내\n기타　수당 별도 공지",
    "긴 줄. " * 40 + "급여 300만원, 세전. " * 20 + " • 연차 15일 부여",
]


def same(a, b, *columns):
    """No row of either side is missing or differs in one of the columns."""
    both = a.select("doc_id", *columns).join(b.select("doc_id", *[F.col(c).alias(f"{c}_2") for c in columns]), "doc_id", "full")
    return both.agg(F.count("*"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"{c}_2"))) for c in columns]).first()


def documents(spark, path):
    """Notices, and odd texts alone and in pairs."""
    texts = ODD + [f"{a}\n{b}" for a in ODD[3:] for b in ODD[3:]]
    odd = spark.createDataFrame(
        [(f"odd{i}", f"r{i % 7}", i, ("job_posting", "offer", "contract")[i % 3], t) for i, t in enumerate(texts)], "doc_id string, record_id string, seq long, doc_type string, text string")
    return notices(spark.read.parquet(f"{orders(spark, path)}/orders.parquet")).select(odd.columns).unionByName(odd)


def test_states_of_rule_claims_equal_the_general_rules(spark, tmp_path):
    docs = documents(spark, tmp_path)
    for pack in ("employment_ko", "signals_en"):
        n, *differ = same(plans.judge_corpus(docs, pack), plans.analyse_corpus(docs, pack), "criteria", "topics")
        assert n == docs.count() and differ == [0, 0]


def test_marked_ranges_merge_per_line(spark):
    quote = lambda n, t: (n, t)
    lines = [(1, "abcdefgh", 0, 8), (2, "abcd", 9, 13), (3, "xy", 14, 16)]
    evidence = [[quote(1, "abc")], [quote(1, "bcd"), quote(2, "cd")], [quote(1, "gh"), quote(2, "zz"), quote(9, "a")], [quote(1, "ef")]]
    df = spark.createDataFrame(
        [("d", lines, [(e,) for e in evidence])], "doc_id string, lines array<struct<line_no:int,text:string,start:int,end:int>>, criteria array<struct<evidence:array<struct<line:int,text:string>>>>")
    assert sorted(tuple(r) for r in status.highlight_ranges(df).collect()) == [("d", 1, 0, 8), ("d", 2, 0, 4)]


VALUES = [
    "급여: 월급 3천 500만원, 세전", "연봉 1억 2천만원\n시급", "급여 3,600만원~4,000만원", "연봉 0원", "월급 250.5만원 세후", "급여 1.5천원 월급 2백원", "급여 999999999999999999999원 월급", "연봉 3 4 만원",
    "소정근로시간: 주 37.5시간", "주 40시간, 1일 8시간", "1일 8시간\n소정근로시간: 하루 0.0005시간", "주 12345678.25시간", "근무시간 9시 ~ 18시, 휴게 12:00~13:00", "출퇴근: 9:00~18:00, 10:00-19:00", "휴게 1.5시간", "휴게 18:00~09:00", "휴게시간 30분 60분",
    "지급일: 매월 25일 지급", "지급일 말일, 매월 10일", "매월 05일", "근무지: 서울특별시 마포구 1로", "근무 장소: 경기도 성남시 (판교)", "근무지: -", "담당업무: QA Test/개발", "고용형태: 정규직, 인턴", "고용형태 파트 타임",
    "계약기간: 2026년 1월 5일부터 2027.12.31까지", "계약기간: 1년 12개월", "계약기간: 6개월 2년", "계약기간 2026-01-01", "계약기간: 99999999999999999999개월", "수습기간 3개월", "수습 2주\n수습 3개월 적용", "수습 중 급여 90%", "수습 중 급여 92.5% 또는 200만원\n수습 3개월",
    "수습기간 3개월\n수습 중 급여 200만원", "수습 3개월\n수습 급여 80.0% 동일", "주휴일: 매주 일요일(유급)", "연차 15일 부여 — ‘유급’",
]


def test_facets_of_rule_claims_equal_the_general_rules(spark, tmp_path):
    pack = rule_pack("employment_ko")
    odd = spark.createDataFrame([(f"value{i}", f"v{i % 5}", i, "offer", t) for i, t in enumerate(VALUES + [f"{a}\n{b}" for a, b in zip(VALUES, VALUES[1:])])],
                                "doc_id string, record_id string, seq long, doc_type string, text string")
    docs = documents(spark, tmp_path).unionByName(odd)
    n, *differ = same(plans.judge_corpus(docs), facets.with_facets(plans.analyse_corpus(docs), pack), "facets")
    assert n == docs.count() and differ == [0]
    told = {(f.facet_id, f.val) for r in plans.judge_corpus(odd).collect() for f in r.facets if f.comparable}
    assert {("01-a", "35000000"), ("02-a", "37.5"), ("02-b", "09:00~18:00,10:00~19:00"), ("06-b", "2026-01-05~2027-12-31"), ("08-a", "2000000")} <= told
    plain = plans.judge_corpus(docs, quotes=False).select(F.explode("facets").alias("f"))
    assert plain.filter(F.size("f.evidence") > 0).count() == 0


def test_readings_are_counted_in_three_steps(spark):
    rows = [("r", f"d{i}", i, "contract", "01-a", "01", 0, "present", "concrete", True, "month", str(i % 2), ("pre", "post", None)[i % 3]) for i in range(7)]
    df = spark.createDataFrame(rows, "record_id string, doc_id string, seq long, doc_type string, facet_id string, item_id string, facet_no int, presence string, side string, "
                                     "comparable boolean, grp string, val string, tax string")
    told = relate.facet_relations(df)
    r = told.first()
    agree = lambda a, b: {a[12], b[12]} != {"pre", "post"}
    pairs = list(itertools.combinations(rows, 2))
    assert r.same_pairs == sum(a[11] == b[11] and agree(a, b) for a, b in pairs)
    assert r.changed_pairs == sum(a[11] != b[11] and agree(a, b) for a, b in pairs)
    assert r.incomparable_pairs == sum(not agree(a, b) for a, b in pairs)
    assert told._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") <= 6


def test_uncertain_ranges_of_rule_claims_equal_the_general_rules(spark, tmp_path):
    at = F.position(F.lit("만원"), F.col("text"))
    n = F.length("text")
    place = F.pmod(F.hash("doc_id"), F.greatest(n, F.lit(1)))
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    ranges = (F.when(F.col("seq") % 6 == 0, F.array(span(at - 4, at - 2)))
              .when(F.col("seq") % 6 == 1, F.array(span(place, place + 3), span(place + 9, place + 40)))
              .when(F.col("seq") % 6 == 2, F.array(span(place, place), span(F.lit(None), place), span(F.lit(0), F.lit(5000))))
              .when(F.col("seq") % 6 == 3, F.array().cast("array<struct<start:int,end:int>>"))
              .when(F.col("seq") % 6 == 4, F.array(span(place + 1, place + 2))))
    read = documents(spark, tmp_path).withColumn("text", F.when(F.col("seq") % 4 == 0, F.replace("text", F.lit("0"), F.lit("O"))).otherwise(F.col("text")))
    docs = read.withColumn("low_confidence", ranges)
    fast, general = plans.judge_corpus(docs, ranges="low_confidence"), plans.analyse_corpus(docs, ranges="low_confidence")
    n, *differ = same(fast, general, "criteria", "topics")
    assert n == docs.count() and differ == [0, 0]
    seen = {c.reason for r in fast.select("criteria").collect() for c in r.criteria}
    assert {"ocr_low_confidence", "ocr_low_confidence_related"} <= seen


def test_few_ranges_merge_like_any(spark):
    rng = random.Random(5)
    rows = [(k, float(a), float(a + rng.randint(0, 30))) for k in "ab" for a in (rng.randint(0, 900) for _ in range(120))]
    df = spark.createDataFrame(rows + rows[:50], "k string, start double, end double")
    for gap, touching in ((0, True), (3.0, False), (F.lit(2.5), True)):
        few = intervals.merge_few(df, ["k"], gap=gap, touching=touching)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, intervals.merge_intervals(df, ["k"], block=64, gap=gap, touching=touching).collect()))


def test_words_of_a_page_are_read_a_few_times(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "one two\nthree  four"), (1, 1, "user", "a\n\nb c"), (2, 0, "user", "a b")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        f"{tmp_path}/conversations.parquet")
    df = QUERIES["assemble_lines"](spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in df.collect()) == sql_rows("assemble_lines", conversations=f"{tmp_path}/conversations.parquet")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 8


def test_what_a_side_shows_is_worked_out_once(spark, tmp_path):
    """The plan grew with every place where a sentence shows a side."""
    df = QUERIES["compare_questions_ko"](spark, orders(spark, tmp_path, 60))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert df.count() > 0 and plan.count("regexp_replace") <= 20
