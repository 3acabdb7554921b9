"""Findings of round 3, each on a small case that failed before."""

from pyspark.sql import functions as F

from factsieve import plans
from factsieve.operators import facets, segment, verify
from factsieve.packs import rule_pack

PACK = rule_pack("employment_ko")
TEXT = "임금: 세전 연봉 3,600만원\n소정근로시간: 주 40시간\n출퇴근: 09:00~18:00\n계약기간 6개월\n수습기간 3개월\n수습 중 급여 90%"


def docs(spark):
    return spark.createDataFrame([("a", TEXT)], "doc_id string, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_audit_needs_one_analysis_and_no_join(spark):
    """F1"""
    rows = plans.analyse_corpus(docs(spark))
    audit = verify.misquoted(rows)
    assert audit.count() == 0 and "Join" not in plan(audit) and plan(audit).count("LogicalRDD") == plan(rows).count("LogicalRDD")
    moved = rows.withColumn("lines", F.transform("lines", lambda l: l.withField("text", F.reverse(l["text"]))))
    quotes = sum(len(c.evidence) for c in rows.first().criteria)
    assert quotes > 5 and verify.misquoted(moved).count() == quotes
    assert verify.misquoted(rows.withColumn("lines", F.slice("lines", 1, 2))).filter("line <= 2").count() == 0


def test_readings_are_worked_out_once(spark):
    """The wage amount is read once per facet that shows one (pay and probation pay)."""
    from factsieve.functions import values

    rows = facets.with_facets(plans.analyse_corpus(docs(spark)), PACK)
    assert plan(rows.select("facets")).count(values._AMOUNT) <= 2
    got = {f.facet_id: (f.grp, f.val, f.num, f.tax) for f in rows.first().facets}
    assert got["01-a"] == ("annual", "36000000", 36e6, "pre") and got["02-a"][1:3] == ("40", 40.0)


def test_limits_are_decided_across_batches(spark):
    """rows of a slice may come in several batches; no group of its own per key and slice."""
    import random

    from factsieve.operators import usage

    rng = random.Random(5)
    log = [(i, str(rng.randint(0, 2)), rng.randint(0, 400_000), rng.randint(1, 2)) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.event_id: (r.admitted, r.retry_after_sec) for r in usage.admit_batch(
            spark.createDataFrame(log, "event_id bigint, ip string, ms bigint, cost int"), slice_ms=30_000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    times, want = {}, {}
    for i, ip, ms, cost in sorted(log, key=lambda r: (r[2], r[0])):
        times[ip], ok, wait = usage.decide(times.get(ip, []), ms, cost, usage.PER_KEY, usage.WINDOW_MS)
        want[i] = (ok, wait)
    assert got == want


def test_spans_of_many_documents_make_one_frame(spark, monkeypatch):
    """F11, F26"""
    from factsieve.operators import spans

    docs = spark.createDataFrame([(str(i), f"aaa {i} \U0001F600aa\\Eb") for i in range(40)] + [("n", None)], "doc_id string, text string").coalesce(1)
    found = docs.withColumn("at", spans.occurrences(F.col("text"), F.lit("aa")))
    assert {r.doc_id: r.at for r in found.collect()}["7"] == [0, 1, 7] and found.filter("text IS NULL").first().at == []
    seeds = spans.locate_uncertain(docs.filter("text IS NOT NULL"), docs.select("doc_id", F.lit("aa").alias("word"))).withColumn("span_id", F.col("start").cast("bigint"))
    edits = docs.selectExpr("doc_id", "1L AS rev", "text AS before", "replace(text, 'aaa', 'ba') AS after", "CAST(NULL AS BIGINT) AS confirm_id")
    after = spans.apply_edits(seeds, edits).collect()
    assert len(after) == 120 and sum(r.state == "edited" for r in after) == 80
    assert {r.start for r in after if r.doc_id == "7" and r.state == "pending"} == {6}


def test_batches_are_cut_into_steps():
    """no batch is whole in Python."""
    import pyarrow as pa

    from factsieve.functions.literals import text_steps

    texts = [None, ""] + ["가나다"] * 5 + [None, "", "x" * 100, "y"]
    steps = [*text_steps(pa.array(["zz", *texts], pa.string()).slice(1), 20)]
    assert sum(steps, []) == texts and len(steps) > 3 and max(len(s) for s in steps) < 5
    assert [*text_steps(pa.array([], pa.string()), 20)] == []


def test_equal_ranges_do_not_split_islands():
    """equal ranges may come in another order in each window of the SQL."""
    import duckdb

    from checks.queries import ORACLE

    sql = ORACLE["merge_intervals"]
    assert "DISTINCT" in sql
    con = duckdb.connect()
    con.sql("CREATE TABLE lineitem AS SELECT i % 3 AS l_orderkey, (i * 7919) % 40 * 5 AS l_partkey, 1.0 + i % 4 AS l_quantity FROM range(20000) t(i)")
    want = set()
    for k in range(3):
        ranges = sorted({((i * 7919) % 40 * 5, (i * 7919) % 40 * 5 + 1 + i % 4) for i in range(20000) if i % 3 == k})
        merged = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want |= {(k, a, b) for a, b in merged}
    assert set(con.sql(sql).fetchall()) == want


def test_blanks_are_dropped_once_a_line(spark):
    """a pair of lines is compared once and nothing is normalised per pair."""
    from factsieve.operators import quality

    rows = [(1, ["ab c", "d e"], ["x", "a b"], "a bd\n\nde f\nxy"), (2, [" "], [], ""), (3, [], ["q"], "q"), (4, ["12.5 kg", "zz"], ["z z", "zz"], "1 2.5kg\nz")]
    pages = spark.createDataFrame(rows, "id int, truth array<string>, items array<string>, text string").withColumn(
        "pairs", F.array(F.struct(F.lit("a").alias("k"), F.lit("d").alias("v"))))
    scored = quality.image_scores(pages)
    assert plan(scored).count("levenshtein(") == 2
    got = {r.id: (r.lines_ok, round(r.char_acc, 4), r.pairs_ok, r.nums_total, r.nums_ok, r.items_ok) for r in scored.collect()}
    assert got == {1: (1, 0.5, 1, 0, 0, 2), 2: (0, 1.0, 0, 0, 0, 0), 3: (0, 0.0, 0, 0, 0, 1), 4: (1, 0.875, 0, 1, 1, 0)}
    best = spark.createDataFrame([("ab", ["b a", "a  b!", "ab"]), ("q", ["xy"])], "t string, l array<string>").select(quality.best_line(F.col("t"), F.col("l")).alias("b"))
    assert [tuple(r.b) for r in best.collect()] == [(1.0, 1), (0.0, -1)]


def test_patterns_find_what_spark_finds(spark):
    """the patterns of the packs in Python's engine, white space, digits and line ends included."""
    import random

    from factsieve.functions.text import compiled, matches

    rng = random.Random(3)
    patterns = [r"월\s*\d+\s*일", r"^(?:[-•]\s*)?기타", r"수습.*(개월|%)", r"(^|[^0-9])[0-9]{2}([^0-9]|$)", r"일$"]
    parts = ["월", "일", "수습", "개월", "기타", "-", "7", "12", "٣", " ", "\xa0", "　", "\r", "\n", "\x85", " ", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(1500)] + ["일\r\n", "일\x85", "일\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[matches(F.col("t"), p) for p in patterns]).collect()
    assert [tuple(r) for r in rows] == [(t, *[bool(compiled(p).search(t)) for p in patterns]) for t in texts]


def test_claims_of_rules(spark, monkeypatch):
    """a pattern is tried once per distinct line, and the claims are those of the chain of expressions over all hits."""
    from factsieve.functions import rules
    from factsieve.operators import extract

    lines = [*TEXT.split("\n"), "기타 사항은 별도 안내", "주 5일 근무", "급여 협의", "휴일 없음", "연차는 법령에 따름", "기간의 정함이 없는 근로계약", "  수습 없음 "]
    texts = ["\n".join(lines[i % len(lines)] for i in range(k, k + 1 + k % 9)) for k in range(40)] + ["", None, "x"]
    found = segment.with_lines(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).localCheckpoint()
    chain = extract.classify_finding(extract.first_hits(extract.match_lines(found, PACK)), PACK)
    rows = extract.rule_extractor(PACK)(found)
    key = lambda df, name: sorted((r.doc_id, r[name]) for r in df.select("doc_id", name).collect())
    assert key(rows, "claims") == key(chain, "claims")
    want = [(r.doc_id, e) for r in verify.verify(rows, PACK).collect() for e in r.entries]
    got = verify.entry_rows(extract.claim_rows(found, PACK, "doc_id"), PACK, "doc_id").collect()
    assert sorted((r.doc_id, r[1:]) for r in got) == sorted((k, tuple(e)) for k, e in want) and len(got) == 32 * len(texts)

    import pyarrow as pa

    tried = []
    held = rules.rules_held
    monkeypatch.setattr(rules, "rules_held", lambda part, r: tried.extend(part) or held(part, r))
    assert sum(n for n, *_ in rules.hits(pa.array([lines] * 50, pa.list_(pa.string())), rules.line_rules(PACK))) == 50
    assert sorted(tried) == sorted(lines)


def test_lines_of_a_batch(spark):
    """rows of a whole batch are cut at once, with the lines of ``line_spans``."""
    import random

    import pyarrow as pa

    rng, marks = random.Random(6), ["a", "b.", "3.", "! ", " ", "　", "\n", "\r\n", "• ", "■x", "다.", "é", "﻿", "😀", "\x85", "\x1c"]
    texts = [None if i % 9 == 0 else "".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for i in range(300)]
    for limit in (0, 5, 20):
        want = [t if t is None else [{"line_no": i, "text": t[a:b], "start": a, "end": b} for i, (a, b) in enumerate(segment.line_spans(t, limit), 1)] for t in texts]
        assert segment.cut_lines(pa.array(["zz", *texts], pa.string()).slice(1), limit).to_pylist() == want


def test_low_confidence_evidence(spark):
    """entries as rows and entries as arrays name the same criteria."""
    from factsieve.operators import extract, status

    low = [(k, TEXT, [(k, k + 3), (2 * k, 2 * k)] if k % 4 else None) for k in range(0, 70)]
    found = segment.with_lines(spark.createDataFrame(low, "doc_id long, text string, low_confidence array<struct<start:int,end:int>>")).localCheckpoint()
    whole = status.low_conf_overlap(verify.verify(extract.rule_extractor(PACK)(found), PACK), PACK).filter("scope = 'evidence'").select("doc_id", "id")
    rows = verify.entry_rows(extract.claim_rows(found, PACK, "doc_id", "low_confidence"), PACK, "doc_id", "lines", "low_confidence")
    got = status.low_conf_evidence(rows, PACK)
    assert sorted(got.collect()) == sorted(whole.collect()) and got.count() > 50


def test_errors_of_answers_in_one_pass(spark):
    """answers are joined and checked once, with the codes of the entries as arrays."""
    import json

    from checks.queries import verify_stored_responses
    from factsieve.sources.responses import response_extractor

    def claim(cid, finding="absent", quotes=(), **more):
        return {"id": cid, "finding": finding, "quotes": list(quotes), **more}

    wage, wrong = {"line": 1, "text": TEXT.split("\n")[0]}, {"line": 2, "text": "주 50시간"}
    rest = [claim("02-c")]
    bodies = [
        {"criteria": [claim("01-a", "specific", [wage]), *rest]}, {"criteria": [claim("01-a", "specific", [wage, wrong]), *rest]},
        {"criteria": [claim("01-a", "guess", [wrong]), *rest, *rest]}, {"criteria": rest}, {"criteria": []}, {"criteria": None}, {"answer": 1}, [],
        {"criteria": [claim("01-a", "specific", [wage], source_value="9"), claim("99-z"), claim("02-c", "negated", [{"line": 9, "text": "x"}])]}]
    raw = [(i, json.dumps(b, ensure_ascii=False)) for i, b in enumerate(bodies)] + [(90, "no json {"), (91, None)]
    docs = spark.createDataFrame([(i, TEXT) for i, _ in raw] + [(92, TEXT)], "doc_id long, text string")
    rows = segment.with_lines(response_extractor(spark.createDataFrame(raw, "doc_id long, body string"))(docs)).localCheckpoint()
    expected = F.array(F.lit("01-a"), F.lit("02-c"))
    want = {(r.doc_id, r.criterion_id, r.code) for r in verify.error_rows(verify.verify(rows, PACK, expected)).filter("code <> 'malformed_response'").collect()}
    unread = rows.filter("claims is null").select("doc_id", F.coalesce("call_error", F.lit("malformed_response"))).collect()
    got = [(r.doc_id, r.criterion_id, r.code) for r in verify.answer_errors(rows, PACK, expected).collect()]
    assert len(want) > 8 and len(unread) > 3 and len(set(got)) == len(got)
    assert set(got) == want | {(k, None, code) for k, code in unread}
    assert plan(verify_stored_responses(spark, "/root/testdata/sf0.001")).count("Join") == 1


def test_round_trip_is_linear_in_the_text(spark):
    """offsets of a text of many lines are checked without going through the text again for each, moved ones are found."""
    import time

    made = segment.with_lines(spark.createDataFrame([(i, "é some words 다.\n" * n) for i, n in enumerate((20000, 40000, 3))] + [(9, None), (8, "")], "doc_id int, text string"))
    rows = made.localCheckpoint()
    stands = rows.select("doc_id", segment.lines_stand(F.col("text"), F.col("lines")).alias("ok"))
    t0 = time.time()
    assert {r.doc_id: r.ok for r in stands.collect()} == {0: True, 1: True, 2: True, 9: None, 8: True}
    assert time.time() - t0 < 10
    moved = rows.withColumn("lines", F.transform("lines", lambda l: l.withField("start", l["start"] + 1).withField("end", l["end"] + 1)))
    assert {r.ok for r in moved.filter("doc_id < 8").select(segment.lines_stand(F.col("text"), F.col("lines")).alias("ok")).collect()} == {False}
    lost = rows.withColumn("lines", F.slice("lines", 2, 99999)).filter("doc_id < 3")
    assert {r.ok for r in lost.select(segment.lines_stand(F.col("text"), F.col("lines")).alias("ok")).collect()} == {False}
