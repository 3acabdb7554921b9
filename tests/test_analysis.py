"""Case classes of the rule engine on texts written for these tests."""

import json

import pytest
from pyspark.sql import functions as F

from factsieve import plans
from factsieve.operators import followups, relate, segment, status, verify
from factsieve.packs import rule_pack
from factsieve.sources.responses import parse_extractions, response_extractor

PACK = rule_pack("employment_ko")


def body(text, specs, drop=(), extra=()):
    lines = [l.strip() for l in text.split("\n") if l.strip()]
    out = []
    for cid in PACK.criterion_ids:
        if cid in drop:
            continue
        s = specs.get(cid, {"f": "absent"})
        quotes = [q if isinstance(q, dict) else {"line": 1 + next(i for i, l in enumerate(lines) if q in l), "text": q} for q in s.get("q", [])]
        out.append({"id": cid, "finding": s["f"], "quotes": quotes, "source_value": s.get("sv"), "term_type": s.get("term"),
                    "value_kind": s.get("kind"), "calc": s.get("calc")})
    return json.dumps({"criteria": out + list(extra)})


def run(spark, cases, ranges=None):
    """cases: {id: (text, body)} -> ({id: {criterion: row}}, {id: {topic: row}}, rows)"""
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string")
    if ranges:
        docs = docs.join(spark.createDataFrame(ranges, "doc_id string, low_confidence array<struct<start:int,end:int>>"), "doc_id", "left")
    raw = spark.createDataFrame([(k, b) for k, (_, b) in cases.items()], "doc_id string, body string")
    ev = plans.analyse_corpus(docs, extractor=_drop(response_extractor(raw)), ranges="low_confidence" if ranges else None)
    rows = {r.doc_id: r for r in ev.collect()}
    return ({k: {c.criterion_id: c for c in r.criteria} for k, r in rows.items()},
            {k: {t.topic_id: t for t in r.topics} for k, r in rows.items()}, rows)


def _drop(fn):
    return lambda docs: fn(docs).drop("call_error")


WEEK = {"entries": [{"label": "월~금", "hours": 40, "segments": [{"days": 5, "start": "09:00", "end": "18:00", "break_minutes": 60}]}]}
LINE = "월~금 09:00~18:00, 휴게 12:00~13:00"


@pytest.fixture(scope="module")
def boundary(spark):
    bad_calc = {"entries": [{**WEEK["entries"][0], "hours": 35}]}
    cases = {
        "no_unit": ("급여 300만원", {"01-a": {"f": "specific", "q": ["급여 300만원"]}, "01-b": {"f": "specific", "q": ["급여 300만원"]}}),
        "calc": (LINE, {"02-a": {"f": "specific", "q": [LINE], "kind": "calculated", "calc": WEEK}}),
        "calc_wrong": (LINE, {"02-a": {"f": "specific", "q": [LINE], "kind": "calculated", "calc": bad_calc}}),
        "workday": ("근무: 주 5일 근무", {"02-a": {"f": "coarse", "q": ["주 5일 근무"]}, "09-a": {"f": "specific", "q": ["주 5일 근무"]}}),
        "rest": ("휴무일: 매주 일요일", {"09-a": {"f": "specific", "q": ["매주 일요일"]}}),
        "law": ("연차는 관계 법령에 따른다", {"10-a": {"f": "specific", "q": ["연차는 관계 법령에 따른다"]}}),
        "no_leave": ("연차 없음", {"10-a": {"f": "negated", "q": ["연차 없음"]}}),
        "no_probation": ("수습 없음", {"07-a": {"f": "negated", "q": ["수습 없음"]}}),
        "probation": ("수습 3개월\n수습 중 급여 90%", {"07-a": {"f": "specific", "q": ["수습 3개월"]}, "07-b": {"f": "specific", "q": ["수습 3개월"]},
                                                "08-a": {"f": "specific", "q": ["수습 중 급여 90%"], "sv": "90%"}}),
        "indefinite": ("기간의 정함이 없는 근로계약", {"06-a": {"f": "specific", "q": ["기간의 정함이 없는 근로계약"], "term": "indefinite"}}),
        "conflict": ("연봉 4,200만원\n연봉 3,900만원", {"01-a": {"f": "conflict", "q": ["연봉 4,200만원", "연봉 3,900만원"]}}),
        "catch_all": ("기타 조건은 별도 안내", {"03-a": {"f": "undecided", "q": ["기타 조건은 별도 안내"]}}),
        "spaces": ("연봉  4,000만원", {"01-a": {"f": "specific", "q": [{"line": 1, "text": "연봉 4,000만원"}]}}),
    }
    return run(spark, {k: (t, body(t, s)) for k, (t, s) in cases.items()})


@pytest.mark.parametrize("case,cid,want", [
    ("no_unit", "01-b", "MISSING"), ("calc", "02-a", "CONFIRMED"), ("calc_wrong", "02-a", "PARTIAL"), ("workday", "09-a", "MISSING"),
    ("rest", "09-a", "PARTIAL"), ("law", "10-a", "PARTIAL"), ("no_leave", "10-b", "NOT_APPLICABLE"), ("no_probation", "07-b", "NOT_APPLICABLE"),
    ("probation", "08-a", "CONFIRMED"), ("indefinite", "06-b", "NOT_APPLICABLE"), ("conflict", "01-a", "UNCLEAR"),
    ("catch_all", "03-a", "MISSING"), ("spaces", "01-a", "CONFIRMED")])
def test_boundaries(boundary, case, cid, want):
    assert boundary[0][case][cid].status == want


def test_topics(boundary):
    _, topics, rows = boundary
    assert topics["calc"]["02"].status == "MAIN_FOUND"
    assert topics["no_probation"]["08"].visible is False and topics["no_probation"]["08"].status is None
    assert topics["probation"]["08"].status == "MAIN_FOUND"
    assert topics["no_leave"]["10"].notes == ["neutral", "applicability"]
    assert topics["no_unit"]["07"].notes == ["probationHold"]
    assert topics["conflict"]["01"].conflicts == 1
    derived = {c.criterion_id: c for c in rows["calc"].criteria}["02-a"].derived
    assert derived[0].value == "주 40시간" and derived[0].derivation.endswith("× 5일 = 주 40시간")
    assert ("02-a", "calc_mismatch") in [tuple(d) for d in rows["calc_wrong"].diagnostics]


def test_failed_evidence_is_not_missing(spark):
    text = "연봉 4,000만원\n급여는 매월 25일 지급"
    good = {"01-a": {"f": "specific", "q": ["연봉 4,000만원"]}, "01-b": {"f": "specific", "q": ["연봉 4,000만원"]}}
    forged = {**good, "01-a": {"f": "specific", "q": [{"line": 1, "text": "연봉 5,000만원"}]}}
    extra = {**good, "01-f": {"f": "specific", "q": [{"line": 2, "text": "매월 15일 지급"}]}}
    crit, topics, rows = run(spark, {
        "forged": (text, body(text, forged)), "extra": (text, body(text, extra)), "gap": (text, body(text, good, drop=["01-g"])),
        "shape": (text, '{"x":1}')})
    assert crit["forged"]["01-a"].status == "UNAVAILABLE" and topics["forged"]["01"].status == "MAIN_UNAVAILABLE"
    assert "5,000" not in str(rows["forged"].criteria)
    assert crit["extra"]["01-f"].status == "UNAVAILABLE" and topics["extra"]["01"].status == "MAIN_FOUND"
    assert rows["gap"].held == ["01"] and topics["gap"]["02"].status == "MAIN_MISSING"
    assert all(t.status == "MAIN_UNAVAILABLE" for t in rows["shape"].topics if t.visible)


def test_second_pass(spark):
    text = "연봉 4,000만원"
    ok = {"01-a": {"f": "specific", "q": [text]}, "01-b": {"f": "specific", "q": [text]}}
    bad = {**ok, "01-a": {"f": "specific", "q": [{"line": 7, "text": text}]}}
    raw = spark.createDataFrame([("a", body(text, bad), body(text, ok)), ("b", body(text, bad), body(text, bad))], "doc_id string, one string, two string")
    docs = segment.with_lines(raw.withColumn("text", F.lit(text)))
    docs = parse_extractions(docs, "one").drop("call_error")
    docs = verify.plan_holds(verify.verify(docs, PACK), PACK)
    docs = parse_extractions(docs.drop("claims"), "two").withColumnRenamed("claims", "again")
    docs = verify.verify(docs, PACK, verify.held_criteria(PACK, F.col("held")), "again", "second_entries")
    out = {r.doc_id: {e.criterion_id: e for e in r.entries} for r in verify.merge_second_pass(docs).collect()}
    assert out["a"]["01-a"].finding == "specific" and not out["a"]["01-a"].unavailable
    assert out["b"]["01-a"].unavailable and out["b"]["01-b"].finding == "specific"
    assert not out["b"]["02-a"].unavailable


def test_uncertain_ranges(spark):
    text = "연봉 4,0O0만원\n연차 1O일 부여\n비고 1O:30 참고"
    specs = {"01-a": {"f": "specific", "q": ["연봉 4,0O0만원"]}, "10-a": {"f": "specific", "q": ["연차 1O일 부여"], "sv": "부여"}}
    at = lambda w: (text.index(w), text.index(w) + len(w))
    crit, topics, _ = run(spark, {"x": (text, body(text, specs))}, [("x", [at("4,0O0"), at("1O일"), at("1O:30")])])
    assert crit["x"]["01-a"].reason == "ocr_low_confidence"
    assert crit["x"]["10-a"].status == "CONFIRMED"  # only where the stated value stands
    assert topics["x"]["02"].status == "MAIN_UNAVAILABLE"  # a clock time nobody quoted


def relation_rows(spark, docs):
    """docs: [(record, seq, presence, side, comparable, grp, val, tax)]"""
    df = spark.createDataFrame(docs, "record_id string, seq bigint, presence string, side string, comparable boolean, grp string, val string, tax string")
    df = df.selectExpr("*", "'01' AS item_id", "'01-a' AS facet_id", "0 AS facet_no")
    return {r.record_id: r for r in relate.facet_relations(df).collect()}


def test_relations_match_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    docs = []
    for rec in range(60):
        for seq in range(rng.randint(1, 7)):
            side = rng.choice(["concrete"] * 4 + ["vague", "na", "missing", "missing"])
            comparable = side == "concrete" and rng.random() < 0.85
            grp, val, tax = (rng.choice("ab"), rng.choice("12"), rng.choice([None, "pre", "post"])) if comparable else (None, None, None)
            docs.append((str(rec), seq, "missing" if side == "missing" else "present", side, comparable, grp, val, tax))
    got = relation_rows(spark, docs)
    for rec, rows in itertools.groupby(docs, key=lambda d: d[0]):
        rows = list(rows)
        found = set()
        for a, b in itertools.combinations([r for r in rows if r[2] == "present"], 2):
            if "vague" in (a[3], b[3]):
                found.add("incomparable")
            elif a[3] == b[3] == "na":
                continue
            elif "na" in (a[3], b[3]):
                found.add("different_stated")
            elif not (a[4] and b[4]) or a[5] != b[5] or (a[7] and b[7] and a[7] != b[7]):
                found.add("incomparable")
            else:
                found.add("same" if a[6] == b[6] else "different_stated")
        present = [r[1] for r in rows if r[2] == "present"]
        missing = [r[1] for r in rows if r[2] == "missing"]
        if present and missing and min(missing) < min(present):
            found.add("newly_stated")
        if present and rows[-1][2] == "missing":
            found.add("not_mentioned_later")
        order = ["different_stated", "incomparable", "unavailable", "newly_stated", "not_mentioned_later", "same"]
        want = next((r for r in order if r in found), None) if len(rows) > 1 else None
        assert got[rec].relation == want, (rec, rows)


def test_follow_up_ranking(spark):
    c = [("r", t, k) for t, k in (("01", "different_stated"), ("02", "contract_unclear"), ("03", "conflict"), ("04", "offer_unclear"),
                                  ("07", "newly_stated"), ("08", "offer_unclear"), ("09", "missing"))]
    out = followups.rank_follow_ups(spark.createDataFrame(c, "record_id string, topic_id string, kind string")).orderBy("rank").collect()
    assert [(r.key, r.tier) for r in out] == [("01", "primary"), ("03", "primary"), ("02", "primary"), ("04", "more"), ("07+08", "more"), ("09", "more")]
    assert [r for r in out if r.key == "07+08"][0].kinds == ["offer_unclear", "newly_stated"]
