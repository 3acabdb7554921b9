"""Questions to send: fixed sentences, never guessed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.arrays import let, unnest
from factsieve.functions.text import clip, josa_of, norm_ws
from factsieve.packs import korean as K

# Wording of the questions
DOC_REF = {"job_posting": "채용공고에서", "offer": "안내해 주신 내용에서", "contract": "근로계약서에서"}
TOPIC = {
    "01": ("급여", "급여 금액과 산정 단위(시급·월급·연봉), 세전·세후 기준, 지급일과 지급방법을 알려 주실 수 있을까요?"),
    "02": ("근무시간", "근무일과 출퇴근 시각, 휴게시간, 주당 소정근로시간을 알려 주실 수 있을까요?"),
    "03": ("근무장소", "실제로 근무하게 될 장소(주소)와 재택·출장 여부를 알려 주실 수 있을까요?"),
    "04": ("담당업무", "입사 후 맡게 될 업무 내용과 범위를 구체적으로 알려 주실 수 있을까요?"),
    "05": ("고용형태", "정규직·기간제 등 어떤 형태의 근로계약으로 채용되는지 알려 주실 수 있을까요?"),
    "06": ("계약기간", "근로계약에 기간이 정해져 있는지, 있다면 시작일과 종료일을 알려 주실 수 있을까요?"),
    "07": ("수습기간", "수습기간이 있는지, 있다면 기간이 어떻게 되는지 알려 주실 수 있을까요?"),
    "08": ("수습 기간 중 급여", "수습 기간 중 급여가 어떻게 지급되는지(정규 급여와 같은지, 다르다면 어떻게 정해지는지) 알려 주실 수 있을까요?"),
    "09": ("휴일", "주휴일 등 쉬는 날이 어떻게 정해지는지와 유급 여부를 알려 주실 수 있을까요?"),
    "10": ("연차 유급휴가", "연차 유급휴가가 어떻게 부여되는지(대상, 일수, 산정방법)를 알려 주실 수 있을까요?"),
}
LABELS = {f: name for _, _, fs in K.COMPARE_ITEMS for f, name, _ in fs}
HELLO, THANKS = "안녕하세요. ", " 감사합니다."
NOT_FOUND, UNSETTLED = "에 관한 내용을 찾지 못해 여쭤봅니다.", "에 관한 내용 중 정해지지 않았거나 일부만 적힌 부분이 있어 여쭤봅니다."


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def topic_questions(topics: DataFrame) -> DataFrame:
    """Adds ``question`` to topics that are partly or not stated (Q1); other topics get none."""
    name = _lookup({k: v[0] for k, v in TOPIC.items()}, F.col("topic_id"))
    ask = _lookup({k: v[1] for k, v in TOPIC.items()}, F.col("topic_id"))
    lead = F.concat(_lookup(DOC_REF, F.col("doc_type")), F.lit(" "), name,
                    F.when(F.col("status") == "MAIN_MISSING", NOT_FOUND).otherwise(UNSETTLED))
    due = F.col("visible") & F.col("status").isin("MAIN_PARTIAL", "MAIN_MISSING")
    return topics.filter(due).withColumn("question", F.concat(F.lit(HELLO), lead, F.lit(" "), ask, F.lit(THANKS))).filter(
        F.col("question").isNotNull())


def topic_question_sql() -> str:
    """The same questions as a query over CTEs ``topics`` and ``docs``."""
    case = lambda col, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"
    return (
        "asked AS (SELECT t.doc_id, t.topic_id, t.tstatus, d.doc_type FROM topics t JOIN docs d ON d.doc_id = t.doc_id "
        "WHERE visible AND tstatus IN ('MAIN_PARTIAL', 'MAIN_MISSING')) SELECT doc_id, topic_id, "
        f"'{HELLO}' || {case('doc_type', DOC_REF)} || ' ' || {case('topic_id', {k: v[0] for k, v in TOPIC.items()})} || "
        f"CASE tstatus WHEN 'MAIN_MISSING' THEN '{NOT_FOUND}' ELSE '{UNSETTLED}' END || ' ' || "
        f"{case('topic_id', {k: v[1] for k, v in TOPIC.items()})} || '{THANKS}' AS question FROM asked")


def _shown(side: Column) -> Column:
    return clip(F.coalesce(side["value"], F.get(side["evidence"], F.lit(0))["text"]))


def _sentence(x: Column, item_label: Column, ask: Column, la: Column, lb: Column) -> Column:
    """Sentence for one compared facet with what its sides show, null if nothing has to be asked (Q2)."""
    f, a, b = x["f"], x["a"], x["b"]
    word = lambda forms: _lookup(forms, f["facet_id"])
    label, subject, object_ = word(LABELS), word({k: josa_of(v, "이", "가") for k, v in LABELS.items()}), word({k: josa_of(v, "을", "를") for k, v in LABELS.items()})
    blank = lambda s: F.when(s == "", "해당 없음").otherwise(s)
    c = F.concat
    l = F.lit
    gone = c(lb, l("에서 "), label, l("에 관한 내용을 찾지 못했습니다. "), la, l("에 적힌 조건("), a, l(")이 그대로 적용되는지 확인 부탁드립니다."))
    return (
        F.when(f["state"] == "changed", c(subject, l(" 문서마다 다르게 적혀 있습니다("), la, l(": "), blank(a), l(" / "), lb, l(": "), blank(b),
                                          l("). 최종적으로 적용되는 "), object_, l(" 확인 부탁드립니다.")))
        .when(f["state"] == "missing_one", gone)
        .when((f["state"] == "not_comparable") & (f["b"]["status"] == "MISSING") & (a != ""), gone)
        .when((f["state"] == "unclear") & f["b"]["status"].isin("PARTIAL", "UNCLEAR"),
              c(lb, l("의 "), subject, l(" 구체적으로 정해지지 않은 것으로 보여 여쭤봅니다("), lb, l(": "), b, l("). 구체적인 "), object_, l(" 알려 주실 수 있을까요?")))
        .when((f["state"] == "unclear") & (f["a"]["status"] == "CONFIRMED") & (f["b"]["status"] == "CONFIRMED"),
              c(subject, l(" 문서마다 다르게 표현되어 있습니다("), la, l(": "), a, l(" / "), lb, l(": "), b, l("). 같은 조건인지 확인 부탁드립니다.")))
        .when((f["state"] == "both_missing") & f["first"], c(l("두 문서 모두에서 "), item_label, l("에 관한 내용을 찾지 못했습니다. "), ask)))


def _new_condition(mine: Column, item_label: Column, la: Column, lb: Column) -> Column:
    """Conditions that the later document states for the first time (Q3)."""
    added = F.filter(mine, lambda x: x["f"]["state"].isin("added", "not_comparable") & (x["f"]["a"]["status"] == "MISSING")
                     & (x["f"]["b"]["status"] == "CONFIRMED") & (x["b"] != ""))

    def told(added: Column) -> Column:
        values = F.array_distinct(F.transform(added, lambda x: x["b"]))
        listed = F.array_join(F.transform(added, lambda x: F.concat(_lookup(LABELS, x["f"]["facet_id"]), F.lit(": "), x["b"])), " / ")
        shown = F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(listed)
        return F.when(F.size(added) > 0, F.concat(
            la, F.lit("에서는 "), item_label, F.lit("에 관한 내용을 찾지 못했고, "), lb, F.lit("에는 다음과 같이 적혀 있습니다("), shown,
            F.lit("). 이 조건으로 확정된 것인지, 따로 정해질 내용이 있는지 확인 부탁드립니다.")))

    return let(added, told)


def compare_questions(compared: DataFrame) -> DataFrame:
    """One question per pair and item, equal texts of a pair only once (Q2-Q5). What a side shows is worked out once per facet."""
    shown = F.transform("compared", lambda f: F.struct(f.alias("f"), _shown(f["a"]).alias("a"), _shown(f["b"]).alias("b")))
    pairs = compared.select("pair_id", shown.alias("_shown"), _lookup(K.DOC_TYPES, F.col("type_a")).alias("_la"), _lookup(K.DOC_TYPES, F.col("type_b")).alias("_lb"))
    la, lb = F.col("_la"), F.col("_lb")

    def item(item_id: str, name: str) -> Column:
        def text(mine: Column) -> Column:
            said = F.transform(mine, lambda x: _sentence(x, F.lit(name), F.lit(TOPIC[item_id][1]), la, lb))
            if item_id in K.NEW_CONDITION_ITEMS:
                said = F.array_append(said, _new_condition(mine, F.lit(name), la, lb))
            return let(F.array_distinct(F.array_compact(said)), lambda said: F.when(F.size(said) > 0, F.concat(
                F.lit(f"{HELLO}{name} 관련해 여쭤봅니다. "), F.array_join(said, " "), F.lit(THANKS))))

        mine = F.filter("_shown", lambda x: x["f"]["item_id"] == item_id)
        return F.struct(F.lit(item_id).alias("item_id"), let(mine, text).alias("text"))

    asked = pairs.select("pair_id", F.array(*[item(i, n) for i, n, _ in K.COMPARE_ITEMS]).alias("_items"))
    return unnest(asked, "_items", "pair_id", present="item_id").filter(F.col("text").isNotNull())


def dedupe(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """First of each text per key, white space aside; empty texts go (Q5). Combines before the shuffle."""
    normed = rows.withColumn("norm", norm_ws(F.col(text))).filter("norm <> ''")
    return normed.groupBy(*keys, "norm").agg(F.min(order).alias(order), F.min_by(text, order).alias(text))
