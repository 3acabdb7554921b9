"""Verification of claims: nothing is believed without a verbatim quote on its line.

Works on document rows that carry ``lines`` and ``claims``; both come from one document,
so every check is a column expression and needs no shuffle. Stored responses are brought
to their document by one equi-join (``sources.responses``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve import schemas
from factsieve.functions.arrays import let, unnest, unnest_values
from factsieve.functions.reuse import reused
from factsieve.functions.text import contains, matches, norm_ws, trim_space
from factsieve.packs.model import RulePack

# The answer vocabulary and the codes of quote errors
FINDINGS = ("specific", "coarse", "undecided", "conflict", "negated", "absent")
TERM_TYPES = ("fixed", "indefinite")
VALUE_KINDS = ("quoted", "calculated")
QUOTE_ERRORS = ("quote_not_in_line", "empty_quote")

FEEDBACK = {  # Fixed values: what a second pass is told about each error
    "unknown_line": "없는 줄 번호를 인용함",
    "quote_not_in_line": "인용 구절이 그 줄의 실제 텍스트와 다름",
    "empty_quote": "빈 인용",
    "missing_criterion": "세부기준 응답이 빠짐",
    "duplicate_criterion": "같은 세부기준을 두 번 응답함",
    "invalid_finding": "알 수 없는 finding 값",
    "invalid_quotes": "인용 형식 오류",
    "absent_with_quotes": "absent인데 인용이 있음",
    "no_quotes": "근거 인용이 없음",
    "negated_not_allowed": "이 세부기준에는 negated를 쓰지 않음",
    "conflict_needs_two": "상충인데 서로 다른 인용이 2개 미만",
    "source_value_not_in_quote": "source_value가 인용 구절 안에 없음",
    "missing_term_type": "06-a의 기간 유형(term_type) 누락",
}

_STRINGS = "array<string>"
_QUOTES = f"array<{schemas.QUOTE}>"


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _no(kind: str) -> Column:
    return F.array().cast(kind)


def distinct_texts(quotes: Column) -> Column:
    return F.size(F.array_distinct(F.transform(quotes, lambda q: norm_ws(q["text"]))))


def is_catch_all(text: Column, pack: RulePack) -> Column:
    """Names no specific condition ('other matters will be announced')."""
    if not pack.catch_all_head:
        return F.lit(False)
    return (
        matches(text, pack.catch_all_tail)
        & matches(norm_ws(text), pack.catch_all_head)
        & ~matches(text, pack.condition_word)
    )


def is_workday_only(text: Column, pack: RulePack) -> Column:
    if not pack.workday:
        return F.lit(False)
    return matches(text, pack.workday) & ~matches(text, pack.holiday_word)


def check_completeness(claims: Column, expected: Column) -> Column:
    """Per expected criterion: its only claim, or why there is none (V1). Unknown ids fall out."""

    def pick(cid: Column) -> Column:
        found = F.filter(claims, lambda c: c["criterion_id"] == cid)
        return F.struct(cid.alias("id"), found.alias("found"))

    def judge(p: Column) -> Column:
        code = (
            F.when(claims.isNull(), "malformed_response")
            .when(F.size(p["found"]) == 0, "missing_criterion")
            .when(F.size(p["found"]) > 1, "duplicate_criterion")
        )
        return F.struct(p["id"].alias("id"), F.get(p["found"], F.lit(0)).alias("c"), code.alias("code"))

    as_asked = F.coalesce(F.transform(claims, lambda c: c["criterion_id"]) == expected, F.lit(False))
    in_order = F.transform(claims, lambda c: F.struct(
        c["criterion_id"].alias("id"), c.alias("c"), F.lit(None).cast("string").alias("code")))
    return F.when(as_asked, in_order).otherwise(F.transform(F.transform(expected, pick), judge))


def cited_line(lines: Column, q: Column) -> Column:
    """The line that a quote names, among some lines of its document of which the first is the likely one."""
    first = F.get(lines, F.lit(0))
    return F.when(first["line_no"] == q["line"], first).otherwise(F.get(F.filter(lines, lambda l: l["line_no"] == q["line"]), F.lit(0)))


def check_quotes(quotes: Column, line_of) -> Column:
    """Each quote with its error code, null if it stands on its line, ``line_of(quote)`` (V2)."""

    def code(q: Column, line: Column) -> Column:
        return (
            F.when(q["line"].isNull() | q["text"].isNull(), "invalid_quotes")
            .when(line.isNull(), "unknown_line")
            .when(norm_ws(q["text"]) == "", "empty_quote")
            .when(~contains(norm_ws(line["text"]), norm_ws(q["text"])), "quote_not_in_line")
        )

    return F.transform(quotes, lambda q: F.struct(
        q["line"].alias("line"), q["text"].alias("text"), code(q, line_of(q)).alias("code")))


def _entry_of(pack: RulePack, line_of):
    """What makes the verified entry (V2-V7) of a claim ``c`` of criterion ``id`` that ``check_completeness`` gave a ``code`` or none."""

    # what a step binds with ``let`` is copied, so a step binds its own result and nothing else
    def quoted_in(value: Column, quotes: Column) -> Column:
        return F.exists(quotes, lambda q: contains(norm_ws(q["text"]), norm_ws(value)))

    def errors_of(p: Column, checked: Column, good: Column, value: Column) -> Column:
        finding = p["c"]["finding"]
        known = F.coalesce(finding.isin(*FINDINGS), F.lit(False))
        cited = F.size(checked) > 0
        shape = F.array(
            F.when(~known, "invalid_finding"),
            F.when((finding == "negated") & ~p["id"].isin(*pack.negation_status), "negated_not_allowed"),
            F.when(checked.isNull(), "invalid_quotes"),
        )
        content = F.when(checked.isNull(), _no(_STRINGS)).otherwise(F.concat(
            F.transform(checked, lambda q: q["code"]),
            F.array(
                F.when((finding == "absent") & cited, "absent_with_quotes"),
                F.when(known & (finding != "absent") & ~cited, "no_quotes"),
                F.when((finding == "conflict") & (distinct_texts(good) < 2), "conflict_needs_two"),
                F.when(value.isNotNull() & ~quoted_in(value, good), "source_value_not_in_quote"),
                F.when(
                    (p["id"] == F.lit(pack.fixed_term_id)) & (finding == "specific")
                    & ~F.coalesce(p["c"]["term_type"].isin(*TERM_TYPES), F.lit(False)), "missing_term_type"),
            ),
        ))
        return F.when(p["code"].isNotNull(), F.array(p["code"])).otherwise(F.array_compact(F.concat(shape, content)))

    def excluded_for(p: Column, text: Column) -> Column:
        rest = p["id"].startswith(f"{pack.rest_topic}-") if pack.rest_topic else F.lit(False)
        return F.when(is_catch_all(text, pack), "catch_all").when(rest & is_workday_only(text, pack), "workday_not_holiday")

    def entry(p: Column, checked: Column, value: Column, errors: Column, reasoned: Column, quotes: Column) -> Column:
        c, ok = p["c"], F.size(errors) == 0
        finding = (
            F.when((c["finding"] != "absent") & (F.size(quotes) == 0), "absent")
            .when((c["finding"] == "conflict") & (distinct_texts(quotes) < 2), "coarse")
            .otherwise(c["finding"])
        )
        is_hours = p["id"] == F.lit(pack.hours_id)
        bad = F.transform(
            F.filter(checked, lambda q: q["code"].isNotNull() & (q["code"] != "invalid_quotes")),
            lambda q: F.struct(q["line"].alias("line"), q["text"].alias("text"), q["code"].alias("code")))
        return F.struct(
            p["id"].alias("criterion_id"),
            F.when(ok, finding).alias("finding"),
            quotes.alias("quotes"),
            F.when(ok & quoted_in(value, quotes), value).alias("source_value"),
            F.when(ok & (p["id"] == F.lit(pack.fixed_term_id)) & c["term_type"].isin(*TERM_TYPES), c["term_type"])
            .alias("term_type"),
            F.when(ok & is_hours & c["value_kind"].isin(*VALUE_KINDS), c["value_kind"]).alias("value_kind"),
            F.when(ok & is_hours, c["calc"]).alias("calc"),
            F.when(ok, F.filter(reasoned, lambda q: q["reason"].isNotNull()))
            .otherwise(_no("array<struct<line:int,text:string,reason:string>>")).alias("excluded"),
            errors.alias("errors"),
            F.coalesce(F.when(p["code"].isNull(), bad), _no("array<struct<line:int,text:string,code:string>>")).alias("error_quotes"),
            F.lit(False).alias("unavailable"),
            F.lit(None).cast("string").alias("reason"),
        )

    def judged(p: Column) -> Column:
        given = p["c"]["source_value"]

        def with_good(checked: Column) -> Column:
            good = F.transform(
                F.filter(checked, lambda q: q["code"].isNull()),
                lambda q: F.struct(q["line"].alias("line"), trim_space(q["text"]).alias("text")))
            return let(good, lambda good: let(F.when(norm_ws(given) != "", trim_space(given)), lambda value: with_errors(checked, good, value)))

        def with_errors(checked: Column, good: Column, value: Column) -> Column:
            reasoned = F.transform(good, lambda q: F.struct(
                q["line"].alias("line"), q["text"].alias("text"), excluded_for(p, q["text"]).alias("reason")))
            return let(errors_of(p, checked, good, value), lambda errors: let(reasoned, lambda r: with_quotes(checked, value, errors, r)))

        def with_quotes(checked: Column, value: Column, errors: Column, reasoned: Column) -> Column:
            kept = F.transform(F.filter(reasoned, lambda q: q["reason"].isNull()),
                               lambda q: F.struct(q["line"].alias("line"), q["text"].alias("text")))
            quotes = F.when(F.size(errors) == 0, kept).otherwise(_no(_QUOTES))
            return let(quotes, lambda quotes: entry(p, checked, value, errors, reasoned, quotes))

        return let(check_quotes(p["c"]["quotes"], line_of), with_good)

    empty = F.struct(
        *[F.lit(None).cast("string").alias(n) for n in ("source_value", "term_type", "value_kind")],
        F.lit(None).cast(schemas.CALC).alias("calc"))

    def nothing(p: Column) -> Column:
        """The entry of a well-formed 'not mentioned': most claims are, and need no checks."""
        return F.struct(
            p["id"].alias("criterion_id"), F.lit("absent").alias("finding"), _no(_QUOTES).alias("quotes"),
            *[empty[n].alias(n) for n in ("source_value", "term_type", "value_kind", "calc")],
            _no("array<struct<line:int,text:string,reason:string>>").alias("excluded"),
            _no(_STRINGS).alias("errors"),
            _no("array<struct<line:int,text:string,code:string>>").alias("error_quotes"),
            F.lit(False).alias("unavailable"), F.lit(None).cast("string").alias("reason"))

    def whole_line(p: Column) -> Column:
        """A claim that quotes one whole line and nothing else, and that no rule objects to: the usual claim of the rules."""
        c, finding = p["c"], p["c"]["finding"]
        q = F.get(c["quotes"], F.lit(0))
        text = q["text"]
        fine = (
            p["code"].isNull() & (F.size(c["quotes"]) == 1) & c["source_value"].isNull()
            & (finding.isin("specific", "coarse", "undecided") | ((finding == "negated") & p["id"].isin(*pack.negation_status)))
            & (line_of(q)["text"] == text)
            & (F.length(text) > 0) & ~matches(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))), r"\s")
            & excluded_for(p, text).isNull())
        if pack.fixed_term_id:
            fine = fine & ((p["id"] != pack.fixed_term_id) | (finding != "specific") | F.coalesce(c["term_type"].isin(*TERM_TYPES), F.lit(False)))
        return F.coalesce(fine, F.lit(False))

    def as_claimed(p: Column) -> Column:
        """The entry of a claim that is a ``whole_line``."""
        c, is_hours = p["c"], p["id"] == F.lit(pack.hours_id)
        return F.struct(
            p["id"].alias("criterion_id"), c["finding"].alias("finding"), c["quotes"].alias("quotes"),
            F.lit(None).cast("string").alias("source_value"),
            F.when((p["id"] == F.lit(pack.fixed_term_id)) & c["term_type"].isin(*TERM_TYPES), c["term_type"]).alias("term_type"),
            F.when(is_hours & c["value_kind"].isin(*VALUE_KINDS), c["value_kind"]).alias("value_kind"),
            F.when(is_hours, c["calc"]).alias("calc"),
            _no("array<struct<line:int,text:string,reason:string>>").alias("excluded"),
            _no(_STRINGS).alias("errors"),
            _no("array<struct<line:int,text:string,code:string>>").alias("error_quotes"),
            F.lit(False).alias("unavailable"), F.lit(None).cast("string").alias("reason"))

    def checked(p: Column) -> Column:
        plain = (
            p["code"].isNull() & (p["c"]["finding"] == "absent") & (F.size(p["c"]["quotes"]) == 0)
            & p["c"]["source_value"].isNull())
        return F.when(plain, nothing(p)).when(whole_line(p), as_claimed(p)).otherwise(judged(p))

    return checked


def verify(docs: DataFrame, pack: RulePack, expected: Column | None = None, claims: str = "claims",
           out: str = "entries") -> DataFrame:
    """Adds ``out``: one verified entry per expected criterion (V1-V7)."""
    wanted = literals(pack.criterion_ids) if expected is None else expected
    build = lambda: F.transform(check_completeness(F.col(claims), wanted), _entry_of(pack, lambda q: F.get(F.col("lines"), q["line"] - 1)))
    return docs.withColumn(out, reused(("verify", pack.digest, claims), build) if expected is None else build())


def entry_rows(rows: DataFrame, pack: RulePack, *keep: str) -> DataFrame:
    """The verified entries (V2-V7) of claims that are rows with ``claim`` and ``lines`` (those it cites at least), one row each.

    The checks of ``verify``, but a claim is no element of an array here, so they are compiled and not interpreted. Completeness (V1) is for
    the source of the rows: ``code`` says what is wrong with a claim that is not the only one of its criterion, if there is such a column.
    """
    code = F.col("code") if "code" in rows.columns else F.lit(None).cast("string")
    asked = F.col("id") if "id" in rows.columns else F.col("claim.criterion_id")

    def build() -> Column:
        return F.array(_entry_of(pack, lambda q: cited_line(F.col("lines"), q))({"id": asked, "c": F.col("claim"), "code": code}))

    made = rows.select(*keep, reused(("entry rows", pack.digest, "code" in rows.columns, "id" in rows.columns), build).alias("_entry"))
    return unnest(made, "_entry", *keep, present="unavailable")


def failed(entry: Column) -> Column:
    return F.size(entry["errors"]) > 0


def at(entries: str | Column, pack: RulePack, cid: str) -> Column:
    """The entry of one criterion; entries stand in the order of the pack."""
    return F.get(entries, F.lit(pack.criterion_ids.index(cid)))


def plan_holds(docs: DataFrame, pack: RulePack, entries: str = "entries") -> DataFrame:
    """Adds ``held`` (topics to ask again) and ``independent`` (extras that fail on their own)."""
    lines = F.col("lines")

    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    def judge(topic) -> Column:
        core = [at(entries, pack, c.id) for c in topic.criteria if c.role == "C"]
        extra = [(c.id, at(entries, pack, c.id)) for c in topic.criteria if c.role == "D"]
        core_lines = F.flatten(F.array(*[F.transform(e["quotes"], lambda q: q["line"]) for e in core]))

        def apart(q: Column) -> Column:
            line = F.get(lines, q["line"] - 1)["text"]
            return (
                line.isNotNull() & ~F.coalesce(F.array_contains(core_lines, q["line"]), F.lit(False))
                & ~F.coalesce(matches(line, topic.core), F.lit(True))
                & ~F.coalesce(matches(q["text"], topic.core), F.lit(True))
            )

        def independent(e: Column) -> Column:
            return (
                F.forall(e["errors"], lambda c: c.isin(*QUOTE_ERRORS)) & (F.size(e["error_quotes"]) > 0)
                & F.forall(e["error_quotes"], apart)
            )

        core_failed = any_of([failed(e) for e in core])
        bound = any_of([failed(e) & ~independent(e) for _, e in extra])
        alone = F.array_compact(F.array(*[F.when(failed(e), F.lit(cid)) for cid, e in extra])) if extra else _no(_STRINGS)
        return F.struct(
            F.lit(topic.id).alias("topic_id"), (core_failed | bound).alias("held"),
            F.when(~core_failed & ~bound, alone).otherwise(_no(_STRINGS)).alias("independent"))

    # without a failed entry nothing is held
    build = lambda: F.coalesce(F.when(F.exists(entries, failed), F.array(*[judge(t) for t in pack.topics])),
                               _no("array<struct<topic_id:string,held:boolean,independent:array<string>>>"))
    planned = docs.withColumn("_plan", reused(("holds", pack.digest, entries), build))
    return planned.select(
        "*",
        F.transform(F.filter("_plan", lambda t: t["held"]), lambda t: t["topic_id"]).alias("held"),
        F.flatten(F.transform("_plan", lambda t: t["independent"])).alias("independent"),
    ).drop("_plan")


def held_criteria(pack: RulePack, held: Column) -> Column:
    """The criteria a second pass has to answer."""
    return F.filter(literals(pack.criterion_ids), lambda c: F.array_contains(held, F.substring(c, 1, 2)))


def merge_second_pass(docs: DataFrame, second: str | None = "second_entries", entries: str = "entries") -> DataFrame:
    """Held topics take the second pass, failing entries and independent extras become unavailable.

    Without a second pass (``second=None``) a held topic's entries are unavailable where the
    second answer is missing, which is all of them.
    """
    gone = F.lit("evidence_verification_failed")

    def unavailable(e: Column) -> Column:
        return (
            e.withField("unavailable", F.lit(True)).withField("reason", gone)
            .withField("finding", F.lit(None).cast("string")).withField("quotes", _no(_QUOTES))
            .withField("source_value", F.lit(None).cast("string"))
        )

    def merge(e: Column) -> Column:
        held = F.array_contains("held", F.substring(e["criterion_id"], 1, 2))
        if second is None:
            again = F.lit(None).cast(schemas.ENTRY)
        else:
            again = F.get(F.filter(second, lambda s: s["criterion_id"] == e["criterion_id"]), F.lit(0))
        retried = F.when(again.isNull() | failed(again), unavailable(e)).otherwise(again)
        alone = F.array_contains("independent", e["criterion_id"])
        return F.when(held, retried).when(alone, unavailable(e)).otherwise(e)

    settled = (F.size("held") == 0) & (F.size("independent") == 0)
    build = lambda: F.when(settled, F.col(entries)).otherwise(F.transform(entries, merge))
    return docs.withColumn(entries, reused(("merge", second, entries), build))


def error_rows(docs: DataFrame, key: str = "doc_id", entries: str = "entries") -> DataFrame:
    """Error codes as rows."""
    each = unnest_values(docs, entries, "e", key)
    return unnest_values(each, "e.errors", "code", key, F.col("e.criterion_id"))


def answer_errors(docs: DataFrame, pack: RulePack, expected: Column, key: str = "doc_id", claims: str = "claims", call_error: str = "call_error") -> DataFrame:
    """Error codes of stored answers as rows, in one pass over them: an answer that cannot be read has one row without a criterion, another the codes of its claims (V1-V7)."""
    unread = F.coalesce(F.col(call_error), F.lit("malformed_response"))
    asked = docs.withColumn("_asked", F.when(F.col(claims).isNotNull(), check_completeness(F.col(claims), expected)))
    each = asked.select(key, "lines", unread.alias("_unread"), F.inline_outer("_asked"))
    code = F.when(F.col("id").isNull(), F.col("_unread")).otherwise(F.col("code"))
    entries = entry_rows(each.select(key, "lines", "id", F.col("c").alias("claim"), code.alias("code")), pack, key)
    return unnest_values(entries, "errors", "code", key, "criterion_id")


def error_summary(docs: DataFrame, key: str = "doc_id", entries: str = "entries") -> DataFrame:
    """Distinct codes per document and criterion, with the wording for a second pass."""
    words = F.create_map(*[F.lit(x) for pair in FEEDBACK.items() for x in pair])
    failing = unnest_values(docs, F.filter(entries, failed), "e", key)
    codes = F.array_distinct(F.col("e.errors"))
    texts = F.transform(codes, lambda c: F.coalesce(F.try_element_at(words, c), c))
    return failing.select(key, F.col("e.criterion_id"), codes.alias("codes"), F.array_join(texts, ", ").alias("feedback"))


def verify_calc(calc: Column, quote_texts: Column) -> Column:
    """Recomputed weekly hours: struct(ok, reason, derived) (V8).

    Clock times and breaks must be quoted; one value per schedule, never an average.
    """
    from factsieve.packs import korean as K

    joined = F.array_join(quote_texts, "\n")
    clock = r"^(\d{1,2}):(\d{2})$"

    def minutes(t: Column) -> Column:
        hour = F.regexp_extract(F.trim(t), clock, 1).try_cast("int")
        minute = F.regexp_extract(F.trim(t), clock, 2).try_cast("int")
        return F.when((hour <= 24) & (minute < 60), hour * 60 + minute)

    def hours_text(h: Column) -> Column:
        # whole hours plainly, else at most two decimals without trailing zeros
        fixed = F.regexp_replace(F.format_string("%.2f", h), r"\.?0+$", "")
        return F.concat(F.when(h == F.floor(h), F.floor(h).cast("string")).otherwise(fixed), F.lit("시간"))

    def timed(s: Column) -> Column:
        return F.struct(s.alias("s"), minutes(s["start"]).alias("a"), minutes(s["end"]).alias("b"))

    def quoted_time(t: Column) -> Column:
        return contains(joined, t) | contains(joined, F.regexp_replace(t, "^0", ""))

    def segment_error(x: Column) -> Column:
        s, a, b = x["s"], x["a"], x["b"]
        pause = s["break_minutes"]
        fits = (a.isNotNull() & b.isNotNull() & (b > a) & s["days"].isNotNull() & s["days"].between(1, 7)
                & pause.isNotNull() & (pause >= 0) & (pause < b - a))
        return (
            F.when(~F.coalesce(fits, F.lit(False)), "calc_malformed")
            .when(~(quoted_time(s["start"]) & quoted_time(s["end"])), "calc_time_not_quoted")
            .when((pause > 0) & ~matches(joined, K.BREAK_WORD), "calc_break_not_quoted")
            .when((pause == 0) & ~matches(joined, K.NO_BREAK), "calc_break_not_quoted")
        )

    def schedule(e: Column) -> Column:
        parts = F.transform(e["segments"], timed)
        return F.struct(e.alias("e"), parts.alias("parts"))

    def judged(x: Column) -> Column:
        e, parts = x["e"], x["parts"]
        first = F.get(F.array_compact(F.transform(parts, segment_error)), F.lit(0))
        total = F.aggregate(
            parts, F.lit(0.0),
            lambda acc, p: acc + (p["b"] - p["a"] - p["s"]["break_minutes"]) / F.lit(60.0) * p["s"]["days"])
        shape = F.when(e.isNull() | e["segments"].isNull() | (F.size(e["segments"]) == 0) | e["hours"].isNull(),
                       "calc_malformed")
        error = F.coalesce(shape, first, F.when(F.abs(total - e["hours"]) > 0.01, "calc_mismatch"))
        return F.struct(e.alias("e"), parts.alias("parts"), total.alias("total"), error.alias("error"))

    def shown(x: Column) -> Column:
        value = F.concat(F.lit("주 "), hours_text(x["total"]))
        parts = F.transform(x["parts"], lambda p: F.concat(
            F.lit("("), p["s"]["end"], F.lit("−"), p["s"]["start"],
            F.when(p["s"]["break_minutes"] > 0,
                   F.concat(F.lit(" − 휴게 "), p["s"]["break_minutes"].cast("string"), F.lit("분"))).otherwise(""),
            F.lit(") × "), p["s"]["days"].cast("string"), F.lit("일")))
        return F.struct(F.coalesce(x["e"]["label"], F.lit("")).alias("label"), value.alias("value"),
                        F.concat(F.array_join(parts, " + "), F.lit(" = "), value).alias("derivation"))

    checked = F.transform(F.transform(calc["entries"], schedule), judged)
    reason = (
        F.when(calc.isNull() | calc["entries"].isNull() | (F.size(calc["entries"]) == 0), "calc_missing")
        .otherwise(F.get(F.array_compact(F.transform(checked, lambda x: x["error"])), F.lit(0)))
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"),
                    F.when(reason.isNull(), F.transform(checked, shown)).alias("derived"))


def misquoted(evaluated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Published quotes that are not on their line, of rows that still carry their lines (V13): key, criterion_id, line, text. No join."""
    lines = F.col("lines")

    def stands(q: Column) -> Column:
        line = F.get(lines, q["line"] - 1)
        return F.coalesce((line["line_no"] == q["line"]) & contains(norm_ws(line["text"]), norm_ws(q["text"])), F.lit(False))

    wrong = F.transform("criteria", lambda c: F.transform(
        F.filter(c["evidence"], lambda q: ~stands(q)),
        lambda q: F.struct(c["criterion_id"].alias("criterion_id"), q["line"].alias("line"), q["text"].alias("text"))))
    return unnest(evaluated, F.flatten(wrong), key, present="line")


def audit_evidence(published: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Published quotes that are not on their line; empty when all is well."""
    on_line = lines.select(F.col(key).alias("_k"), F.col("line_no"), F.col("text").alias("_line"))
    return published.join(
        on_line,
        (published[key] == on_line["_k"]) & (published["line"] == on_line["line_no"])
        & contains(norm_ws(on_line["_line"]), norm_ws(published["text"])),
        "left_anti",
    )
