"""Criterion and topic states from verified entries.

Everything a document needs is in its own row (lines, entries, uncertain ranges), so the
whole evaluation is a chain of projections: no shuffle, no Python. ``criterion_status``,
``topic_status`` and the other tables are explosions of the evaluated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve import schemas
from factsieve.functions.arrays import let, unnest, unnest_values
from factsieve.functions.reuse import Steps, reused
from factsieve.functions.text import SPACE_CHARS, as_digits, matches
from factsieve.operators.verify import at, cited_line, literals, verify_calc
from factsieve.packs import korean as K
from factsieve.packs.model import RulePack

_QUOTES = f"array<{schemas.QUOTE}>"
_DERIVED = f"array<{schemas.DERIVED}>"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _quotes_of(entries: str | Column, pack: RulePack, *ids: str) -> Column:
    """Quote texts of some criteria, in the order of ``ids``."""
    parts = [F.coalesce(at(entries, pack, i)["quotes"], F.array().cast(_QUOTES)) for i in ids]
    return F.transform(F.concat(*parts), lambda q: q["text"])


# ---- sub status and boundary rules -------------------------------------------------


def sub_status(e: Column, pack: RulePack) -> Column:
    """Finding to criterion status."""
    negated = F.lit("UNAVAILABLE")
    for cid, (to, _) in pack.negation_status.items():
        negated = F.when(e["criterion_id"] == cid, to).otherwise(negated)
    return (
        F.when(e["finding"] == "absent", "MISSING")
        .when(e["finding"] == "specific", "CONFIRMED")
        .when(e["finding"] == "coarse", "PARTIAL")
        .when(e["finding"].isin("undecided", "conflict"), "UNCLEAR")
        .when(e["finding"] == "negated", negated)
        .otherwise("MISSING")
    )


def boundary_limits(entries: str, pack: RulePack, calculated: Column) -> dict[str, tuple[str, str, Column]]:
    """criterion -> (status it falls to, diagnosis, does not hold up as confirmed)."""
    lines = F.col("lines")
    # a calculation that failed has lowered 02-a already
    claimed_calculation = F.coalesce(at(entries, pack, "02-a")["value_kind"] == "calculated", F.lit(False))
    texts = lambda *ids: _quotes_of(entries, pack, *ids)
    quotes = lambda cid: at(entries, pack, cid)["quotes"]
    finding = lambda cid: at(entries, pack, cid)["finding"]
    specific = lambda cid: F.coalesce(finding(cid) == "specific", F.lit(False))
    context = F.transform(quotes("09-a"), lambda q: F.when(matches(q["text"], K.HOLIDAY_LABEL), q["text"]).otherwise(
        F.coalesce(F.get(lines, q["line"] - 1)["text"], q["text"])))
    return {
        "01-b": ("MISSING", "unit_not_stated",
                 specific("01-b") & ~F.exists(texts("01-b", "01-a"), lambda t: matches(t, K.WAGE_UNIT))),
        "02-a": ("PARTIAL", "hours_not_quoted",
                 specific("02-a") & ~calculated & ~claimed_calculation & ~F.exists(texts("02-a"), lambda t: matches(t, K.STATED_HOURS))),
        "09-a": ("PARTIAL", "rest_day_not_designated_holiday",
                 specific("09-a") & F.forall(context, lambda t: matches(t, K.REST_DAY) & ~matches(t, K.DESIGNATED_HOLIDAY))),
        "10-a": ("PARTIAL", "external_reference_only",
                 specific("10-a") & F.forall(texts("10-a"), lambda t: matches(t, K.EXTERNAL_REFERENCE) & ~matches(t, K.GRANT_WORD))),
    }


# ---- uncertain ranges ---------------------------------------------------------------


def quote_range(q: Column, line: Column) -> Column:
    """Where a quote stands in the text; the whole line if it is not there literally."""
    at = F.position(q["text"], line["text"])
    start = F.when(at > 0, line["start"] + at - 1).otherwise(line["start"])
    end = F.when(at > 0, line["start"] + at - 1 + F.length(q["text"])).otherwise(line["end"])
    return F.when(line.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def overlaps(r: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda x: (x["start"] < r["end"]) & (r["start"] < x["end"]))


def range_contexts(r: Column, lines: Column) -> Column:
    """The words around an uncertain range, per line: widened to word edges plus one word each side."""
    not_space, space = f"[^{SPACE_CHARS}]", f"[{SPACE_CHARS}]"
    touched = F.filter(lines, lambda l: (l["end"] > r["start"]) & (l["start"] < r["end"]))

    def around(l: Column) -> Column:
        a = F.greatest(r["start"], l["start"]) - l["start"]
        b = F.least(r["end"], l["end"]) - l["start"]
        before = F.regexp_extract(F.substring(l["text"], F.lit(1), a), f"({not_space}*{space}*{not_space}*)\\z", 1)
        after = F.regexp_extract(F.substring(l["text"], b + 1, F.length(l["text"])),
                                 f"^({not_space}*{space}*{not_space}*)", 1)
        return F.concat(before, F.substring(l["text"], a + 1, b - a), after)

    return F.transform(touched, around)


def _real(ranges: str) -> Column:
    return F.filter(F.coalesce(F.col(ranges), F.array().cast(f"array<{schemas.RANGE}>")), lambda r: r["end"] > r["start"])


def _placed(e: Column, line_of) -> Column:
    """Where the quotes of an entry stand."""
    where = F.transform(e["quotes"], lambda q: F.struct(q["text"].alias("text"), quote_range(q, line_of(q)).alias("r")))
    return F.struct(
        e["criterion_id"].alias("id"), e["source_value"].alias("value"),
        F.filter(where, lambda w: w["r"].isNotNull()).alias("where"))


def _touched(p: Column, low: Column, pack: RulePack) -> Column:
    """Whether an uncertain range lies on the evidence of a placed entry."""
    whole = F.exists(p["where"], lambda w: overlaps(w["r"], low))
    # presence criteria: only where the stated value itself stands
    spots = F.filter(
        F.transform(p["where"], lambda w: F.struct(
            F.position(p["value"], w["text"]).alias("at"), w["text"].alias("text"), w["r"].alias("r"))),
        lambda s: (s["at"] > 0) & (s["r"]["end"] - s["r"]["start"] == F.length(s["text"])))
    spot_hit = F.exists(spots, lambda s: overlaps(
        F.struct((s["r"]["start"] + s["at"] - 1).alias("start"),
                 (s["r"]["start"] + s["at"] - 1 + F.length(p["value"])).alias("end")), low))
    narrow = p["id"].isin(*pack.presence_only) & p["value"].isNotNull() & (F.size(spots) > 0)
    return F.when(narrow, spot_hit).otherwise(whole)


def _with_uncertainty(df: DataFrame, pack: RulePack, entries: str, ranges: str | None) -> DataFrame:
    """Adds ``_touched`` (criteria whose evidence is uncertain) and ``_affected`` (topics)."""
    empty = F.array().cast("array<string>")
    if ranges is None:
        return df.withColumn("_touched", empty).withColumn("_affected", empty)
    lines = F.col("lines")
    df = df.withColumn("_low", _real(ranges))
    low = F.col("_low")

    placed = lambda e: _placed(e, lambda q: F.get(lines, q["line"] - 1))
    touched = lambda p: _touched(p, low, pack)
    live = F.filter(entries, lambda e: ~e["unavailable"] & (e["finding"] != "absent"))
    df = df.withColumn("_placed", F.when(F.size(low) > 0, F.transform(live, placed)))

    core_ids = pack.core_ids

    def topics_named(r: Column) -> Column:
        contexts = range_contexts(r, lines)
        named = [F.when(F.exists(contexts, lambda c: matches(c, t.core) | matches(as_digits(c), t.core)), F.lit(t.id))
                 for t in pack.topics]
        return F.struct(r["start"].alias("start"), r["end"].alias("end"),
                        F.array_compact(F.array(*named)).alias("topics"))

    df = df.withColumn("_named", F.when(F.size(low) > 0, F.transform(low, topics_named)))

    def affected(t: Column) -> Column:
        spots = F.flatten(F.transform(
            F.filter("_placed", lambda p: p["id"].isin(core_ids) & (F.substring(p["id"], 1, 2) == t)),
            lambda p: F.transform(p["where"], lambda w: w["r"])))
        return F.exists("_named", lambda r: F.array_contains(r["topics"], t) & ~overlaps(r, spots))

    return df.select(
        "*",
        F.coalesce(F.transform(F.filter("_placed", touched), lambda p: p["id"]), empty).alias("_touched"),
        F.when(F.size(low) > 0, F.filter(literals(pack.topic_ids), affected)).otherwise(empty).alias("_affected"),
    ).drop("_low", "_placed", "_named")


# ---- evaluation ---------------------------------------------------------------------


def evaluate(docs: DataFrame, pack: RulePack, entries: str = "entries", ranges: str | None = None) -> DataFrame:
    """Adds ``criteria``, ``topics`` and ``diagnostics`` to document rows.

    What criteria need to know of each other is worked out once per document, by position
    (entries stand in the order of the pack). After that one expression serves all criteria
    and one all topics, which keeps the plan small.
    """
    df = _with_uncertainty(docs, pack, entries, ranges)
    return reused(("evaluate", pack.digest, entries), lambda: _evaluation(pack, entries)).apply(df)


def _evaluation(pack: RulePack, entries: str) -> Steps:
    korean = pack.name == "employment_ko"
    df = Steps()
    false, nothing, no_quotes = F.lit(False), F.array().cast("array<string>"), F.array().cast(_QUOTES)
    one_of = lambda cid, ids: cid.isin(*ids) if ids else false

    # facts that several criteria of one document share
    limits: dict[str, tuple[str, str, Column]] = {}
    if korean:
        hours_entry = at(entries, pack, pack.hours_id)
        df = df.withColumn("_term_texts", F.array_join(_quotes_of(entries, pack, "05-a", "06-a", "06-b"), " ")).withColumn(
            "_calc", F.when(
                F.coalesce(hours_entry["value_kind"] == "calculated", false),
                verify_calc(hours_entry["calc"], _quotes_of(entries, pack, "02-a", "02-b", "02-c", "02-d"))))
        limits = boundary_limits(entries, pack, F.coalesce(F.col("_calc.ok"), false))
        df = df.withColumns({
            "_part_time": matches(F.col("_term_texts"), K.PART_TIME),
            "_fixed_term": matches(F.col("_term_texts"), K.FIXED_TERM)
            | F.coalesce(at(entries, pack, "06-a")["term_type"] == "fixed", false),
            "_limited": F.array_compact(F.array(*[F.when(F.coalesce(test, false), F.lit(c)) for c, (_, _, test) in limits.items()])),
        })

        def sure(cid: str) -> Column:
            """Confirmed, by the same rules as below."""
            e = at(entries, pack, cid)
            state = F.when(F.array_contains("_limited", cid), "LIMITED").otherwise(sub_status(e, pack))
            out = F.coalesce(e["unavailable"], false) | F.array_contains("_touched", cid) | F.array_contains("_affected", cid[:2])
            return ~out & (state == "CONFIRMED")

        negated = lambda cid: F.coalesce(at(entries, pack, cid)["finding"] == "negated", false)
        df = df.withColumns({
            "_term": F.when(sure("06-a"), at(entries, pack, "06-a")["term_type"]),
            "_probation": sure("07-a") & ~negated("07-a"), "_no_probation": sure("07-a") & negated("07-a"),
            "_leave": sure("10-a") & ~negated("10-a"), "_no_leave": sure("10-a") & negated("10-a"),
        })
        conditions = {
            "fixed_term": F.coalesce(F.col("_term") == "fixed", false), "probation_applies": F.col("_probation"),
            "leave_granted": F.col("_leave")}
        not_applicable = lambda cid: (
            F.when((cid == "06-b") & F.coalesce(F.col("_term") == "indefinite", false), "indefinite_term")
            .when((cid == "07-b") & F.col("_no_probation"), "no_probation").when((cid == "10-b") & F.col("_no_leave"), "no_leave"))
    else:
        conditions, not_applicable = {}, lambda cid: _none()
        df = df.withColumns({
            "_limited": nothing, "_part_time": false,
            "_fixed_term": false, "_probation": F.lit(True), "_no_probation": false,
            "_calc": _none(f"struct<ok:boolean,reason:string,derived:{_DERIVED}>")})

    # per criterion, without a list per document: what a lambda takes from outside is worked out again for each element
    def needed(cid: Column) -> Column:
        out = one_of(cid, [c.id for c in pack.criteria if c.role == "C" and not c.condition])
        for c in pack.criteria:
            if c.condition:
                out = F.when(cid == c.id, conditions[c.condition]).otherwise(out)
        return out

    # source codes per criterion, in pack order
    usual = F.array(*[literals(c.codes) if c.codes else nothing for c in pack.criteria])
    bound = F.col("_fixed_term") | F.col("_part_time")

    def codes(cid: Column, i: Column) -> Column:
        out = F.get(usual, i)
        for c in pack.criteria:
            if c.codes_fixed_or_part_time:
                out = F.when((cid == c.id) & bound, literals(c.codes_fixed_or_part_time)).otherwise(out)
            if c.codes_part_time:
                out = F.when((cid == c.id) & F.col("_part_time"), literals(c.codes_part_time)).otherwise(out)
        return out

    missing_limits = [c for c, (to, _, _) in limits.items() if to == "MISSING"]
    hours_id = F.lit(pack.hours_id)

    def judged(e: Column, i: Column) -> Column:
        cid = e["criterion_id"]
        base = sub_status(e, pack)
        calc = F.when(cid == hours_id, F.col("_calc"))
        status = (
            F.when(F.array_contains("_limited", cid), F.when(one_of(cid, missing_limits), "MISSING").otherwise("PARTIAL"))
            .when(calc.isNotNull() & ~calc["ok"] & (base == "CONFIRMED"), "PARTIAL").otherwise(base))
        own = (
            F.when(e["unavailable"], F.coalesce(e["reason"], F.lit("missing")))
            .when(F.array_contains("_touched", cid), "ocr_low_confidence")
            .when(one_of(cid, pack.core_ids) & F.array_contains("_affected", F.substring(cid, 1, 2)), "ocr_low_confidence_related"))
        na = not_applicable(cid)
        return F.struct(e.alias("e"), i.alias("i"), base.alias("base"), status.alias("status"), own.alias("own"), na.alias("na"),
                        (calc.isNotNull() & calc["ok"]).alias("calculated"))

    def result(x: Column) -> Column:
        e, na, own = x["e"], x["na"], x["own"]
        cid, live = e["criterion_id"], na.isNull() & own.isNull()
        # a branch decided by the document outranks a failed check
        known = F.when(na.isNotNull() | own.isNull(), e["finding"])
        kind = (
            F.when(x["calculated"], "calculated").when((cid == hours_id) & (x["base"] == "CONFIRMED"), "quoted")
            .when(e["source_value"].isNotNull(), "quoted"))
        tag = _none()
        for c, (_, name) in pack.negation_status.items():
            tag = F.when(cid == c, name).otherwise(tag) if name else tag
        return F.struct(
            cid.alias("criterion_id"), F.substring(cid, 1, 2).alias("topic_id"),
            F.when(na.isNotNull(), "NOT_APPLICABLE").when(own.isNotNull(), "UNAVAILABLE").otherwise(x["status"]).alias("status"),
            F.when(live, e["quotes"]).otherwise(no_quotes).alias("evidence"),
            F.when(live, e["source_value"]).alias("source_value"), known.alias("finding"),
            F.when(live & (x["status"] == "CONFIRMED"), e["term_type"]).alias("term_type"),
            F.when(live & x["calculated"], F.col("_calc.derived")).alias("derived"),
            F.when(live, kind).alias("value_kind"), F.coalesce(na, own).alias("reason"),
            F.when(na.isNotNull(), na).when(own.isNotNull(), own).when(known == "negated", "negated")
            .when(x["status"] == "UNCLEAR", known).alias("basis"),
            needed(cid).alias("required"),
            F.when(live & (e["finding"] == "negated"), tag).alias("provisional"),
            codes(cid, x["i"]).alias("sources"), one_of(cid, pack.core_ids).alias("core"))

    df = df.withColumn("_judged", F.transform(entries, judged)).withColumn("criteria", F.transform("_judged", result))

    # topics are slices of the criteria
    spans, first = [], 1
    for t in pack.topics:
        text = lambda keys: literals([pack.links[k] for k in keys]) if keys else nothing
        spans.append(F.struct(F.lit(t.id).alias("id"), F.lit(first).alias("first"), F.lit(len(t.criteria)).alias("n"),
                              F.lit(t.conditional).alias("conditional"), text(t.links).alias("links")))
        first += len(t.criteria)
    more_links = literals([pack.links[k] for k in pack.applicability_links]) if pack.applicability_links else nothing
    done = lambda c: c["status"].isin("CONFIRMED", "NOT_APPLICABLE")

    def with_criteria(t: Column) -> Column:
        mine = F.slice("criteria", t["first"], t["n"])
        visible = ~t["conditional"] | F.col("_probation")
        return F.struct(t.alias("t"), visible.alias("visible"), mine.alias("mine"),
                        F.filter(mine, lambda c: c["required"]).alias("need"))

    def topic(x: Column) -> Column:
        t, mine, need, visible = x["t"], x["mine"], x["need"], x["visible"]
        status = (
            F.when(F.exists(need, lambda c: c["status"] == "UNAVAILABLE"), "MAIN_UNAVAILABLE")
            .when(F.forall(need, done), "MAIN_FOUND")
            .when(F.exists(mine, lambda c: F.size(c["evidence"]) > 0), "MAIN_PARTIAL").otherwise("MAIN_MISSING"))
        denied = lambda ids: F.exists(mine, lambda c: one_of(c["criterion_id"], ids) & (
            F.coalesce(c["finding"] == "negated", false)) & (c["status"] != "UNAVAILABLE"))
        applicability = denied(pack.applicability_targets)
        hold = (t["id"] == "07") & ~F.col("_probation") & ~F.col("_no_probation") if korean else false
        notes = F.array_compact(F.array(
            F.when(denied(pack.neutral_targets), "neutral"), F.when(applicability, "applicability"),
            F.when(hold, "probationHold")))
        values = F.array_distinct(F.array_compact(F.transform(
            mine, lambda c: F.when(c["core"] & ~c["status"].isin("UNAVAILABLE", "NOT_APPLICABLE"), c["source_value"]))))
        quoted = lambda cs: F.get(F.get(F.filter(cs, lambda c: F.size(c["evidence"]) > 0), F.lit(0))["evidence"], F.lit(0))
        count = lambda cs, test: F.size(F.filter(cs, test))
        shown = lambda col: F.when(visible, col)
        listed = lambda col: F.when(visible, col).otherwise(nothing)
        return F.struct(
            t["id"].alias("topic_id"), visible.alias("visible"), shown(status).alias("status"), listed(notes).alias("notes"),
            listed(F.transform(F.filter(mine, lambda c: c["status"].isin("MISSING", "UNCLEAR")), lambda c: c["criterion_id"])).alias("unconfirmed"),
            listed(t["links"]).alias("links"), listed(F.when(applicability, more_links).otherwise(nothing)).alias("applicability_links"),
            shown(F.when(F.size(values) > 0, F.array_join(values, " · "))).alias("value"),
            shown(F.coalesce(quoted(need), quoted(mine))).alias("first_evidence"),
            shown(count(need, lambda c: c["status"] == "CONFIRMED")).alias("core_confirmed"),
            shown(count(need, lambda c: ~done(c))).alias("core_open"),
            shown(count(mine, lambda c: ~c["core"] & c["status"].isin("MISSING", "UNCLEAR"))).alias("extra_open"),
            shown(count(need, lambda c: F.coalesce(c["basis"] == "conflict", false))).alias("conflicts"))

    df = df.withColumn("topics", F.transform(F.transform(F.array(*spans), with_criteria), topic))

    def diags(x: Column) -> Column:
        e, cid = x["e"], x["e"]["criterion_id"]
        diagnosis, tag = _none(), _none()
        for c, (_, text, _) in limits.items():
            diagnosis = F.when(cid == c, text).otherwise(diagnosis)
        for c, (_, name) in pack.negation_status.items():
            tag = F.when(cid == c, f"provisional_negation:{name}").otherwise(tag) if name else tag
        found = F.array_compact(F.array(
            F.when((cid == hours_id) & ~F.col("_calc.ok"), F.col("_calc.reason")),
            F.when(F.array_contains("_limited", cid), diagnosis),
            F.when(F.size(e["excluded"]) > 0, "excluded_quotes"), F.when(e["finding"] == "negated", tag)))
        return F.transform(found, lambda d: F.struct(cid.alias("id"), d.alias("diag")))

    seen = F.filter("_judged", lambda x: x["own"].isNull() | (x["own"] == "ocr_low_confidence_related"))
    related = F.transform("_affected", lambda t: F.struct(t.alias("id"), F.lit("ocr_low_confidence_core_context").alias("diag")))
    return df.withColumn("diagnostics", F.concat(F.flatten(F.transform(seen, diags)), related))


# ---- tables -------------------------------------------------------------------------


def criterion_status(evaluated: DataFrame, *keys: str) -> DataFrame:
    return unnest(evaluated, "criteria", *(keys or ("doc_id",)), present="criterion_id")


def topic_status(evaluated: DataFrame, *keys: str) -> DataFrame:
    return unnest(evaluated, "topics", *(keys or ("doc_id",)), present="topic_id")


def diagnostics(evaluated: DataFrame, key: str = "doc_id") -> DataFrame:
    return unnest(evaluated, "diagnostics", key, present="id")


def published_quotes(evaluated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every quote that is shown, one row each."""
    each = unnest_values(evaluated, "criteria", "c", key)
    return unnest(each, "c.evidence", key, F.col("c.criterion_id"), present="line")


def status_counts(evaluated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Shown topics and topics per state, per document."""

    def in_state(state: str):
        return lambda t: t["visible"] & (t["status"] == state)

    return evaluated.select(
        key, F.size(F.filter("topics", lambda t: t["visible"])).alias("shown"),
        *[F.size(F.filter("topics", in_state(s))).alias(s.removeprefix("MAIN_").lower())
          for s in ("MAIN_FOUND", "MAIN_PARTIAL", "MAIN_MISSING", "MAIN_UNAVAILABLE")])


def highlight_ranges(evaluated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Merged ranges to mark per line; offsets count from the line's start (E19). Touching or overlapping ranges are one."""
    quotes = F.array_distinct(F.flatten(F.transform("criteria", lambda c: c["evidence"])))
    marked = evaluated.select(key, "lines", quotes.alias("_quotes"))

    def spot(q: Column) -> Column:
        at = lambda l: F.position(q["text"], l["text"])
        return let(F.get("lines", q["line"] - 1), lambda l: F.struct(
            l["line_no"].alias("line_no"), F.when(at(l) > 0, at(l) - 1).otherwise(0).alias("start"),
            F.when(at(l) > 0, at(l) - 1 + F.length(q["text"])).otherwise(F.length(l["text"])).alias("end")))

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["line_no"].alias("line_no"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(last.isNotNull() & (r["line_no"] == last["line_no"]) & (r["start"] <= last["end"]),
                      F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.array_append(acc, r))

    # sorted by line and place, so one pass merges the ranges of all lines
    spots = F.array_sort(F.array_distinct(F.filter(F.transform("_quotes", spot), lambda s: s["line_no"].isNotNull())))
    merged = F.aggregate(F.col("_spots"), F.array().cast("array<struct<line_no:int,start:int,end:int>>"), step)
    placed = marked.select(key, spots.alias("_spots"))
    # ranges on different lines have nothing to merge
    apart = F.size(F.array_distinct(F.col("_spots.line_no"))) == F.size("_spots")
    return unnest(placed, F.when(apart, F.col("_spots")).otherwise(merged), key, present="start")


def low_conf_overlap(docs: DataFrame, pack: RulePack, ranges: str = "low_confidence", key: str = "doc_id") -> DataFrame:
    """Criteria and topics an uncertain range bears on, one row each."""
    df = _with_uncertainty(docs, pack, "entries", ranges)
    hit = F.concat(
        F.transform("_touched", lambda c: F.struct(c.alias("id"), F.lit("evidence").alias("scope"))),
        F.transform("_affected", lambda t: F.struct(t.alias("id"), F.lit("context").alias("scope"))))
    return unnest(df, hit, key, present="id")


def low_conf_evidence(entries: DataFrame, pack: RulePack, ranges: str = "low_confidence", key: str = "doc_id") -> DataFrame:
    """The part of ``low_conf_overlap`` that is about evidence (E5), for entries that are rows (``verify.entry_rows``): key, id."""
    live = entries.filter(~F.col("unavailable") & (F.col("finding") != "absent")).withColumn("_low", _real(ranges)).filter(F.size("_low") > 0)
    placed = live.withColumn("_p", _placed({n: F.col(n) for n in ("criterion_id", "source_value", "quotes")}, lambda q: cited_line(F.col("lines"), q)))
    return placed.filter(_touched(F.col("_p"), F.col("_low"), pack)).select(key, F.col("criterion_id").alias("id"))
