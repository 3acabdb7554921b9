"""Comparable values per document and facet (the ``facet_values`` job).

Each compared facet of a document becomes: which kind of side it is, whether it can be
compared at all, within which group (unit, kind of period, ...) and with which value.
Two sides agree exactly when group and value agree, so comparing needs no pair-wise
parsing and relations inside a record can be counted instead of enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions import values as V
from factsieve.functions.arrays import let, unnest
from factsieve.functions.reuse import Steps, reused
from factsieve.functions.text import normalize_condition_text
from factsieve.operators.verify import at
from factsieve.packs import korean as K


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def side_kind(c: Column, no_probation: Column, facet: str) -> Column:
    """concrete / vague / missing / na / unavailable."""
    kind = (
        F.when(c["status"] == "CONFIRMED", "concrete").when(c["status"].isin("PARTIAL", "UNCLEAR"), "vague")
        .when(c["status"] == "MISSING", "missing").when(c["status"] == "NOT_APPLICABLE", "na").otherwise("unavailable"))
    return F.when(no_probation, "na").otherwise(kind) if facet == "08-a" else kind


def presence_kind(c: Column, no_probation: Column, facet: str) -> Column:
    """present / missing / unavailable (R2)."""
    kind = F.when(c["status"] == "UNAVAILABLE", "unavailable").when(c["status"] == "MISSING", "missing").otherwise("present")
    if facet == "08-a":
        kind = F.when(c["status"] == "UNAVAILABLE", "unavailable").when(no_probation, "present").otherwise(kind)
    return kind


def ctx_text(*cs: Column) -> Column:
    """Stated values and quotes of related criteria, one per line."""
    parts = [
        F.when(c["status"] == "UNAVAILABLE", F.array().cast("array<string>")).otherwise(
            F.array_compact(F.concat(F.array(c["source_value"]), F.transform(c["evidence"], lambda q: q["text"]))))
        for c in cs]
    return F.array_join(F.concat(*parts), "\n")


def _number_text(n: Column) -> Column:
    """40.0 -> '40', 37.5 -> '37.5'."""
    return F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))


def _read(grp: Column, val: Column, num: Column | None = None, tax: Column | None = None) -> Column:
    """A reading; one without value has no group either and is incomparable, as is one without group."""
    return F.struct(grp.alias("grp"), val.alias("val"), (_null("double") if num is None else num).alias("num"), (_null() if tax is None else tax).alias("tax"))


def _reading(kind: str, text: Column, c: Column, wage_ctx: Column, tax_ctx: Column) -> Column:
    """struct(grp, val, num, tax); an incomparable side has a null value. What is used more than once is bound with ``let``."""
    if kind == "money":
        both = F.struct(V.single(V.amounts(text)).alias("amount"), V.pay_unit(wage_ctx).alias("unit"))
        return let(both, lambda x: _read(
            x["unit"], F.when(x["unit"].isNotNull(), x["amount"].cast("string")), x["amount"].cast("double"), V.tax_basis(tax_ctx)))
    if kind == "hours":
        derived = F.flatten(F.transform(
            F.coalesce(c["derived"], F.array().cast("array<struct<label:string,value:string,derivation:string>>")),
            lambda d: V.hours(d["value"])))
        return let(V.single(F.concat(derived, V.hours(text))), lambda h: _read(h["per"], _number_text(h["h"]), h["h"]))
    if kind == "times":
        return _read(F.lit("clock"), let(V.time_ranges(text, skip_breaks=True), lambda r: F.when(F.size(r) > 0, F.array_join(r, ","))))
    if kind == "break":
        return let(V.single(V.break_minutes(text)), lambda m: _read(F.lit("minutes"), m.cast("string"), m.cast("double")))
    if kind == "payday":
        return _read(F.lit("day"), V.single(V.paydays(text)))
    if kind in ("place", "text"):
        # differing wording is never called a change: every wording is its own group
        return let(F.nullif(normalize_condition_text(text, place=kind == "place"), F.lit("")), lambda norm: _read(norm, norm))
    if kind == "employment":
        return _read(F.lit("form"), let(V.employment_kinds(text), lambda kinds: F.when(F.size(kinds) > 0, F.array_join(kinds, ","))))
    if kind == "term":
        return _read(F.lit("term"), c["term_type"])
    if kind == "period":
        return let(V.period(text), lambda p: _read(p["kind"], p["value"]))
    if kind == "probation":
        return _read(F.lit("probation"), F.when(c["finding"] == "negated", "none").otherwise("applies"))
    if kind == "duration":
        return let(V.single(V.durations(text)), lambda d: _read(d["unit"], d["n"].cast("string"), d["n"].cast("double")))
    both = F.struct(V.single(V.percents(text)).alias("percent"), V.single(V.amounts(text)).alias("amount"))
    return let(both, lambda x: _read(
        F.when(x["percent"].isNotNull(), "percent").when(x["amount"].isNotNull(), "amount"),
        F.coalesce(_number_text(x["percent"]), x["amount"].cast("string")),
        F.coalesce(x["percent"], x["amount"].cast("double"))))


def with_facets(evaluated: DataFrame, pack, items=K.RELATE_ITEMS) -> DataFrame:
    """Adds ``facets``: one struct per compared facet, in facet order."""
    return reused(("facets", pack.digest, repr(items)), lambda: _facet_steps(pack, items)).apply(evaluated)


def _facet_steps(pack, items) -> Steps:
    crit = lambda cid: at("criteria", pack, cid)
    p = crit("07-a")
    df = Steps().withColumn(
        "_no_probation", F.coalesce((p["status"] == "CONFIRMED") & (p["finding"] == "negated"), F.lit(False)))
    df = df.withColumns({
        "_wage_ctx": ctx_text(crit("01-a"), crit("01-b")), "_tax_ctx": ctx_text(crit("01-a"), crit("01-g"))})
    structs = []
    for item, _, facets in items:
        for nth, (facet, _, kind) in enumerate(facets):
            structs.append(_facet(facet, item, len(structs), nth == 0, kind, crit(facet)))
    return df.withColumn("facets", F.array(*structs))


def _facet(facet: str, item: str, no: int, first: bool, kind: str, c: Column) -> Column:
    """One compared facet of a document; ``c`` is the criterion of that name."""
    text = F.coalesce(c["source_value"], F.array_join(F.transform(c["evidence"], lambda q: q["text"]), "\n"))
    side = side_kind(c, F.col("_no_probation"), facet)
    reading = F.when(side == "concrete", let(text, lambda text: _reading(kind, text, c, F.col("_wage_ctx"), F.col("_tax_ctx"))))
    return let(reading, lambda r: F.struct(
        F.lit(facet).alias("facet_id"), F.lit(item).alias("item_id"), F.lit(no).alias("facet_no"), F.lit(first).alias("first"),
        side.alias("side"), presence_kind(c, F.col("_no_probation"), facet).alias("presence"),
        c["status"].alias("status"), c["finding"].alias("finding"),
        (r["val"].isNotNull() & r["grp"].isNotNull()).alias("comparable"),
        F.when(r["val"].isNotNull(), r["grp"]).alias("grp"), r["val"].alias("val"), r["num"].alias("num"), r["tax"].alias("tax"),
        c["source_value"].alias("value"), c["evidence"].alias("evidence")))


def facet_values(with_facets_df: DataFrame, *keys: str) -> DataFrame:
    """The facet table: one row per document and facet."""
    return unnest(with_facets_df, "facets", *(keys or ("doc_id",)), present="facet_id")
