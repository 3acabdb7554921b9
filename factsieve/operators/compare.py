"""Comparison of two submitted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsieve.functions.arrays import unnest
from factsieve.packs import korean as K


def _rank(value: Column, order) -> Column:
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, i).otherwise(out)
    return out


def stage(doc_type: Column) -> Column:
    return _rank(doc_type, tuple(K.STAGE))


def build_pairs(requests: DataFrame, docs: DataFrame, *carry: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) from requests(pair_id, doc_id).

    Exactly two documents of two known types; the earlier stage is A. One join on doc_id and
    one aggregation on pair_id; a request with any number of documents keeps a constant state.
    What documents carry can be far larger than what they are made from, by which their size is
    estimated, so both sides are shuffled and no side is ever gathered in the driver.
    """
    body = [F.col(c) for c in ("doc_id", "doc_type", *carry)]
    sides = requests.join(docs.select(*body).hint("merge"), "doc_id", "left").withColumn("_stage", stage(F.col("doc_type")))
    both = F.struct("doc_id", "doc_type", *carry)
    judged = sides.groupBy("pair_id").agg(
        F.count("*").alias("n"), F.count("_stage").alias("known"),
        F.min("_stage").alias("lo"), F.max("_stage").alias("hi"),
        F.min_by(both, "_stage").alias("a"), F.max_by(both, "_stage").alias("b"))
    code = (
        F.when(F.col("n") != 2, "not_two_documents").when(F.col("known") != 2, "unknown_type")
        .when(F.col("lo") == F.col("hi"), "same_type"))
    coded = judged.withColumn("code", code)
    return (
        coded.filter(F.col("code").isNull()).select("pair_id", "a", "b"),
        coded.filter(F.col("code").isNotNull()).select("pair_id", "code"))


def presence_state(a: Column, b: Column, missing_a_type: Column, missing_b_type: Column) -> Column:
    """State decided by presence alone, null if both sides are concrete (C4). The order is the rule."""
    one = lambda k: (a == k) | (b == k)
    both = lambda k: (a == k) & (b == k)
    return (
        F.when(one("unavailable"), "unavailable")
        .when(both("missing"), "both_missing")
        .when(one("missing") & one("na"), "not_applicable")
        .when((a == "missing") & (missing_a_type == "offer"), "not_comparable")
        .when((b == "missing") & (missing_b_type == "offer"), "not_comparable")
        .when(a == "missing", "added").when(b == "missing", "missing_one")
        .when(both("na"), "not_applicable")
        .when(one("vague"), "unclear")
        .when(one("na"), "changed"))


def concrete_state(a: Column, b: Column) -> Column:
    """State of two concrete sides (C5): same group and one value, or no comparison."""
    tax_clash = F.coalesce(a["tax"] != b["tax"], F.lit(False))
    return (
        F.when(~(a["comparable"] & b["comparable"]), "unclear")
        .when((a["grp"] != b["grp"]) | tax_clash, "unclear")
        .when(a["val"] == b["val"], "same").otherwise("changed"))


def compare(pairs: DataFrame) -> DataFrame:
    """Adds ``compared``: a struct per facet of accepted pairs whose sides carry ``facets``."""
    a_type, b_type = F.col("a.doc_type"), F.col("b.doc_type")

    def facet(a: Column, b: Column) -> Column:
        state = F.coalesce(presence_state(a["side"], b["side"], a_type, b_type), concrete_state(a, b))
        delta = F.when(state.isin("same", "changed") & (a["grp"] == b["grp"]), b["num"] - a["num"])
        side = lambda s: F.struct(
            s["status"].alias("status"),
            F.when(~s["side"].isin("missing", "unavailable"), s["value"]).alias("value"),
            s["evidence"].alias("evidence"), s["finding"].alias("finding"))
        return F.struct(
            a["facet_id"].alias("facet_id"), a["item_id"].alias("item_id"), a["facet_no"].alias("facet_no"),
            a["first"].alias("first"), state.alias("state"), delta.alias("delta"), side(a).alias("a"), side(b).alias("b"))

    items = [i for i, _, _ in K.COMPARE_ITEMS]
    kept = lambda col: F.filter(col, lambda f: f["item_id"].isin(items))
    return pairs.select(
        "pair_id", F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"),
        a_type.alias("type_a"), b_type.alias("type_b"),
        F.zip_with(kept("a.facets"), kept("b.facets"), facet).alias("compared"))


def facet_compare(compared: DataFrame) -> DataFrame:
    return unnest(compared, "compared", "pair_id", "doc_a", "doc_b", "type_a", "type_b", present="facet_id")


def item_states(compared: DataFrame) -> DataFrame:
    """Representative state per item (C7): a further facet that is absent on both sides does not decide."""
    order = K.STATE_ORDER

    def item(item_id: str) -> Column:
        mine = F.filter("compared", lambda f: f["item_id"] == item_id)
        deciding = F.filter(mine, lambda f: f["first"] | ~f["state"].isin("both_missing", "not_applicable"))
        best = F.array_min(F.transform(deciding, lambda f: _rank(f["state"], order)))
        return F.struct(F.lit(item_id).alias("item_id"),
                        F.element_at(F.array(*[F.lit(s) for s in order]), best + 1).alias("state"))

    states = F.array(*[item(i) for i, _, _ in K.COMPARE_ITEMS])
    return unnest(compared, states, "pair_id", present="item_id")


def state_counts(items: DataFrame) -> DataFrame:
    """Items per state and pair."""
    return items.groupBy("pair_id").agg(*[
        F.count_if(F.col("state") == s).cast("bigint").alias(s) for s in K.STATE_ORDER])


def highlights(compared: DataFrame) -> DataFrame:
    """Facets in the five states to look at first, with their place in the list."""
    order = K.STATE_ORDER
    picked = F.filter("compared", lambda f: f["state"].isin(*order[:5]))
    ranked = F.array_sort(F.transform(picked, lambda f: F.struct(
        _rank(f["state"], order).alias("rank"), f["facet_no"].alias("facet_no"), f["facet_id"].alias("facet_id"),
        f["item_id"].alias("item_id"), f["state"].alias("state"))))
    placed = F.transform(ranked, lambda f, i: f.withField("place", i + 1))
    return unnest(compared, placed, "pair_id", present="facet_id").drop("rank", "facet_no")
