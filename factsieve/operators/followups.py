"""What to ask next, per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factsieve.packs import korean as K


def _rank(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(K.FOLLOW_UP_ORDER))):
        out = F.when(kind == name, i).otherwise(out)
    return out


def doc_candidates(topics: DataFrame) -> DataFrame:
    """Candidates from single documents.

    ``topics``: record_id, doc_id, seq, doc_type, topic_id, visible, status, conflicts.
    Whether another document speaks of the topic, and how late, is aggregated per record and
    topic and joined back; documents are never paired with each other.
    """
    shown = topics.filter("visible")
    elsewhere = shown.groupBy("record_id", "topic_id").agg(
        F.bool_or(F.col("status").isin("MAIN_FOUND", "MAIN_PARTIAL")).alias("_stated"),
        F.max(F.when(F.col("status") == "MAIN_FOUND", F.col("seq"))).alias("_last_found"))
    open_ones = shown.filter((F.col("conflicts") > 0) & (F.col("status") != "MAIN_UNAVAILABLE")
                             | F.col("status").isin("MAIN_PARTIAL", "MAIN_MISSING"))
    later = F.coalesce(F.col("_last_found") > F.col("seq"), F.lit(False))
    contract, offer, topic = F.col("doc_type") == "contract", F.col("doc_type") == "offer", F.col("topic_id")
    partial, missing = F.col("status") == "MAIN_PARTIAL", (F.col("status") == "MAIN_MISSING") & ~F.col("_stated")
    kind = (
        F.when(F.col("conflicts") > 0, "conflict")
        .when(partial & contract, "contract_unclear")
        .when(partial & later, F.lit(None).cast("string"))
        .when(partial & offer & topic.isin(*K.OFFER_CORE), "offer_unclear")
        .when(partial, "partial")
        .when(missing & contract & topic.isin(*K.CONTRACT_CORE), "contract_missing")
        .when(missing & contract, "missing")
        .when(missing & offer & topic.isin(*K.OFFER_MISSING_ASK), "missing"))
    joined = open_ones.join(elsewhere, ["record_id", "topic_id"]).withColumn("kind", kind)
    return joined.filter(F.col("kind").isNotNull()).select("record_id", "topic_id", "doc_id", "seq", "kind")


def relation_candidates(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates from relations (U2). ``docs``: record_id, seq, doc_type.

    What was stated newly or not again is asked about only if a side really states it: "not applicable" has neither value nor evidence.
    """
    stated = F.col("stated_docs") > 0
    last = docs.groupBy("record_id").agg(F.max_by("doc_type", "seq").alias("_last_type"))
    kind = (
        F.when(F.col("relation").isin("different_stated", "incomparable"), F.col("relation"))
        .when((F.col("relation") == "newly_stated") & stated & F.col("item_id").isin(*K.NEW_CONDITION_ITEMS), "newly_stated")
        .when((F.col("relation") == "not_mentioned_later") & stated & F.col("facet_id").isin(*[f[0][0] for _, _, f in K.RELATE_ITEMS])
              & (F.col("_last_type") == "contract"), "not_mentioned_later"))
    return (
        relations.filter(F.col("relation").isNotNull()).join(last, "record_id").withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("record_id", F.col("item_id").alias("topic_id"), "facet_id", "kind"))


def rank_follow_ups(candidates: DataFrame, limit: int = K.PRIMARY_LIMIT) -> DataFrame:
    """One row per record and topic, probation merged, ranked.

    ``candidates``: record_id, topic_id, kind. Reasons are kept as bits of one number, so
    merging is a plain partial aggregation; after it a record has at most ten rows.
    """
    rank = _rank(F.col("kind"))
    bits = candidates.select("record_id", "topic_id", F.expr("1").alias("_one"), rank.alias("_rank"))
    merged = bits.groupBy("record_id", "topic_id").agg(
        F.bit_or(F.call_function("shiftleft", F.col("_one"), F.col("_rank"))).alias("bits"), F.count("*").alias("n"))
    per_record = Window.partitionBy("record_id")
    both = (
        F.max(F.when(F.col("topic_id") == "07", 1).otherwise(0)).over(per_record)
        + F.max(F.when(F.col("topic_id") == "08", 1).otherwise(0)).over(per_record)) == 2
    keyed = merged.withColumn(
        "key", F.when(both & F.col("topic_id").isin("07", "08"), "07+08").otherwise(F.col("topic_id")))
    grouped = keyed.groupBy("record_id", "key").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("candidates"))
    order = K.FOLLOW_UP_ORDER
    has = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
    primary = F.lit(False)
    for i, name in enumerate(order):
        if name in K.PRIMARY_KINDS:
            primary = primary | has(i)
    kinds = F.array_compact(F.array(*[F.when(has(i), F.lit(n)) for i, n in enumerate(order)]))
    ranked = grouped.select(
        "record_id", "key", primary.alias("_primary"), kinds.alias("kinds"), "candidates")
    ranked = ranked.withColumn("kind", F.get("kinds", F.lit(0)))
    place = F.row_number().over(per_record.orderBy(F.col("_primary").desc(), _rank(F.col("kind")), "key"))
    ranked = ranked.withColumn("rank", place)
    tier = F.when(F.col("_primary") & (F.col("rank") <= limit), "primary").otherwise("more")
    return ranked.select("record_id", "key", "rank", tier.alias("tier"), "kind", "kinds", "candidates")


def reanalyze_list(topics: DataFrame) -> DataFrame:
    """Topics to run again: a failed analysis is not a question."""
    return topics.filter(F.col("visible") & (F.col("status") == "MAIN_UNAVAILABLE")).select("record_id", "doc_id", "topic_id")
