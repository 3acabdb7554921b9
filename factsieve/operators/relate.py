"""Relations between the documents of one record.

All pairs of a record's documents count, but pairs are never built: sides with the same
reading fall together, and how many pairs agree, differ or cannot be compared follows from
group sizes. Every step is a partial aggregation, so a record that holds a third of all
documents costs no more than any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factsieve.packs import korean as K


def blocked_rank(df: DataFrame, keys: list[str], block: Column, order: list[str], name: str) -> DataFrame:
    """1-based position of each row within ``keys`` ordered by ``order``.

    ``block`` is a coarse value that rises with the order (a day, say). Rows are numbered
    within a block and blocks are offset by what lies before them, so no task has to sort a
    whole hot key.
    """
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    return (
        local.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_local")).drop("_block", "_before", "_local"))


def doc_labels(docs: DataFrame, block: Column | None = None) -> DataFrame:
    """doc_id and its name; numbered where a type repeats in a record."""
    names = F.create_map(*[F.lit(x) for pair in K.DOC_TYPES.items() for x in pair])
    day = block if block is not None else F.floor(F.col("seq") / 10000000000000)
    ranked = blocked_rank(docs.select("record_id", "doc_id", "doc_type", "seq"), ["record_id", "doc_type"], day,
                          ["seq"], "_nth")
    totals = docs.groupBy("record_id", "doc_type").agg(F.count("*").alias("_total"))
    base = F.coalesce(F.try_element_at(names, F.col("doc_type")), F.lit("자료"))
    label = F.when(F.col("_total") > 1, F.concat(base, F.lit(" "), F.col("_nth").cast("string"))).otherwise(base)
    return ranked.join(totals, ["record_id", "doc_type"]).select("record_id", "doc_id", "seq", label.alias("label"))


def sides(facets: DataFrame) -> DataFrame:
    """What each document says, as rows in order of ``seq``."""
    return facets.select(
        "record_id", "facet_id", "doc_id", "seq", F.col("presence").alias("kind"), "status",
        F.when((F.col("presence") == "present") & (F.col("status") != "NOT_APPLICABLE"), F.col("value")).alias("value"),
        F.when(F.col("presence") == "unavailable", F.slice("evidence", 1, 0)).otherwise(F.col("evidence")).alias("evidence"),
        "finding")


def _pairs(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2).cast("bigint")


def facet_relations(facets: DataFrame) -> DataFrame:
    """Relation per record and facet with the number of pairs behind it.

    ``facets``: rows record_id, seq, facet_id, item_id, facet_no, presence, side, comparable,
    grp, val, tax. ``seq`` rises with the order of registration within a record.
    """
    key = ["record_id", "item_id", "facet_id", "facet_no"]
    present = F.col("presence") == "present"
    kind = (
        F.when(~present, F.col("presence")).when(F.col("side") == "vague", "vague").when(F.col("side") == "na", "na")
        .when(F.col("comparable"), "value").otherwise("unreadable"))
    value = kind == "value"
    rows = facets.select(
        *key, "seq", kind.alias("kind"), *[F.when(value, F.col(c)).alias(c) for c in ("grp", "val", "tax")])

    def by_tax(tax: str) -> Column:
        return F.count_if(F.col("tax") == tax)

    # one row per distinct reading; pairs that agree: same value, not one before and one after tax
    values = rows.groupBy(*key, "kind", "grp", "val").agg(
        F.count("*").alias("n"), by_tax("pre").alias("pre"), by_tax("post").alias("post"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    values = values.withColumn("same", F.when(
        F.col("kind") == "value", _pairs(F.col("n")) - F.col("pre") * F.col("post")).otherwise(0))
    groups = values.groupBy(*key, "kind", "grp").agg(
        F.sum("n").alias("n"), F.sum("pre").alias("pre"), F.sum("post").alias("post"), F.sum("same").alias("same"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    groups = groups.withColumn("changed", F.when(
        F.col("kind") == "value", _pairs(F.col("n")) - F.col("pre") * F.col("post") - F.col("same")).otherwise(0))

    def count(*kinds: str) -> Column:
        return F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))

    real = ("vague", "na", "value", "unreadable")
    totals = groups.groupBy(*key).agg(
        F.sum("n").alias("docs"), count(*real).alias("present"), count("na").alias("na"),
        count("value", "unreadable").alias("concrete"), count("unavailable").alias("unavailable"),
        F.sum("same").alias("same_pairs"), F.sum("changed").alias("_changed"),
        F.min(F.when(F.col("kind").isin(*real), F.col("lo"))).alias("first_present"),
        F.min(F.when(F.col("kind") == "missing", F.col("lo"))).alias("first_missing"),
        F.max(F.when(F.col("kind") == "missing", F.col("hi"))).alias("last_missing"),
        F.max("hi").alias("last"))
    totals = totals.withColumn("changed_pairs", F.col("_changed") + F.col("na") * F.col("concrete"))
    totals = totals.withColumn(
        "incomparable_pairs",
        _pairs(F.col("present")) - F.col("same_pairs") - F.col("changed_pairs") - _pairs(F.col("na")))
    relation = (
        F.when(F.col("docs") < 2, F.lit(None).cast("string"))
        .when(F.col("changed_pairs") > 0, "different_stated")
        .when(F.col("incomparable_pairs") > 0, "incomparable")
        .when(F.col("unavailable") > 0, "unavailable")
        .when((F.col("present") > 0) & (F.col("first_missing") < F.col("first_present")), "newly_stated")
        .when((F.col("present") > 0) & (F.col("last_missing") == F.col("last")), "not_mentioned_later")
        .when(F.col("same_pairs") > 0, "same"))
    flag = lambda cond: F.coalesce(cond, F.lit(False))
    return totals.select(
        *key, "docs", F.col("present").alias("present_docs"), "same_pairs", "changed_pairs", "incomparable_pairs",
        (F.col("present") - F.col("na")).alias("stated_docs"), (F.col("unavailable") > 0).alias("any_unavailable"),
        flag((F.col("present") > 0) & (F.col("first_missing") < F.col("first_present"))).alias("newly_stated"),
        flag((F.col("present") > 0) & (F.col("last_missing") == F.col("last"))).alias("not_mentioned_later"),
        relation.alias("relation"))


def item_relations(relations: DataFrame) -> DataFrame:
    """Representative relation per record and item: the first in the order of importance."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(K.RELATION_ORDER))):
        rank = F.when(F.col("relation") == name, i).otherwise(rank)
    names = F.array(*[F.lit(r) for r in K.RELATION_ORDER])
    return relations.groupBy("record_id", "item_id").agg(F.min(rank).alias("_rank")).select(
        "record_id", "item_id", F.get(names, F.col("_rank")).alias("relation"))
