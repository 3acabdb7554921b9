"""Exact dedup by a tree-merge of digest runs.

Each partition reduces its rows to a sorted run of (digest, best id, count). Runs are numbered in base ``FAN``.
In a round, run r keeps the entries whose digest has r's digit at the round's place and hands the others to the
``FAN - 1`` runs that differ from it in that digit only (a binomial exchange with several partners). The receiver
merges the sorted runs it got and keeps one entry a digest. After all rounds a run's number is spelled by the digest,
so all copies of a text have met. A text held by a third of all rows is one entry a run from the first level on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.common import ascii_lower, table, written

#: Runs that meet in one merge, as a power of two.
FAN_BITS = 3


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the normalised text in UTF-8) and an independent check value (xxhash64 and byte length)."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").alias("bytes")
    )


def merged_runs(leaf: DataFrame, keep: str = "max") -> DataFrame:
    """One row a text: digest, check, bytes, keep_id, group_size.

    Entries are merged only if digest, check and length all agree, at every level, so texts that merely share a digest stay
    apart. The id that stays is kept as a struct, which Spark cannot update in a hash table: every level sorts its run by (run, digest, check,
    bytes) and folds neighbours as they pass, so memory does not grow with the number of texts and a run that is too long spills as
    sorted pieces that are merged. It costs a sort of the entries a level. ``keep`` says which id stays: ``max`` or ``min``. The number of runs is the power of the fan that reaches
    ``spark.sql.shuffle.partitions``.
    """
    best = F.max if keep == "max" else F.min
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id"))  # null ids take no part
    partitions = int(leaf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while (1 << (FAN_BITS * rounds)) < partitions:
        rounds += 1
    runs = 1 << (FAN_BITS * rounds)
    entry = ["digest", "check", "bytes"]
    level = (
        leaf.withColumn("run", F.spark_partition_id() % runs)
        .groupBy("run", *entry)
        .agg(best(named).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    for k in range(rounds):
        digit = ((1 << FAN_BITS) - 1) << (FAN_BITS * k)
        low = F.pmod(F.col("check"), F.lit(runs)).cast("int")
        level = (
            level.withColumn("run", F.col("run").bitwiseAND(F.lit(runs - 1 - digit)).bitwiseOR(low.bitwiseAND(F.lit(digit))))
            .repartition(runs, "run")
            .groupBy("run", *entry)
            .agg(best("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        )
    return level.select(*entry, F.col("keep.doc_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; null counts as the empty text, and empty texts are a group
    of their own. A null id never beats another id; in a group of null ids alone keep_id is null and all rows stay. Rows that
    repeat the id which stays all have ``kept``: they are told apart by nothing. Other columns of ``docs`` are ignored.
    """
    leaf = written(digests(docs, id_col, text_col), "digests")
    best = merged_runs(leaf, keep)
    return leaf.join(best, ["digest", "check", "bytes"], "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
