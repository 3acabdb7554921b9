"""Result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: What is known of a bucket: its rows and the sum of their hashes, which does not depend on their order.
COUNTS = "bucket int, rows long, checksum decimal(38,0)"


def _row_hash(columns: list[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*columns)))


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = 64) -> DataFrame:
    """Write ``df`` in hash buckets of ``key``; returns ``COUNTS`` of what the writing tasks handed over, empty buckets left out.

    The figures are observed in the stage that writes, so they cost no second pass and do not depend on what arrives in the folder. They
    reach the driver as two numbers a bucket. A null key has a bucket like any other.
    """
    out = df.withColumn("row_hash", _row_hash(df.columns)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    seen = Observation()
    figures = []
    for b in range(buckets):
        mine = F.col("bucket") == b
        figures += [F.count_if(mine).alias(f"n{b}"), F.sum(F.when(mine, F.col("row_hash").cast("decimal(20,0)"))).alias(f"h{b}")]
    out.observe(seen, *figures).write.partitionBy("bucket").mode("errorifexists").parquet(path)
    got = seen.get
    return df.sparkSession.createDataFrame([(b, got[f"n{b}"], got[f"h{b}"]) for b in range(buckets) if got[f"n{b}"]], COUNTS)


def audit_buckets(counts: DataFrame, path: str, columns: DataFrame) -> DataFrame:
    """Per bucket: rows written, rows_read, equal (rows whose hash still fits their values) and whether all is as it was written.

    ``counts`` comes from ``write_buckets``, ``columns`` is any DataFrame with the schema that was written. A bucket that is lost, short, doubled
    or changed is not ``ok``, nor is one that nobody wrote.
    """
    schema = columns.withColumn("row_hash", F.lit(0).cast("long")).withColumn("bucket", F.lit(0)).schema
    back = columns.sparkSession.read.schema(schema).parquet(path)
    fits = _row_hash(columns.columns) == F.col("row_hash")
    read = back.groupBy("bucket").agg(F.count("*").alias("rows_read"), F.count_if(fits).alias("equal"),
                                      F.sum(F.col("row_hash").cast("decimal(20,0)")).alias("checksum_read"))
    both = counts.join(read, "bucket", "full")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    ok = (F.col("rows") == F.col("rows_read")) & (F.col("rows") == F.col("equal")) & (F.col("checksum") == F.col("checksum_read"))
    return both.select("bucket", zero("rows"), zero("rows_read"), zero("equal"), F.coalesce(ok, F.lit(False)).alias("ok"))


def write_results(df: DataFrame, path: str, key: str, buckets: int = 64) -> DataFrame:
    """Write a result table in hash buckets, read it back and hold it against what was written (S15): see ``audit_buckets``."""
    return audit_buckets(write_buckets(df, path, key, buckets), path, df)


def report_tables(match: DataFrame, path: str) -> None:
    """Summary of an evaluation run: numbers and codes only, no text."""
    plain = [f.name for f in match.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    match.select(*plain).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
