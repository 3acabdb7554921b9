"""Merging of ranges on a line, per key, without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_intervals(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                    block: float = 4096, gap: Column | float = 0, touching: bool = True) -> DataFrame:
    """Islands of ranges per key (P5): keys, start, end.

    Ranges join an island if they begin no further than ``gap`` behind its end (at exactly
    that distance only with ``touching``). The line is cut into blocks; each block is scanned
    on its own and what reaches over from earlier blocks is carried by one row per block.
    """
    s, e = F.col(start), F.col(end)
    rows = ranges.filter(e > s).withColumn("_block", F.floor(s / block))
    local = Window.partitionBy(*keys, "_block").orderBy(start, end)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*keys, "_block").agg(F.max(e).alias("_far"))
    reach = reach.select(*keys, "_block", F.max("_far").over(across).alias("_carry"))
    seen = F.greatest(F.col("_carry"), F.max(e).over(local.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.join(reach, [*keys, "_block"]).withColumn("_seen", seen)
    limit = F.col("_seen") + (gap if isinstance(gap, Column) else F.lit(gap))
    fresh = F.col("_seen").isNull() | ((s > limit) if touching else (s >= limit))
    marked = marked.withColumn("_head", F.when(fresh, s))
    heads = marked.groupBy(*keys, "_block").agg(F.max("_head").alias("_last"))
    heads = heads.select(*keys, "_block", F.max("_last").over(across).alias("_before"))
    own = F.max("_head").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    islands = marked.withColumn("_own", own).join(heads, [*keys, "_block"])
    return (
        islands.withColumn("_island", F.coalesce("_own", "_before"))
        .groupBy(*keys, "_island").agg(F.max(e).alias(end))
        .withColumnRenamed("_island", start).select(*keys, start, end))


def merge_few(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: Column | float = 0, touching: bool = True) -> DataFrame:
    """The islands of ``merge_intervals`` for keys with a bounded number of distinct ranges, such as places on a page.

    Equal ranges fall together before the shuffle; the distinct ones of a key are scanned once, in order, so the input is read once.
    """
    s, e = F.col(start), F.col(end)
    rows = ranges.filter(e > s).select(*keys, s, e).distinct()
    order = Window.partitionBy(*keys).orderBy(start, end)
    limit = F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1)) + (gap if isinstance(gap, Column) else F.lit(gap))
    head = F.when(limit.isNull() | ((s > limit) if touching else (s >= limit)), s)
    islands = rows.withColumn("_head", head).withColumn("_island", F.max("_head").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*keys, "_island").agg(F.max(e).alias(end)).withColumnRenamed("_island", start).select(*keys, start, end)
