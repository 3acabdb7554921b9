"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of times each of its documents is wanted. The whole part is certain: that many
copies of every document. The rest is an inclusion probability, met by one Pareto sample per source: documents are ordered by
random odds over inclusion odds, and the first ones that fill the words still missing get one more copy. The sample's size is
fixed in words, so a source misses its target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.common import table, word_count

#: Weights by place of the source in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of all documents; copies of a document at most.
SHARE, COPIES = 1.5, 2
#: Cells in which the order of a source is kept, so that no task sorts a whole source.
CELLS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """nul, src, source_size, target from rows (nul, src, size).

    Filling up by weight: sources in order of limit over weight; the first one that its part of what is left cannot
    fill fixes the level of it and all later ones. One row a source goes through a global window, no row of a document.
    """
    order = Window.orderBy("nul", "src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("nul", "src").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(copies)))
    rise = Window.orderBy((F.col("cap") / F.col("w")).asc(), "nul", "src")
    s = s.withColumns({
        "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(share),
        "before": F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("w").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    s = s.withColumn("open", F.col("cap") * F.col("left") > (F.col("budget") - F.col("before")) * F.col("w"))
    level = F.min(F.when(F.col("open"), F.struct("before", "left"))).over(Window.partitionBy())
    s = s.withColumn("level", level)
    # before grows with the order, so the least struct among the open ones is that of the first
    target = F.when(F.col("open"), F.col("w") * (F.col("budget") - F.col("level.before")) / F.col("level.left")).otherwise(F.col("cap"))
    return s.select("nul", "src", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, cells: int = CELLS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Sizes are words; null and empty texts have size 0 and take nothing. A null source is a source of its own, the last one.
    Random numbers come from MD5 of seed and id, so reruns agree; rows of equal id and source are taken in order of
    size. Other columns are ignored; an empty table gives no rows.
    """
    d = docs.select("doc_id", F.col("source").isNull().cast("int").alias("nul"), F.coalesce("source", F.lit("")).alias("src"), word_count(F.col("text")).alias("size"))
    targets = source_targets(d.select("nul", "src", "size"), weights, share, copies)
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    d = d.withColumn("u", (bits.cast("double") + 0.5) / F.lit(float(1 << 52)))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = d.join(targets, ["nul", "src"]).withColumn("wanted", wanted).withColumn("whole", F.floor("wanted").cast("long"))
    d = d.withColumn("p", F.col("wanted") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    d = d.withColumn("place", F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.col("u")))
    cell = ["nul", "src", "cell"]
    d = d.withColumn("cell", F.floor(F.col("place") * cells)).repartition(*cell)  # else the order of a whole source can end in one task
    inner = Window.partitionBy(*cell).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(inner))
    per_cell = d.groupBy(*cell).agg(F.sum("size").alias("cell_size"))
    earlier = Window.partitionBy("nul", "src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.select(*cell, F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("start"))
    d = d.join(starts, cell)
    missing = F.col("target") - F.col("whole") * F.col("source_size")
    more = (F.col("p") > 0) & (F.col("start") + F.col("upto") - F.col("size") / 2 <= missing)
    d = d.withColumn("copies", F.col("whole") + more.cast("long"))
    return d.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, (SELECT sum(source_size) * 1.5::DOUBLE FROM s) AS budget,
        coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
o AS (SELECT *, cap * rest > (budget - before) * w AS open FROM r),
t AS (SELECT source, source_size,
        CASE WHEN open THEN w * (budget - min(before) FILTER (WHERE open) OVER ()) / max(rest) FILTER (WHERE open) OVER () ELSE cap END AS target FROM o),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS wanted,
        (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(wanted)::BIGINT AS whole, wanted - floor(wanted) AS p FROM e),
g AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 0 END AS odds FROM f),
h AS (SELECT *, CASE WHEN p > 0 THEN odds / (1 + odds) ELSE u END AS place FROM g),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM h),
c AS (SELECT *, whole + (p > 0 AND upto - size / 2.0::DOUBLE <= target - whole * source_size)::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
