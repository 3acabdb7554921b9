"""From documents to packed training sequences: language, copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns they were given, extra ones too. Documents are named by doc_id: rows without an id cannot be named and are never dropped by
the two dedup stages; rows that repeat an id share its fate. An empty table gives an empty table of the stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.llm import exact_dedup, langid, mixing, ngram_join, packing
from factsieve.llm.common import table, written

#: Mean probability of the chosen language under which no language prevails in a document.
LEAST_SCORE = 0.3

#: A conditional random field stands at the start, so SQL cannot give the rows of ``run``; tests/llm holds them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language prevails; texts that are null, empty or without letters go."""
    kept = langid.label(docs.withColumnsRenamed({c: f"own_{c}" for c in ("lang_pred", "score") if c in docs.columns}), langid.fit(docs))
    kept = kept.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    dropped = exact_dedup.exact_dedup(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id."""
    dropped = ngram_join.join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    own = docs.toDF(*[f"own_{c}" for c in docs.columns])  # the names of the mix cannot clash
    rows = own.join(taken, F.col("own_doc_id").eqNullSafe(F.col("taken_id")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the sequences that hold them."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
