"""Stored extraction responses and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve import schemas


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Document entries with an explicit layout."""
    return spark.read.schema(schemas.DOCUMENTS).format(fmt).load(path)


def parse_extractions(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``claims`` and ``call_error`` to stored responses (S3).

    Not JSON: ``call_error`` is set. JSON of another shape: ``claims`` is null, which the
    verifier reports as a malformed response for every criterion.
    """
    parsed = F.from_json(F.col(body), schemas.RESPONSE_BODY)
    rows = raw.withColumn("_ok", F.try_parse_json(F.col(body)).isNotNull()).withColumn("_body", parsed)
    claims = F.transform("_body.criteria", lambda c: F.struct(
        c["id"].alias("criterion_id"), *[c[n].alias(n) for n in (
            "finding", "quotes", "source_value", "term_type", "value_kind", "calc")]))
    return rows.withColumns({
        "claims": F.when(F.col("_ok"), claims),
        "call_error": F.when(~F.col("_ok"), "ai_call_failed:invalid_json")}).drop("_ok", "_body", body)


def response_extractor(responses: DataFrame):
    """An extractor that takes stored responses: one equi-join on doc_id."""
    parsed = parse_extractions(responses).select("doc_id", "claims", "call_error")
    return lambda docs: docs.join(parsed, "doc_id", "left")
