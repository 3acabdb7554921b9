"""What several of the operators need: tables, the shared folder and word rules."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the controls 09 to 0D.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is never reused."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, readable after the loss of any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else as it is. ``lower`` does the same for texts of one byte a character, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANKS))).cast("long")


#: Size of a bit filter in words of 64 bits (1 MB). It never grows: a full filter lets everything pass and only saves nothing.
FILTER_WORDS = 1 << 17


def bit_table(keys: DataFrame, column: str) -> DataFrame:
    """filter_word, filter_bits: bits set at the hashed places of a column of longs; at most ``FILTER_WORDS`` rows."""
    h = keys.select(filter_place(column).alias("h"))
    return h.groupBy(F.expr("h div 64").alias("filter_word")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 AS int)))").alias("filter_bits"))


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """As ``bit_table``, collected: at most ``FILTER_WORDS`` rows reach the driver."""
    words = np.zeros(FILTER_WORDS, np.uint64)
    for r in bit_table(keys, column).collect():
        words[r["filter_word"]] = np.uint64(r["filter_bits"] & 0xFFFFFFFFFFFFFFFF)
    return words


def that_may_be_in(df: DataFrame, bits: DataFrame, column: str, hit: bool = True) -> DataFrame:
    """Rows whose column is set in the bits (a ``bit_table``), or the others. Rows stay in the JVM; the bits are broadcast, a few MB at most."""
    place = filter_place(column)
    same = (F.expr("filter_word") == F.shiftright(place, 6)) & (F.getbit(F.expr("filter_bits"), (place % 64).cast("int")) == 1)
    return df.join(F.broadcast(bits), same, "left_semi" if hit else "left_anti")


def filter_place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_WORDS * 64))


def may_hold(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the places (values of ``filter_place``) are set."""
    return (words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
