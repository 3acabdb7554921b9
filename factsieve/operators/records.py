"""Current state of records from an event log (last event wins per key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.packs import korean as K


def fold_record_events(events: DataFrame) -> dict[str, DataFrame]:
    """records, documents, notes (L1).

    A record lives from its first ``create`` to its ``delete_record``; events outside are
    ignored. All three tables are aggregations that combine before the shuffle.
    """
    order = F.struct("event_time", "event_id")
    life = events.groupBy("record_id").agg(
        F.min(F.when(F.col("op") == "create", order)).alias("_born"),
        F.max(F.when(F.col("op") == "delete_record", order)).alias("_dead"))
    alive = events.join(life, "record_id").filter(F.col("_born").isNotNull() & F.col("_dead").isNull() & (order >= F.col("_born")))
    head_ops = ["create", "add_document", "replace_analysis", "rename", "save_note", "delete_note"]
    clean = F.nullif(F.substring(F.trim(F.col("alias")), 1, K.ALIAS_MAX), F.lit(""))
    records = alive.filter(F.col("op").isin(head_ops)).groupBy("record_id").agg(
        F.coalesce(F.max_by(clean, F.when(F.col("op").isin("create", "rename"), order)), F.lit(K.DEFAULT_ALIAS)).alias("alias"),
        F.min("event_time").alias("created_at"), F.max("event_time").alias("updated_at"))
    documents = alive.filter(F.col("op").isin("create", "add_document") & F.col("doc_id").isNotNull()).groupBy(
        "record_id", "doc_id").agg(F.max("event_time").alias("registered_at"), F.max(order)["event_id"].alias("seq"))
    noted = alive.filter(F.col("op").isin("save_note", "delete_note") & F.col("note_id").isNotNull()).groupBy(
        "record_id", "note_id").agg(
        F.max_by("op", order).alias("_op"),
        F.max_by(F.substring("text", 1, K.NOTE_MAX), F.when(F.col("op") == "save_note", order)).alias("text"),
        F.min(F.when(F.col("op") == "save_note", F.col("event_time"))).alias("created_at"),
        F.max("event_time").alias("updated_at"))
    notes = noted.filter((F.col("_op") == "save_note") & (F.trim("text") != "")).drop("_op")
    return {"records": records, "documents": documents, "notes": notes}


def delete_records(tables: dict[str, DataFrame], tombstones: DataFrame) -> dict[str, DataFrame]:
    """Take deleted records out of every table (L2)."""
    gone = tombstones.select("record_id").distinct()
    return {name: df.join(gone, "record_id", "left_anti") for name, df in tables.items()}


def list_records(tables: dict[str, DataFrame]) -> DataFrame:
    """Records with their numbers of documents and notes (L3). Order by updated_at for display."""
    docs = tables["documents"].groupBy("record_id").agg(F.count("*").alias("documents"))
    notes = tables["notes"].groupBy("record_id").agg(F.count("*").alias("notes"))
    out = tables["records"].join(docs, "record_id", "left").join(notes, "record_id", "left")
    return out.fillna(0, ["documents", "notes"])
