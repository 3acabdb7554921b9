"""Jobs over rows that arrive over time.

The late policy is ours: rows behind the watermark are dropped. Every sink writes one
folder per micro-batch in overwrite mode, so a batch that is run again after a failure
replaces its own output and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factsieve.operators import facets, relate, segment, status, verify
from factsieve.operators.editmap import Confirm, Edit, after_events
from factsieve.operators.extract import extract, rule_extractor
from factsieve.operators.spans import SPANS_AFTER, as_span, span_frame
from factsieve.operators.usage import PER_KEY, WINDOW_MS, decide
from factsieve.packs import rule_pack


class Limiter(StatefulProcessor):
    """Sequential admission per key; the state is at most ``limit`` times."""

    def __init__(self, limit: int = PER_KEY, window_ms: int = WINDOW_MS):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        times = [int(t) for t in self.times.get()[0]] if self.times.exists() else []
        ok, wait = [], []
        for now, cost in zip(batch["ms"].tolist(), batch["cost"].tolist()):
            times, admitted, seconds = decide(times, now, cost, self.limit, self.window_ms)
            ok.append(admitted)
            wait.append(seconds)
        self.times.update((times,))
        out = batch[["event_id", "ms", "cost"]].copy()
        out.insert(0, "ip", key[0])
        out["admitted"], out["retry_after_sec"] = ok, pd.array(wait, dtype="Int64")
        yield out

    def close(self) -> None:
        pass


def admit_stream(hits: DataFrame, limit: int = PER_KEY, window_ms: int = WINDOW_MS) -> DataFrame:
    """Decisions for a stream of hits (M4): ip, event_id, ms, cost. Needs the RocksDB state store.

    A micro-batch is decided in order of time; keep batches shorter than the lateness you expect.
    """
    return hits.select("ip", "event_id", "ms", "cost").groupBy("ip").transformWithStateInPandas(
        Limiter(limit, window_ms), "ip string, event_id bigint, ms bigint, cost int, admitted boolean, retry_after_sec bigint",
        "Append", "None")


class SpanKeeper(StatefulProcessor):
    """Spans of one document, carried from edit to edit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getValueState("spans", "spans string, next_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live, next_id, events = [], 1, []
        if self.spans.exists():
            held = self.spans.get()
            live, next_id = json.loads(held[0]), int(held[1])
        for r in pd.concat(list(rows)).sort_values(["rev", "span_id"]).itertuples(index=False):
            if r.rev < 0:
                live.append(as_span(r))
                next_id = max(next_id, int(r.span_id) + 1)
            elif r.kind == "confirm":
                events.append(Confirm(len(events), int(r.span_id)))
            elif not pd.isna(r.start):  # an edit without a region changes nothing
                events.append(Edit(len(events), int(r.start), int(r.end), r.text or ""))
        live, next_id = after_events(live, next_id, events)
        self.spans.update((json.dumps(live), next_id))
        yield span_frame(key[0], live)

    def close(self) -> None:
        pass


def span_stream(rows: DataFrame) -> DataFrame:
    """Spans after each micro-batch (P3, P4): doc_id, rev (-1 seeds a span), span_id, kind, state, start, end, new_end, text.

    A row of kind ``confirm`` settles the span ``span_id`` at its ``rev``; any other row with a rev of 0 or more replaces start to end by text.
    """
    return rows.groupBy("doc_id").transformWithStateInPandas(SpanKeeper(), SPANS_AFTER, "Append", "None")


def run_metrics(log: DataFrame, ts: str = "ts", kind: str = "code", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per code and time window (M6)."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(kind)).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), F.col(kind), "n")


def analyse(docs: DataFrame, pack_name: str = "employment_ko") -> DataFrame:
    """Documents to evaluated rows with facets: the same code for batch and stream."""
    pack = rule_pack(pack_name)
    rows = extract(segment.with_lines(docs), rule_extractor(pack))
    rows = verify.merge_second_pass(verify.plan_holds(verify.verify(rows, pack), pack), None)
    return facets.with_facets(status.evaluate(rows, pack), pack)


def documents_stream(docs: DataFrame, path: str, checkpoint: str):
    """Analyse documents as they arrive and relate the touched records anew (M5).

    Writes ``facets/batch=N`` (this batch's documents) and ``relations/batch=N`` (all touched
    records); of several relations of one record the highest batch counts.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = facets.facet_values(analyse(batch), "record_id", "doc_id", "seq", "doc_type")
        here = f"{path}/facets/batch={batch_id}"
        mine.write.mode("overwrite").parquet(here)
        known = spark.read.option("basePath", f"{path}/facets").parquet(f"{path}/facets").filter(F.col("batch") <= batch_id)
        touched = spark.read.parquet(here).select("record_id").distinct()
        latest = known.join(touched, "record_id", "left_semi")
        relate.facet_relations(latest).write.mode("overwrite").parquet(f"{path}/relations/batch={batch_id}")

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_relations(spark, path: str) -> DataFrame:
    """Relations of the latest batch that touched each record."""
    every = spark.read.option("basePath", f"{path}/relations").parquet(f"{path}/relations")
    last = every.groupBy("record_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["record_id", "batch"], "left_semi").drop("batch")
