"""Audit of request limits over an unfiltered log.

A trailing window never sorts a whole key: costs are added up per millisecond first, and
each row is also handed to the following minute, so every (key, minute) is complete on its
own. Rows of one millisecond count in the order of ``event_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The limits that are audited
PER_KEY, GLOBAL_PER_MINUTE, GLOBAL_PER_DAY, WINDOW_MS = 5, 4, 100, 60_000


def with_ms(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``ms``. A timestamp without a zone is read as UTC, whatever zone the session has."""
    if dict(log.dtypes)[ts] == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return log.withColumn("ms", F.timestamp_diff("MILLISECOND", epoch, F.col(ts)))
    return log.withColumn("ms", F.unix_millis(F.col(ts)))


def _trailing(log: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Adds ``used``: cost within the window up to and including each row."""
    per_ms = log.groupBy(*keys, "ms").agg(F.sum("cost").alias("cost"))
    minute = F.floor(F.col("ms") / window_ms)
    spread = per_ms.withColumn("_slot", F.explode(F.array(minute, minute + 1)))
    back = Window.partitionBy(*keys, "_slot").orderBy("ms").rangeBetween(-(window_ms - 1), -1)
    earlier = spread.withColumn("_earlier", F.coalesce(F.sum("cost").over(back), F.lit(0)))
    earlier = earlier.filter(F.col("_slot") == minute).select(*keys, "ms", "_earlier")
    same = Window.partitionBy(*keys, "ms").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        log.withColumn("_own", F.sum("cost").over(same)).join(earlier, [*keys, "ms"])
        .withColumn("used", F.col("_earlier") + F.col("_own")).drop("_own", "_earlier"))


def ip_usage(log: DataFrame, limit: int = PER_KEY, window_ms: int = WINDOW_MS) -> DataFrame:
    return _trailing(log, ["ip"], window_ms).withColumn("over_limit", F.col("used") > limit)


def global_usage(log: DataFrame, limit: int = GLOBAL_PER_MINUTE, window_ms: int = WINDOW_MS) -> DataFrame:
    return _trailing(log, [], window_ms).withColumn("over_limit", F.col("used") > limit)


def daily_usage(log: DataFrame, limit: int = GLOBAL_PER_DAY) -> DataFrame:
    """Running cost per UTC day and seconds until the next day. Days are scanned second by second."""
    day_ms = 86_400_000
    rows = log.withColumn("day", F.floor(F.col("ms") / day_ms)).withColumn("_sec", F.floor(F.col("ms") / 1000))
    per_sec = rows.groupBy("day", "_sec").agg(F.sum("cost").alias("_cost"))
    before = Window.partitionBy("day").orderBy("_sec").rowsBetween(Window.unboundedPreceding, -1)
    per_sec = per_sec.select("day", "_sec", F.coalesce(F.sum("_cost").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("day", "_sec").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    used = rows.withColumn("_own", F.sum("cost").over(local)).join(per_sec, ["day", "_sec"])
    return used.withColumn("used", F.col("_before") + F.col("_own")).withColumns({
        "over_limit": F.col("used") > limit,
        "retry_after_sec": F.ceil(((F.col("day") + 1) * day_ms - F.col("ms")) / 1000),
    }).drop("_own", "_before", "_sec")


def decide(times: list[int], now: int, cost: int, limit: int, window_ms: int) -> tuple[list[int], bool, int | None]:
    """One step of the limiter: (times kept, admitted, seconds to wait). A refused hit is not recorded."""
    times = [t for t in times if now - t < window_ms]
    if len(times) + cost > limit:
        oldest = times[0] if times else now
        return times, False, -(-(window_ms - (now - oldest)) // 1000)
    return times + [now] * cost, True, None


def admit_batch(log: DataFrame, limit: int = PER_KEY, window_ms: int = WINDOW_MS, slice_ms: int = 3_600_000,
                max_rounds: int = 1000) -> DataFrame:
    """Which hits a per-key limiter admits (batch twin of the stream, M4).

    The decision depends on the ones before it, so each key is cut into time slices that run
    side by side from an assumed state; slices whose assumed state was wrong run again until
    none is. The state is at most ``limit`` times, so slices agree after few rounds.
    """
    from factsieve.session import cut_lineage

    import pandas as pd

    rows = log.withColumn("slice", F.floor(F.col("ms") / slice_ms)).select("ip", "slice", "event_id", "ms", "cost")
    schema = "ip string, slice bigint, event_id bigint, ms bigint, cost int, admitted boolean, retry_after_sec bigint, carry array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Slices one after the other, as they stand in the partition; ``carry`` is the state after each row."""
        key, times = None, []
        for batch in batches:
            ok, wait, carry = [], [], []
            for ip, part, now, cost, given in zip(*(batch[c].tolist() for c in ("ip", "slice", "ms", "cost", "carry_in")), strict=True):
                if (ip, part) != key:
                    key, times = (ip, part), [] if given is None else [int(t) for t in given]
                times, admitted, seconds = decide(times, now, cost, limit, window_ms)
                ok.append(admitted)
                wait.append(seconds)
                carry.append(times)
            out = batch[["ip", "slice", "event_id", "ms", "cost"]].copy()
            out["admitted"], out["retry_after_sec"] = ok, pd.array(wait, dtype="Int64")
            out["carry"] = pd.Series(carry, index=out.index, dtype=object)
            yield out

    def decided(rows: DataFrame) -> DataFrame:
        return rows.repartition("ip", "slice").sortWithinPartitions("ip", "slice", "ms", "event_id").mapInPandas(run, schema)

    empty = F.array().cast("array<bigint>")
    chain = Window.partitionBy("ip").orderBy("slice")
    done = cut_lineage(decided(rows.withColumn("carry_in", empty)), "admit")
    assumed = done.select("ip", "slice").distinct().withColumn("carry_in", empty)
    for _ in range(max_rounds):
        ends = done.groupBy("ip", "slice").agg(F.max_by("carry", F.struct("ms", "event_id")).alias("carry"))
        due = F.filter(F.lag("carry").over(chain), lambda t: t > F.col("slice") * slice_ms - window_ms)
        wanted = ends.select("ip", "slice", F.coalesce(due, empty).alias("carry_in"))
        wanted = cut_lineage(wanted, "carry")
        wrong = wanted.alias("w").join(assumed.alias("a"), ["ip", "slice"]).filter("w.carry_in <> a.carry_in").select(
            "ip", "slice", "w.carry_in")
        if wrong.isEmpty():
            return done.drop("carry", "slice")
        again = decided(rows.join(wrong, ["ip", "slice"]))
        done = cut_lineage(done.join(wrong, ["ip", "slice"], "left_anti").unionByName(again), "admit")
        assumed = wanted
    raise RuntimeError(f"slices did not agree after {max_rounds} rounds; use longer slices")
