"""Coalescing of changes per key: one work item per burst, with a cap on its delay.

A change schedules work for the key: one tick later, or for transfers five ticks
after the last one but no later than twenty after the first. Work is claimed at
the end of the tick it is due, and a change up to that tick joins it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from stowfind.operators.ordered import neighbour, running_total

# Delays in ticks.
SNAPSHOT_DELAY = 1
TRANSFER_DELAY = 5
TRANSFER_CAP = 20

# The key of rows that only move time on; null would turn the keys beside it into floating-point numbers.
CLOSING = -(1 << 63)
FEED = "key long, ts timestamp, seq long, kind string"
WORK = "key long, start_tick long, claim_tick long, revision long, action string, events long"


def due_tick(kind: str, tick: int, start: int) -> int:
    due = min(tick + TRANSFER_DELAY, start + TRANSFER_CAP) if kind == "transfer" else tick + SNAPSHOT_DELAY
    return max(due, tick)


def per_tick(changes: DataFrame) -> DataFrame:
    """One row per key and tick: its last kind and its number of changes."""
    return changes.groupBy("key", "tick").agg(
        F.max_by("kind", "seq").alias("kind"), F.count(F.lit(1)).alias("n"))


def islands(ticks: DataFrame, chunk_ticks: int) -> DataFrame:
    """Add revision and island number per key.

    A gap longer than the last change's own delay always ends a burst, whatever
    came before, so islands between such gaps are independent of each other.
    """
    chunk = F.floor(F.col("tick") / chunk_ticks)
    order = ["tick"]
    seen = running_total(ticks, ["key"], order, chunk, F.col("n"), "revision")
    seen = seen.withColumn("_me", F.struct("tick", "kind"))
    seen = neighbour(seen, ["key"], order, chunk, "_me", "_before", ahead=False)
    delay = F.when(F.col("_before.kind") == "transfer", TRANSFER_DELAY).otherwise(SNAPSHOT_DELAY)
    fresh = F.col("_before").isNull() | (F.col("tick") - F.col("_before.tick") > delay)
    return running_total(seen, ["key"], order, chunk, fresh.cast("long"), "island").drop("_me", "_before")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bursts of rows sorted by key, island and tick; the state is one open burst."""
    columns = ["key", "start_tick", "claim_tick", "revision", "action", "events"]
    island, work = None, None
    for batch in batches:
        done = []
        for key, number, tick, kind, n, revision in zip(
                *(batch[c] for c in ("key", "island", "tick", "kind", "n", "revision"))):
            if (key, number) != island or tick > work[2]:
                if work is not None:
                    done.append(work)
                island, work = (key, number), (key, tick, tick, 0, "", 0)
            start = work[1]
            action = "DELETE" if kind == "delete" else "SNAPSHOT"
            work = (key, start, due_tick(kind, tick, start), revision, action, work[5] + n)
        yield pd.DataFrame(done, columns=columns)
    if work is not None:
        yield pd.DataFrame([work], columns=columns)


def coalesce(changes: DataFrame, chunk_ticks: int = 12_000) -> DataFrame:
    """Work items of a change table (key, tick, seq, kind).

    Islands that fit under the cap are one burst and come from an aggregation.
    Longer ones are folded in tick order from sorted partitions, which holds one
    open burst in memory and spreads the islands of a hot key over tasks.
    """
    rows = islands(per_tick(changes), chunk_ticks)
    whole = rows.groupBy("key", "island").agg(
        F.min("tick").alias("start_tick"), F.max("tick").alias("last_tick"),
        F.max_by("kind", "tick").alias("kind"), F.max("revision").alias("revision"),
        F.sum("n").alias("events"))
    start, last = F.col("start_tick"), F.col("last_tick")
    due = F.when(F.col("kind") == "transfer", F.least(last + TRANSFER_DELAY, start + TRANSFER_CAP)) \
        .otherwise(last + SNAPSHOT_DELAY)
    short = whole.filter(last - start <= TRANSFER_CAP).select(
        "key", "start_tick", F.greatest(due, last).alias("claim_tick"), "revision",
        F.when(F.col("kind") == "delete", "DELETE").otherwise("SNAPSHOT").alias("action"), "events")
    long = whole.filter(last - start > TRANSFER_CAP).select("key", "island")
    folded = (
        rows.join(long, ["key", "island"], "left_semi")
        .select("key", "island", "tick", "kind", "n", "revision")
        .repartition("key", "island").sortWithinPartitions("key", "island", "tick")
        .mapInPandas(_fold, WORK))
    return short.unionByName(folded)


class Debouncer(StatefulProcessor):
    """Open bursts of a bucket of keys; ticks arrive complete and in order of the watermark.

    A call to the state is a message between processes, so a bucket's keys are read and written together.
    """

    COLUMNS = ["key", "start", "claim", "kind", "revision", "events"]

    def __init__(self, tick_ms: int):
        self.tick_ms = tick_ms

    def init(self, handle) -> None:
        self.handle = handle
        # A key without an open burst keeps its revision and has no start.
        self.works = handle.getValueState(
            "works", "key array<long>, start array<long>, claim array<long>, kind array<string>, "
                     "revision array<long>, events array<long>")

    def _read(self) -> dict[int, tuple]:
        held = self.works.get()
        return {} if held is None else {key: tuple(work) for key, *work in zip(*held)}

    def _write(self, works: dict[int, tuple], watermark: int) -> None:
        """Keep the bursts and wake up when the first of them is due."""
        self.works.update(tuple(map(list, zip(*((key, *work) for key, work in works.items())))))
        claims = [claim for start, claim, *_ in works.values() if start is not None]
        if claims:
            # A timer that is due already would lie behind the watermark, where timers are no longer looked for.
            self.handle.registerTimer(max((min(claims) + 1) * self.tick_ms, watermark + 1))

    @staticmethod
    def _rows(done: list[tuple]) -> pd.DataFrame:
        """Work items of bursts (key, start, claim, kind, revision, events)."""
        rows = [(key, start, claim, revision, "DELETE" if kind == "delete" else "SNAPSHOT", events)
                for key, start, claim, kind, revision, events in done]
        return pd.DataFrame(rows, columns=["key", "start_tick", "claim_tick", "revision", "action", "events"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows)).sort_values(["key", "tick"])
        works, done = self._read(), []
        for k, tick, kind, n in zip(*(ticks[c].tolist() for c in ("key", "tick", "kind", "n"))):
            start, claim, last, revision, events = works.get(k, (None, None, None, 0, 0))
            if start is not None and tick > claim:
                done.append((k, start, claim, last, revision, events))
                start = None
            if start is None:
                start, events = tick, 0
            works[k] = (start, due_tick(kind, tick, start), kind, revision + n, events + n)
        self._write(works, timerValues.getCurrentWatermarkInMs())
        if done:
            yield self._rows(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        works, done, watermark = self._read(), [], timerValues.getCurrentWatermarkInMs()
        for k, (start, claim, kind, revision, events) in works.items():
            if start is not None and (claim + 1) * self.tick_ms <= watermark:
                done.append((k, start, claim, kind, revision, events))
                works[k] = (None, None, None, revision, 0)
        if done:
            self._write(works, watermark)
            yield self._rows(done)

    def close(self) -> None:
        pass


def closing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of rows that only move time on, from a folder that ``close_feed`` writes to."""
    return spark.readStream.schema(FEED).parquet(folder)


def close_feed(spark: SparkSession, folder: str, times: list[int]) -> None:
    """Add rows of no real key at the given times (milliseconds), one file for each."""
    for at in times:
        spark.range(1).select(F.lit(CLOSING).alias("key"), F.timestamp_millis(F.lit(at)).alias("ts"),
                              F.lit(0).cast("long").alias("seq"), F.lit("dirty").alias("kind")
                              ).write.mode("append").parquet(folder)


def coalesce_stream(changes: DataFrame, tick_ms: int = 50, lateness: str = "10 seconds",
                    buckets: int = 64) -> DataFrame:
    """Streaming counterpart of ``coalesce`` for rows (key, ts, seq, kind).

    A windowed aggregation first reduces each key to one row per tick, with
    partial aggregation before the shuffle, and lets the watermark put ticks in
    order; the state behind it is a single open burst per key. Keys are dealt to
    ``buckets``, each of which is one value of the state: a micro-batch costs some
    messages per bucket and not per key. Bursts that are open when a feed ends come
    out once later rows move the watermark past them; rows of the key ``CLOSING``
    do only that. A stream keeps its number of buckets as long as its checkpoint.
    """
    ticks = (
        changes.withWatermark("ts", lateness)
        .groupBy("key", F.window("ts", f"{tick_ms} milliseconds"))
        .agg(F.max_by("kind", "seq").alias("kind"), F.count(F.lit(1)).alias("n"))
        .select("key", F.floor(F.unix_millis("window.start") / tick_ms).alias("tick"), "kind", "n",
                F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")))
    # A filter before the state would be pushed below the watermark, which would not see the closing rows.
    work = ticks.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Debouncer(tick_ms), outputStructType=WORK, outputMode="Append", timeMode="EventTime")
    return work.filter(F.col("key") != CLOSING)
