"""Structured Streaming jobs and their batch twins.

Both rules keep one small value per key and look at events in time order:

* a fetch of a URL is accepted when the last *accepted* fetch is a day or more old;
* a scan is skipped when the user's last scan was of the same URL less than five seconds ago.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quillmine import rules
from quillmine.operators import html as hm
from quillmine.operators import links as lk
from quillmine.sources.requests import html_pages

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AcceptAfter(StatefulProcessor):
    """Per key: accept an event when the last accepted one is ``seconds`` old or has other text.

    State is one row per key.  A timer drops it once it can no longer reject anything.  Keys are many and their
    events few, so rows are plain (no frame per key), and a key talks to its state as little as can be: the one
    timer's time follows from the state, so timers are not listed.
    """

    def __init__(self, seconds: float, compare_value: bool):
        self.micros = int(seconds * 1_000_000)
        self.compare_value = compare_value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, value string")

    def due(self, at: int) -> int:
        """The timer's time for a last accepted event, in milliseconds."""
        return (at + self.micros) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # null times and numbers come last
        batch = sorted(((row.at is None, row.at or 0, row.seq is None, row.seq or 0, i, row.value) for i, row in enumerate(rows)))
        state = self.last.get()
        before = at = state[0] if state else None
        value = state[1] if state else None
        taken = []
        for timeless, now, unnumbered, seq, _, text in batch:
            if timeless:
                now = NO_TIME
            fresh = at is None or now - at >= self.micros
            if fresh or (self.compare_value and text != value):
                at, value = now, text
                taken.append(Row(key=key[0], value=text, at=None if timeless else now, seq=None if unnumbered else seq))
        if taken:
            self.last.update((at, value))
            if before is not None:
                self.handle.deleteTimer(self.due(before))
            self.handle.registerTimer(self.due(at))
        return iter(taken)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Stands for a null time in state: before all others.
NO_TIME = -(1 << 63) // 1000


def _accept(events: DataFrame, seconds: float, compare_value: bool, lateness: str) -> DataFrame:
    return (
        events.select("key", "value", F.col("ts").cast("timestamp").alias("ts"), "seq")
        .withWatermark("ts", lateness)
        .withColumn("at", F.unix_micros("ts"))
        .groupBy("key")
        .transformWithState(AcceptAfter(seconds, compare_value), "key string, value string, at long, seq long", "append", "eventTime")
        .select("key", "value", F.timestamp_micros("at").alias("ts"), "seq")
    )


def ttl_stream(fetches: DataFrame, seconds: float = rules.CACHE_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """fetches(key, value, ts, seq) as a stream to the accepted fetches.

    The session needs the RocksDB state store provider (``STATE_STORE``).
    """
    return _accept(fetches, seconds, False, lateness)


def cooldown_stream(visits: DataFrame, seconds: float = rules.SCAN_COOLDOWN_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """visits(key = user, value = url, ts, seq) as a stream to the accepted scans."""
    return _accept(visits, seconds, True, lateness)


def _walk(rows: DataFrame, group: list[str], micros: int) -> DataFrame:
    """Accept rows(key, value, at, seq, entry) in time order within ``group``.

    The first accepted row is the first at ``entry`` (equal within a group) or later, the next one
    ``micros`` after it.  Groups arrive whole and sorted (Spark's sort spills), and two values are
    carried from batch to batch, so memory does not grow with a group.  Inside a batch the walk
    jumps from one accepted row to the next by binary search.
    """
    names = [f"g{i}" for i in range(len(group))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = due = None
        for batch in batches:
            if not len(batch):
                continue
            at, entry = batch["at"].to_numpy(), batch["entry"].to_numpy()
            changed = np.zeros(len(batch), dtype=bool)
            changed[0] = True
            for name in names:
                column = batch[name].to_numpy()
                changed[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(changed)
            taken: list[int] = []
            for start, end in zip(starts, np.append(starts[1:], len(batch))):
                ident = tuple(batch[name].iat[start] for name in names)
                if ident != here:
                    here, due = ident, entry[start]
                place = start
                while place < end:
                    place += int(np.searchsorted(at[place:end], due))
                    if place < end:
                        due = at[place] + micros
                        taken.append(place)
                        place += 1
            yield batch.iloc[taken][["key", "value", "at", "seq"]]

    named = [F.col(g).alias(f"g{i}") for i, g in enumerate(group)]
    return (
        rows.select("key", "value", "at", "seq", "entry", *named)
        .repartition(*names)
        .sortWithinPartitions(*names, "at", "seq")
        .mapInPandas(run, "key string, value string, at long, seq long")
    )


def _block_ends(rows: DataFrame, width: int, span: int) -> DataFrame:
    """For rows(key, block, at): where the chain ends that enters a block of ``span`` at a given time.

    The first acceptable time of a block lies within ``width`` of its beginning, so chains start at the
    rows of that stretch or the first one after it.  They are walked side by side, in the order of the
    time each has reached: a row moves every chain it is late enough for, and chains that meet go on
    as one.  A result row holds for entries up to ``latest`` and after the one before it: the last
    accepted time is then ``last``.
    """
    columns = ["key", "block", "latest", "last"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, chains, after, edge = None, deque(), False, 0
        for batch in batches:
            out = []
            for key, block, at in zip(batch["key"], batch["block"].tolist(), batch["at"].tolist()):
                if (key, block) != here:
                    out.extend((*here, latest, last) for starts, last in chains for latest in starts)
                    here, chains, after, edge = (key, block), deque(), False, block * span + width
                moved: list[int] = []
                while chains and chains[0][1] <= at - width:
                    more = chains.popleft()[0]
                    moved, more = (moved, more) if len(moved) >= len(more) else (more, moved)
                    moved.extend(more)
                begins, after = at < edge or not after, after or at >= edge
                if begins and not (chains and chains[-1][1] == at):
                    moved.append(at)
                if moved:
                    chains.append((moved, at))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(*here, latest, last) for starts, last in chains for latest in starts], columns=columns)

    placed = rows.select("key", "block", "at").repartition("key", "block").sortWithinPartitions("key", "block", "at")
    return placed.mapInPandas(run, "key string, block long, latest long, last long")


def _block_entries(ends: DataFrame, width: int) -> DataFrame:
    """The first acceptable time of every (key, block), from block to block of a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, entry, found, last = (None, None), 0, False, None
        for batch in batches:
            out = []
            for key, block, latest, end in zip(batch["key"], batch["block"].tolist(), batch["latest"].tolist(), batch["last"].tolist()):
                if key != here[0]:
                    last = None
                if (key, block) != here:
                    here, found, entry = (key, block), False, EVER if last is None else last + width
                    out.append((key, block, entry))
                if not found and latest >= entry:
                    found, last = True, end
            yield pd.DataFrame(out, columns=["key", "block", "entry"])

    placed = ends.repartition("key").sortWithinPartitions("key", "block", "latest")
    return placed.mapInPandas(run, "key string, block long, entry long")


#: Earlier than any event.
EVER = -(1 << 62)


def ttl_batch(fetches: DataFrame, seconds: int = rules.CACHE_TTL_SECONDS, block_lifetimes: int = 32) -> DataFrame:
    """Batch twin of ``ttl_stream``: fetches(key, ts, seq) to the accepted rows.

    One way for keys of any size: a key's time is cut into blocks of ``block_lifetimes`` lifetimes.
    Every block works out, for each way to enter it, when its last fetch is accepted; these few rows
    are followed from block to block, and then every block is walked from its own entry.  So a key
    with very many fetches is spread over its blocks.
    """
    width = seconds * 1_000_000
    span = width * block_lifetimes
    stamped = fetches.select(
        "key", F.lit(None).cast("string").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq"
    ).withColumn("block", F.floor(F.col("at") / span))
    entries = _block_entries(_block_ends(stamped, width, span), width).toDF("k", "b", "entry")
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))
    taken = _walk(stamped.join(entries, same), ["key", "block"], width)
    return taken.select("key", F.timestamp_micros("at").alias("ts"), "seq")


def cooldown_batch(visits: DataFrame, seconds: int = rules.SCAN_COOLDOWN_SECONDS, slice_seconds: int = 3600) -> DataFrame:
    """Batch twin of ``cooldown_stream``: visits(key, value, ts, seq) to the accepted rows.

    A visit to another URL, or one after a pause as long as the cooldown, is always accepted,
    so only bursts (same URL, short pauses) need a walk.  The previous visit is looked up inside
    (user, hour) slices; only the last visit of a slice crosses to the next one.
    """
    micros = seconds * 1_000_000
    rows = visits.select("key", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq").withColumn(
        "slice", F.floor(F.col("at") / (slice_seconds * 1_000_000))
    )
    ends = rows.groupBy("key", "slice").agg(F.max(F.struct("at", "seq", "value")).alias("end"))
    crossing = Window.partitionBy("key").orderBy("slice")
    ends = ends.select("key", "slice", F.lag("end").over(crossing).alias("before"))
    within = Window.partitionBy("key", "slice").orderBy("at", "seq")
    linked = rows.join(ends, ["key", "slice"]).withColumn(
        "prev", F.coalesce(F.lag(F.struct("at", "seq", "value")).over(within), F.col("before"))
    )
    opens = F.col("prev").isNull() | (F.col("prev.value") != F.col("value")) | (F.col("at") - F.col("prev.at") >= micros)
    flagged = linked.withColumn("opens", opens).drop("before", "prev")
    # a burst may cross slices: number bursts per slice, carry the open one from before
    marked = flagged.withColumn("burst_at", F.max(F.when(F.col("opens"), F.struct("at", "seq"))).over(within))
    tails = marked.groupBy("key", "slice").agg(F.max("burst_at").alias("tail"))
    carried = tails.withColumn(
        "carried", F.max("tail").over(crossing.rowsBetween(Window.unboundedPreceding, -1))
    ).drop("tail")
    bursts = marked.join(carried, ["key", "slice"]).withColumn("burst", F.coalesce("burst_at", "carried"))
    sized = bursts.groupBy("key", "burst").agg(F.count("*").alias("n"))
    first = bursts.filter(F.col("opens")).select("key", "value", "at", "seq")

    # only bursts of three or more can hold a second accepted visit
    long = bursts.join(sized.filter(F.col("n") >= 3), ["key", "burst"]).select(
        "key", "value", "at", "seq", F.col("burst.at").alias("b_at"), F.col("burst.seq").alias("b_seq")
    )
    more = _walk(long.withColumn("entry", F.col("b_at") + micros), ["key", "b_at", "b_seq"], micros)
    return first.unionByName(more).select("key", "value", F.timestamp_micros("at").alias("ts"), "seq")


def ingest(pages: DataFrame, out: str, checkpoint: str, selectors=rules.LINK_CONTENT_SELECTORS) -> StreamingQuery:
    """Clean and scan pages as they arrive: pages(url, html) stream to two Parquet tables."""

    def write(batch: DataFrame, number: int) -> None:
        batch = html_pages(batch).persist()
        try:
            # a batch number names its folder, so a replayed batch overwrites itself
            hm.pages_clean(batch).write.mode("overwrite").parquet(f"{out}/pages_clean/batch={number}")
            anchors = hm.extract_anchors(batch, selectors)
            links = lk.relevant_links(lk.distinct_links(lk.describe(anchors)))
            links.write.mode("overwrite").parquet(f"{out}/links/batch={number}")
        finally:
            batch.unpersist()

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
