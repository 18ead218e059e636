"""Transitions of a stream whose rows come late and out of order."""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Sessions are dealt over so many keys of state; a checkpoint is bound to the number. Rows of a value of state at most.
BUCKETS, PACK = 4096, 10_000
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def row_store(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which lists and timers ask for; the setting is put back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class Ordered(StatefulProcessor):
    """Of each bucket of sessions: rows that the watermark has not passed (a list), and of each session the last one that it has passed.

    A timer at the earliest waiting row lets all rows go that the watermark has passed, in order of (at, seq). When
    keep_us have gone by after a session's last row it is forgotten, and a later row follows nothing, whatever the batches are.
    A value of the list holds PACK rows at most, as the lists session, at, seq and item: a key and a value of state cost far more than a row.
    """

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "sessions binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packs, earliest = [], []
        for frame in rows:
            at = frame["at"].tolist()
            sessions, items = ([None if pd.isna(x) else x for x in frame[c].tolist()] for c in ("session", "item"))
            packs += _packs(list(zip(sessions, at, frame["seq"].tolist(), items, strict=True)))
            earliest.append(min(at))
        self.waiting.appendList(packs)
        self.handle.registerTimer(min(earliest) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        packs = [pickle.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted((r for p in packs for r in zip(*p, strict=True)), key=lambda r: r[1:3])
        passed = bisect_right(rows, mark, key=lambda r: r[1])
        rest = rows[passed:]
        last, out = pickle.loads(self.last.get()[0]) if self.last.exists() else {}, []
        for session, at, _, item in rows[:passed]:
            before, where = last.get(session, (at, None))
            if None not in (where, item) and where != item and at - before <= self.keep_us:
                out.append((where, item, at))
            last[session] = (at, item)
        kept = {s: x for s, x in last.items() if mark - x[0] <= self.keep_us}
        if kept and (passed or len(kept) < len(last)):
            self.last.update((pickle.dumps(kept),))
        elif last and not kept:
            self.last.clear()
        if passed:
            self.waiting.clear()
            if rest:
                self.waiting.put(_packs(rest))
        if rest:
            self.handle.registerTimer(rest[0][1] // 1000)
        elif kept:
            self.handle.registerTimer((min(at for at, _ in kept.values()) + self.keep_us) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["from_id", "to_id", "at"])


def _packs(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(tuple(map(list, zip(*rows[lo : lo + PACK], strict=True)))),) for lo in range(0, len(rows), PACK)]


def ordered_transitions(src: DataFrame, late: str = "1 hour", keep_days: int = 7) -> DataFrame:
    """from_id, to_id, seen: consecutive different items of each session of src (session_id, item, ts, seq), in order of (ts, seq).

    Rows may come in any order up to late behind the latest one; later ones are dropped, and a pair leaves when the watermark
    has passed its second row. Sessions are dealt over BUCKETS by a hash; state of a bucket are its rows of that span and one row of each session, which is
    forgotten after keep_days without another. A null item parts its neighbours; rows without a session are one session; rows without a time or seq are left out,
    and so are times up to the year 1970, at which watermarks begin. Whole numbers travel as text, so that nulls beside them leave them exact.
    """
    kind = src.schema["item"].dataType.simpleString()
    moved = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    rows = src.filter("ts IS NOT NULL AND seq IS NOT NULL").withWatermark("ts", late)
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = rows.select(bucket, "ts", F.col("session_id").cast("string").alias("session"), F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("item").cast(moved).alias("item"))
    pairs = rows.groupBy("bucket").transformWithStateInPandas(Ordered(keep_days * 86_400_000_000), f"from_id {moved}, to_id {moved}, at long", "Append", "EventTime")
    return pairs.select(F.col("from_id").cast(kind).alias("from_id"), F.col("to_id").cast(kind).alias("to_id"), F.timestamp_micros("at").alias("seen"))
