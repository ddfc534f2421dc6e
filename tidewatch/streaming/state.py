"""Keyed state over streams: fact chains and rate windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.schemas import RATE_MAX_EVENTS, RATE_WINDOW_MS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Operators with custom state need the embedded key-value store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


FACT_SCHEMA = (
    "fact_id long, vendor string, dimension string, fact string, valid_from timestamp, kind string, "
    "previous_fact_id long, superseded_by long, superseded_at timestamp, version long"
)


class FactChain(StatefulProcessor):
    """Per (vendor, dimension): the facts that a row may still come before, in order, and the two before them.

    A row that comes out of order finds its place between two facts; it and those beside it are told again with
    the links they now have, under a higher version. Once the watermark has passed a fact nothing comes before it any more;
    of those the newest stays, which may yet be superseded, and the one it points at. Facts are held as (time, item, kind), without their text.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "us long, fact_id long, kind string")
        self._version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chain = [tuple(x) for x in self._open.get()]
        version = (self._version.get() or (0,))[0]
        for frame in rows:  # a chunk at a time; what a later chunk changes is told again
            version += 1
            texts = {}
            for us, item, kind, after in zip(frame["us"].tolist(), frame["item_id"].tolist(), frame["kind"], frame["after"]):
                insort(chain, (us, item, kind))
                texts[us, item] = after
            touched = set()
            for us, item in texts:
                at = bisect_left(chain, (us, item))
                touched.update(i for i in (at - 1, at, at + 1) if 0 <= i < len(chain))
            yield self._told(key, chain, sorted(touched), texts, version)
        self._keep(chain, timerValues.getCurrentWatermarkInMs())
        self._version.update((version,))

    def _told(self, key, chain: list, places: list[int], texts: dict, version: int) -> pd.DataFrame:
        out = []
        for i in places:
            us, item, kind = chain[i]
            before = chain[i - 1] if i and kind == "update" else None
            after = chain[i + 1] if i + 1 < len(chain) and chain[i + 1][2] == "update" else None
            out.append((item, key[0], key[1], texts.get((us, item)), us, kind, before and before[1], after and after[1], after and after[0], version))
        told = pd.DataFrame(out, columns=[c.split()[0] for c in FACT_SCHEMA.split(", ")])
        for c in ("valid_from", "superseded_at"):
            told[c] = pd.to_datetime(pd.array(told[c], dtype="Int64"), unit="us")
        return told.astype({"previous_fact_id": "Int64", "superseded_by": "Int64"})

    def _keep(self, chain: list, watermark_ms: int) -> None:
        first = max(0, bisect_left(chain, (watermark_ms * 1000,)) - 2)
        self._open.put(chain[first:])
        if len(chain) - first > 2:
            self._handle.registerTimer(chain[-1][0] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep([tuple(x) for x in self._open.get()], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def fact_stream(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Facts from a stream of change events (item_id, vendor, dimension, kind, after, at), with corrections.

    A fact is told when its event comes, and told again, with a higher version, when a later row comes before or after it.
    Rows up to ``delay`` behind the newest are placed; Spark drops those further behind. A correction leaves ``fact``
    null: :func:`latest_facts` puts both together.
    """
    made = events.filter("vendor is not null and kind in ('new', 'update') and at is not null").withWatermark("at", delay)
    return made.withColumn("us", F.unix_micros("at")).groupBy("vendor", "dimension").transformWithStateInPandas(
        FactChain(), outputStructType=FACT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def latest_facts(told: DataFrame) -> DataFrame:
    """Every fact a stream has told, with the links it was last told with."""
    links = F.max_by(F.struct("previous_fact_id", "superseded_by", "superseded_at"), "version").alias("_l")
    return told.groupBy("fact_id", "vendor", "dimension", "valid_from", "kind").agg(F.max("fact").alias("fact"), links).select(
        "fact_id", "vendor", "dimension", "fact", "valid_from", "kind", "_l.*"
    )


SPAN_WINDOWS = 1_440  # window lengths of waiting events that are stored together: a day of minutes


class RateWindow(StatefulProcessor):
    """Per key: events that wait for the watermark, by spans of many windows, and the open window.

    Slots of one window's length are decided once the watermark has passed their end, so their events are all there and in order.
    A span's events are stored and read together and have one timer, for the end of the first slot, as every call of the state store costs
    far more than an event; a key's events are never held in one piece, only those of a span. The state goes when the open window
    has ended and nothing waits.
    """

    def __init__(self, width: int, budget: int):
        self._width, self._budget = width, budget
        self._span = width * SPAN_WINDOWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._window = handle.getValueState("window", "start long, seen long")
        self._waiting = handle.getMapState("waiting", "span long, chunk long", "ms array<long>, ids array<long>")
        self._chunks = handle.getMapState("chunks", "span long", "n long, least long")

    def _hold(self, span: int, chunk: int, least: int, ms: list[int], ids: list[int]) -> None:
        self._waiting.updateValue((span, chunk), (ms, ids))
        self._chunks.updateValue((span,), (chunk + 1, least))
        self._handle.registerTimer((least // self._width + 1) * self._width)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is not None:  # a row without a key only moves the watermark
            for frame in rows:
                for span, part in frame.groupby(frame["ms"] // self._span):
                    span, first = int(span), int(part["ms"].min())
                    n, least = self._chunks.getValue((span,)) if self._chunks.containsKey((span,)) else (0, first)
                    self._hold(span, n, min(first, least), part["ms"].tolist(), part["event_id"].tolist())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        through = now // self._width * self._width  # slots before it are decided
        start, seen = self._window.get() or (None, 0)
        for span in sorted(s[0] for s in self._chunks.keys()):
            chunks, least = self._chunks.getValue((span,))
            if least >= through:
                break
            events: list[tuple[int, int]] = []
            for chunk in range(chunks):
                ms, ids = self._waiting.getValue((span, chunk))
                events.extend(zip(ms, ids))
                self._waiting.removeKey((span, chunk))
            self._chunks.removeKey((span,))
            events.sort()
            due = bisect_left(events, (through,))
            if due < len(events):
                ms, ids = zip(*events[due:])
                self._hold(span, 0, ms[0], list(ms), list(ids))
            out = []
            for ms, event in events[:due]:
                if start is None or ms >= start + self._width:
                    start, seen = ms, 0
                seen += 1
                out.append((event, key[0], start, seen <= self._budget))
            yield pd.DataFrame(out, columns=["event_id", "key", "window_ms", "allowed"])
        if start is None:
            return
        # What still waits may lie in the open window, though its slot reaches beyond; what comes later can't.
        if start + self._width <= now and not any(True for _ in self._chunks.keys()):
            self._window.clear()
        else:
            self._window.update((start, seen))
            if start + self._width > now:
                self._handle.registerTimer(start + self._width)

    def close(self) -> None:
        pass


def rate_stream(
    events: DataFrame, key: str, at: str, event_id: str, width: int = RATE_WINDOW_MS, budget: int = RATE_MAX_EVENTS, delay: str = "10 minutes"
) -> DataFrame:
    """event_id, key, window_ms, allowed for a stream of events.

    Events are decided in the order of (time, id) when the watermark, ``delay`` behind the newest event, has passed the slot
    they lie in; later ones are dropped by Spark. Rows without a key are not decided.
    """
    rows = events.withWatermark(at, delay).select(
        F.col(key).cast("string").alias("key"), F.col(at), F.unix_millis(at).alias("ms"), F.col(event_id).cast("bigint").alias("event_id")
    )
    return rows.groupBy("key").transformWithStateInPandas(
        RateWindow(width, budget),
        outputStructType="event_id long, key string, window_ms long, allowed boolean",
        outputMode="Append",
        timeMode="EventTime",
    )
