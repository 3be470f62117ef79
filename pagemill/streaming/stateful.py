"""Stateful stream operators with list, map and value state and event-time timers.

Each runs on transformWithStateInPandas over the RocksDB state store, so state lives on disk
beside the executors and in the checkpoint, not in memory. State is bounded per key by a
length or by timers that the watermark drives, so a key that falls silent leaves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.streaming.jobs import timed


class _BoundedLog(StatefulProcessor):
    """The newest n (us, id) pairs of a key in list state, newest first."""

    def __init__(self, key: str, n: int):
        self.key, self.n = key, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "us long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = list(self.log.get()) if self.log.exists() else []
        for frame in rows:  # trimmed per frame, so a busy key never holds more than a frame and n pairs
            newest = sorted({*newest, *zip(frame["us"], frame["id"], strict=True)}, reverse=True)[: self.n]
        newest = [(int(us), int(i)) for us, i in newest]
        self.log.put(newest)
        yield pd.DataFrame({self.key: pd.array([key[0]] * len(newest), "Int64"), "id": [i for _, i in newest], "rank": range(1, len(newest) + 1)})

    def close(self) -> None:
        pass


def bounded_log(events: DataFrame, ts: str, key: str, ident: str, n: int = 1000) -> DataFrame:
    """(key, id, rank): the whole log of every key that a micro-batch touches. Ties of time
    go to the larger id; a row that comes again changes nothing. Keys and ids are longs."""
    rows = timed(events, ts).select(F.col(key).cast("long").alias(key), F.unix_micros(ts).alias("us"), F.col(ident).cast("long").alias("id"))
    return rows.groupBy(key).transformWithStateInPandas(_BoundedLog(key, n), f"{key} long, id long, rank long", "Update", "None")


class _Presence(StatefulProcessor):
    """Last move of a (place, member); a join is forgotten after `idle_ms` without another."""

    def __init__(self, names: list[str], idle_ms: int):
        self.names, self.idle_ms = names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, id long, joined boolean")

    def _row(self, key, present: bool) -> pd.DataFrame:
        return pd.DataFrame({n: pd.array([v], "Int64") for n, v in zip(self.names, key, strict=True)} | {"present": [present]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = tuple(self.last.get()) if self.last.exists() else None
        for frame in rows:
            best = max(zip(frame["us"], frame["id"], frame["joined"], strict=True))
            newest = best if newest is None else max(newest, best)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        newest = (int(newest[0]), int(newest[1]), bool(newest[2]))
        # a leave is kept as long as a join, so that a late join before it is not taken for news
        self.last.update(newest)
        self.handle.registerTimer(max(-(-newest[0] // 1000) + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, newest[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield self._row(key, False)

    def close(self) -> None:
        pass


def presence(events: DataFrame, ts: str, place: str, member: str, ident: str, joined: str, left: str, kind: str, idle_hours: int) -> DataFrame:
    """(place, member, present) whenever that changes by a move or by silence of idle_hours.

    The state is per place and member, so a crowded place is spread over many keys.
    """
    moves = timed(events.filter(F.col(kind).isin(joined, left)), ts).select(
        ts, F.col(place).cast("long").alias(place), F.col(member).cast("long").alias(member), F.unix_micros(ts).alias("us"), F.col(ident).cast("long").alias("id"), (F.col(kind) == joined).alias("joined"))
    return moves.groupBy(place, member).transformWithStateInPandas(
        _Presence([place, member], idle_hours * 3_600_000), f"{place} long, {member} long, present boolean", "Update", "EventTime")


class _Entries(StatefulProcessor):
    """Entries of an owner by id in map state, each until its time of expiry."""

    def __init__(self, owner: str):
        self.owner = owner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getMapState("expiry", "id long", "ms long")

    def _rows(self, key, ids: list[int], live: bool) -> pd.DataFrame:
        return pd.DataFrame({self.owner: pd.array([key[0]] * len(ids), "Int64"), "id": ids, "live": [live] * len(ids)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            ids = []
            for i, ms in zip(frame["id"].tolist(), frame["ms"].tolist(), strict=True):
                if ms <= mark:
                    continue
                self.expiry.updateValue((i,), (ms,))
                self.handle.registerTimer(ms)
                ids.append(i)
            yield self._rows(key, ids, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [i for (i,), (ms,) in self.expiry.iterator() if ms <= now]
        for i in gone:
            self.expiry.removeKey((i,))
        yield self._rows(key, gone, False)

    def close(self) -> None:
        pass


def expiring_entries(events: DataFrame, ts: str, owner: str, ident: str, ttl_hours: int, shards: int = 16) -> DataFrame:
    """(owner, id, live): an entry lives for ttl_hours after its event. A busy owner is dealt over `shards` keys."""
    rows = timed(events, ts).select(ts, F.col(owner).cast("long").alias(owner), F.col(ident).cast("long").alias("id"),
                                    (F.ceil(F.unix_micros(ts) / 1000) + ttl_hours * 3_600_000).cast("long").alias("ms"), F.pmod(F.xxhash64(ident), F.lit(shards)).alias("shard"))
    return rows.groupBy(owner, "shard").transformWithStateInPandas(_Entries(owner), f"{owner} long, id long, live boolean", "Update", "EventTime")
