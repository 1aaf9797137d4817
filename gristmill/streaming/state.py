"""Keyed state of streams with timers: resumable crawls whose seen ids are a map, and circuit breakers that relax."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Ids of a page; a shorter one is a crawl's last.
PAGE = 20
#: A crawl that is not continued for a week is forgotten; so are the ids that it has seen.
REST_MS = 7 * 86_400_000
# Failures in a row that open a breaker, seconds of the first block and of the longest, the widest interval,
# the least that is doubled, and what is left of an interval after a rest.
OPENS_AT, FIRST_BLOCK_S, LONGEST_BLOCK_S, WIDEST_S, LEAST_S, RELAXED = 5, 300.0, 86_400.0, 10.0, 0.25, 0.7


#: Events may come so late.
LATE = "1 hour"


def _ms(at) -> int:
    return int(at.timestamp() * 1000)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State of many keys lives on the executors' disks, and its changes in the checkpoint; maps and timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Crawl(StatefulProcessor):
    """Where a board's crawl stands, and the ids that it has seen, an entry each: a page writes its own ids alone."""

    def __init__(self, rest_ms: int):
        self.rest_ms = rest_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next_offset long, total long, facet string, sound boolean, seen long, wakes long")
        self.seen = handle.getMapState("seen", "id string", "at long")

    def _anew(self, facet: str) -> list:
        self.seen.clear()
        return [0, -1, facet, True, 0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.place.get()
        at, total, facet, sound, n, wakes = tuple(held) if held is not None else (0, -1, None, True, 0, None)
        told, last = "open", 0
        for p in sorted(rows, key=lambda r: (r["at"], r["offset"])):
            last = max(last, _ms(p["at"]))
            if facet is not None and p["facet"] != facet:
                at, total, facet, sound, n = self._anew(p["facet"])
            facet = p["facet"]
            if p["offset"] not in (at, max(0, at - PAGE)):
                continue
            if (p["total"] or 0) > 0:
                sound, total = sound and total in (-1, p["total"]), p["total"]
            sound = sound and not p["malformed"]
            for i in p["ids"]:
                if not self.seen.containsKey((i,)):
                    self.seen.updateValue((i,), (p["offset"],))
                    n += 1
            at, told = p["offset"] + PAGE, "open"
            if len(p["ids"]) < PAGE or 0 < total <= at:
                told = "complete" if sound else "discarded"
                if sound:
                    for (i,) in self.seen.keys():
                        yield Row(board=key[0], next_offset=0, total=total, seen=n, state=told, id=i)
                yield Row(board=key[0], next_offset=0, total=total, seen=n if sound else 0, state=told, id=None)
                at, total, facet, sound, n = self._anew(facet)
        if told == "open":
            yield Row(board=key[0], next_offset=at, total=total, seen=n, state=told, id=None)
        if wakes is not None:
            self.handle.deleteTimer(wakes)
        if at or n:
            wakes = max(last, wakes - self.rest_ms if wakes is not None else 0) + self.rest_ms
            self.place.update((at, total, facet, sound, n, wakes))
            self.handle.registerTimer(wakes)
        else:  # nothing is left to remember
            self.place.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.place.get()
        self.place.clear()
        self.seen.clear()
        if held is not None:
            yield Row(board=key[0], next_offset=0, total=held[1], seen=0, state="expired", id=None)

    def close(self) -> None:
        pass


def crawls(pages: DataFrame, rest_ms: int = REST_MS) -> DataFrame:
    """(board, next_offset, total, seen, state, id) after each micro-batch of pages of resumable crawls.

    pages: a stream of board, at (when it was read, a timestamp), offset, total, ids, facet, malformed. A page counts if it
    begins where the crawl stands, or at the page before, which is read again on resuming; another facet
    starts anew. A page shorter than PAGE, or that reaches the total, ends the crawl: complete if every
    page was sound and none named another total, else it is thrown away. Each outcome is a row without an
    id; a complete crawl has a row for each id besides, read off the state one by one. A crawl that rests
    for ``rest_ms``, by the pages' own times, expires with all that it has seen.
    """
    keep_state_in_rocksdb(pages.sparkSession)
    schema = "board string, next_offset long, total long, seen long, state string, id string"
    return pages.withWatermark("at", LATE).groupBy("board").transformWithState(Crawl(rest_ms), schema, "update", "eventTime")


class Breaker(StatefulProcessor):
    """Failures in a row and the interval between requests: it doubles on each failure, and relaxes towards its base
    whenever the key rests; a key that is back at its base without failures is forgotten."""

    def __init__(self, key: str, failed: str, at: str, base_s: float, rest_ms: int):
        self.key, self.failed, self.at, self.base_s, self.rest_ms = key, failed, at, base_s, rest_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "failures long, interval_s double, wakes long")

    def _row(self, key, failures: int, interval: float) -> Row:
        block = min(LONGEST_BLOCK_S, FIRST_BLOCK_S * 2.0 ** min(16, max(0, failures - OPENS_AT))) if failures >= OPENS_AT else 0.0
        return Row(**{self.key: key[0], "failures": failures, "interval_s": interval, "block_s": block, "state": "open" if block else "closed"})

    def _keep(self, failures: int, interval: float, wakes: int | None, last: int) -> None:
        if wakes is not None:
            self.handle.deleteTimer(wakes)
        if failures or interval > self.base_s:
            wakes = last + self.rest_ms
            self.held.update((failures, interval, wakes))
            self.handle.registerTimer(wakes)
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get()
        failures, interval, wakes = tuple(held) if held is not None else (0, self.base_s, None)
        last = 0 if wakes is None else wakes - self.rest_ms
        for r in sorted(rows, key=lambda r: r[self.at]):
            last = max(last, _ms(r[self.at]))
            failures = failures + 1 if r[self.failed] else 0
            if r[self.failed]:
                interval = min(WIDEST_S, max(LEAST_S, interval) * 2)
        self._keep(failures, interval, wakes, last)
        yield self._row(key, failures, interval)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held is None:
            return
        relaxed = max(self.base_s, held[1] * RELAXED)
        interval = relaxed if relaxed > self.base_s * 1.05 else self.base_s
        self._keep(0, interval, None, expiredTimerInfo.getExpiryTimeInMs())
        yield self._row(key, 0, interval)

    def close(self) -> None:
        pass


def breaker(events: DataFrame, key: str, failed: str, at: str = "ts", base_s: float = 0.25, rest_ms: int = REST_MS) -> DataFrame:
    """(key, failures, interval_s, block_s, state) after each micro-batch: failures in a row so far, the interval between
    requests that they leave and the block that they earn.

    events: a stream with ``key``, ``failed`` and ``at``. After each rest of ``rest_ms``, by the events' times, the failures are
    forgiven and the interval keeps RELAXED of itself, until it is at ``base_s`` and the key is forgotten.
    """
    keep_state_in_rocksdb(events.sparkSession)
    kind = dict(events.dtypes)[key]
    schema = f"{key} {kind}, failures long, interval_s double, block_s double, state string"
    return events.withWatermark(at, LATE).groupBy(key).transformWithState(Breaker(key, failed, at, base_s, rest_ms), schema, "update", "eventTime")
