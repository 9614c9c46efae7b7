"""What a cleaner remembers of its sets, kept by a stream: when each was first seen, whether it is held, failures that end after a day.

The batch form is ``operators.state``: ``observed`` and the failures of ``plan``. Here a key's memory is state of
``transformWithState``: values, and a map of failures whose timers end them in event time. Such state needs RocksDB's store, which
is set for the session; streams that were started with another one go on with theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kindred.operators.state import RETRY_DAYS

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = RETRY_DAYS * 86_400_000_000
OUTPUT = "key string, first_seen long, held boolean, failed string, listed boolean"


def _use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class FirstSeen(StatefulProcessor):
    """A key's first time of presence since it was last gone; its rows are folded one by one and come in any order within a batch.

    What counts is the least time of presence not before the last going. That going is known only at the end of a batch, so
    the times that may count wait in the state store, not in memory, and are read once more; the list is empty between batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")
        self.times = handle.getListState("times", "at long")
        self.gone: int | None = None
        self.noted = False

    def note(self, at: int, present: bool) -> None:
        if not present:
            self.gone = at if self.gone is None else max(self.gone, at)
        elif self.gone is None or at >= self.gone:
            self.times.appendValue((at,))
            self.noted = True

    def settled(self) -> tuple[int | None, int | None]:
        """(first seen, last gone in this batch), at the end of a batch; the state is brought up to date."""
        gone, first = self.gone, self.seen.get()[0] if self.seen.exists() else None
        if gone is not None and first is not None and first < gone:
            first = None
        if self.noted:
            for (at,) in self.times.get():
                if (gone is None or at >= gone) and (first is None or at < first):
                    first = at
            self.times.clear()
        if first is None:
            self.seen.clear()
        else:
            self.seen.update((first,))
        self.gone, self.noted = None, False
        return first, gone

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            self.note(row["at"], row["present"])
        first, _ = self.settled()
        yield Row(key=key[0], first_seen=first, present=first is not None)

    def close(self) -> None:
        pass


class CleaningMemory(FirstSeen):
    """The same with what is held and what failed: between batches a key holds three numbers and one entry for each reason of failure."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "at long, held boolean")
        self.failed = handle.getMapState("failed", "reason string", "at long")

    def _failures(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.failed.iterator()}

    def _row(self, key: tuple, listed: bool = True) -> Row:
        first = self.seen.get()[0] if self.seen.exists() else None
        held = bool(self.held.get()[1]) if self.held.exists() else False
        return Row(key=key[0], first_seen=first, held=held, failed=max(self._failures(), default=None), listed=listed)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get() if self.held.exists() else None
        for row in rows:
            at, event = row["micros"], row["event"]
            if event in ("listed", "gone"):
                self.note(at, event == "listed")
            elif event in ("held", "released"):
                # of two at one time holding counts, the careful way
                held = max(tuple(held or (at, False)), (at, event == "held"))
            elif event == "failed":
                reason = row["reason"] or ""
                if not self.failed.containsKey((reason,)) or self.failed.getValue((reason,))[0] < at:
                    self.failed.updateValue((reason,), (at,))
        first, gone = self.settled()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for reason, at in self._failures().items():
            if first is None or (gone is not None and at < gone) or at + _DAY <= now:
                self.failed.removeKey((reason,))
            else:
                # a millisecond is begun when its failure is over, so a timer never comes too early
                self.handle.registerTimer(-(-(at + _DAY) // 1000))
        if first is not None and held is not None and (gone is None or held[0] >= gone):
            self.held.update((held[0], held[1]))
        else:
            self.held.clear()
        yield self._row(key, first is not None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ended = expiredTimerInfo.getExpiryTimeInMs() * 1000
        over = [reason for reason, at in self._failures().items() if at + _DAY <= ended]
        for reason in over:
            self.failed.removeKey((reason,))
        if over and self.seen.exists():
            yield self._row(key)


def first_seen(observed: DataFrame) -> DataFrame:
    """(key, first_seen, present) for a stream of (key, at, present): set when a key appears, dropped when it goes.

    Presence at the time of a going comes after it. Rows without a time or present go. Batches come in the order of time.
    """
    _use_state_store(observed.sparkSession)
    own = observed.where(F.col("at").isNotNull() & F.col("present").isNotNull()).select(F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"), "present")
    return own.groupBy("key").transformWithState(FirstSeen(), "key string, first_seen long, present boolean", "Update", "None")


def memory(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(key, first_seen, held, failed, listed) of each key with news, for a stream of (key, at, event, reason).

    Events: listed (a run found the key), gone (a run did not), held and released, failed (with a reason). A key is first seen
    at its first listing not before its last going; going takes what is held and failed with it; what a key without a listing is
    told counts for nothing. A failure ends ``RETRY_DAYS`` after its last time, by the watermark (``late`` behind the newest event),
    and then the key comes out again; of several failures the last by name is told. Rows without a key or time and unknown
    events go. Batches come in the order of time; within one, events may come in any. Columns beside these count for nothing.
    """
    _use_state_store(events.sparkSession)
    known = events.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("event").isin("listed", "gone", "held", "released", "failed"))
    own = known.select(F.col("key").cast("string").alias("key"), "at", "event", F.col("reason").cast("string").alias("reason"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    out = own.withWatermark("at", late).groupBy("key").transformWithState(CleaningMemory(), OUTPUT, "Update", "EventTime")
    return out.withColumn("first_seen", F.timestamp_micros("first_seen"))  # state is in microseconds: no time zone has a part in it
