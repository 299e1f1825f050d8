"""Context ledger: which retrieved units a run has staged, committed, rejected or released.

One fold over a run's events in order, the same in a batch (`replay`) and as a state machine of a stream (`replay_stream`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATER = "already committed"
PARALLEL = "returned by a parallel query"
OVERFLOW = "selection exceeded the step's maximum"
UNSELECTED = "not selected"

OUT = "seq long, unit string, outcome string, reason string"
NAMES = [x.split()[0] for x in OUT.split(", ")]
DECISION = Row("run", *NAMES)


class Ledger:
    def __init__(self, most: int = 3):
        self.most = most
        self.pending: list[str] = []
        self.home: dict[str, int] = {}  # committed unit -> event that keeps its text
        self.rejected: set[str] = set()

    def stage(self, seq: int, units: list[str]) -> Iterator[tuple]:
        self.pending += units
        return iter(())

    def commit(self, seq: int, chosen: list[str]) -> Iterator[tuple]:
        """Chosen units in order, up to the maximum; unknown ones refuse the whole call and leave the batch staged."""
        counts = Counter(self.pending)
        chosen = list(dict.fromkeys(c for c in chosen if c))
        if unknown := [c for c in chosen if c not in counts]:
            yield from ((seq, u, "error", "not staged") for u in unknown)
            return
        fresh = [c for c in chosen if c not in self.home]
        taken, over = set(fresh[: self.most]), set(fresh[self.most :])
        for unit in dict.fromkeys(self.pending):
            if unit in taken:
                yield seq, unit, "committed", ""
                yield from ((seq, unit, "duplicate", PARALLEL) for _ in range(counts[unit] - 1))
                continue
            later = unit in self.home
            yield seq, unit, "duplicate" if later else "rejected", LATER if later else OVERFLOW if unit in over else UNSELECTED
            if not later:
                self.rejected.add(unit)
        self.home.update(dict.fromkeys(taken, seq))
        self.rejected -= taken
        self.pending.clear()

    def release(self, seq: int, units: list[str]) -> Iterator[tuple]:
        """Committed units give up their place; an unknown one refuses the whole call."""
        units = list(dict.fromkeys(units))
        if unknown := [u for u in units if u not in self.home]:
            yield from ((seq, u, "error", "not committed") for u in unknown)
            return
        for u in units:
            yield seq, u, "released", f"kept since {self.home.pop(u)}"
            self.rejected.add(u)

    def expire(self, seq: int, reason: str = "expired") -> Iterator[tuple]:
        """The staged batch is rejected as a whole."""
        for unit in dict.fromkeys(self.pending):
            later = unit in self.home
            yield seq, unit, "duplicate" if later else "rejected", LATER if later else reason
            if not later:
                self.rejected.add(unit)
        self.pending.clear()

    def apply(self, seq: int, kind: str, units: list[str]) -> Iterator[tuple]:
        if kind == "expire":
            return self.expire(seq)
        return {"stage": self.stage, "commit": self.commit, "release": self.release}[kind](seq, units)


def fold(events: pd.DataFrame, most: int) -> list[tuple]:
    ledger = Ledger(most)
    return [row for e in events.sort_values("seq").itertuples() for row in ledger.apply(e.seq, e.kind, list(e.units))]


def replay(events: DataFrame, most: int = 3) -> DataFrame:
    """Decisions of every run from its events (run, seq, kind, units)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in fold(group, most)], columns=["run", *NAMES])

    return events.groupBy("run").applyInPandas(run, f"run {events.schema['run'].dataType.simpleString()}, {OUT}")


#: A run's ledger as one value: what it holds, since when, what it has rejected, its staged batch, and the batch's event and end.
STATE = "home array<string>, since array<long>, rejected array<string>, pending array<string>, seq long, until long"


class Keeper(StatefulProcessor):
    """A run's ledger as a state machine: one value that is read and written once a run and micro-batch, and a timer for the staged batch.

    Each call of a state is a message to the executor's JVM, so what an event asks is looked up in the value and not in states of its own.
    A batch that is staged longer than `keep_ms` of event time without a commit expires: by the next event of the run if that comes too late, else by
    the timer, once the watermark has passed. Both give the same rows.
    """

    def __init__(self, most: int, keep_ms: int | None):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ledger", STATE)

    def _ledger(self) -> tuple[Ledger, tuple[int, int] | None]:
        ledger, known = Ledger(self.most), self.state.get()
        if known is None:
            return ledger, None
        home, since, rejected, pending, seq, until = known
        ledger.home, ledger.rejected, ledger.pending = dict(zip(home, since)), set(rejected), list(pending)
        return ledger, None if seq is None else (seq, until)

    def _put(self, ledger: Ledger, staged: tuple[int, int] | None) -> None:
        self.state.update((list(ledger.home), list(ledger.home.values()), sorted(ledger.rejected), ledger.pending, *(staged or (None, None))))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        ledger, since = self._ledger()
        before, out = since, []
        for e in sorted(rows, key=lambda e: e.seq):
            at = int(e.at.timestamp() * 1000) if self.keep_ms is not None else 0
            if since and self.keep_ms is not None and at > since[1]:
                out += ledger.expire(since[0] + 1)
                since = None
            out += ledger.apply(e.seq, e.kind, list(e.units))
            if not ledger.pending:
                since = None
            elif e.kind == "stage":
                since = (int(e.seq), at + (self.keep_ms or 0))
        self._put(ledger, since)
        if self.keep_ms is not None and (before and before[1]) != (since and since[1]):
            if before:
                self.handle.deleteTimer(before[1])
            if since:
                self.handle.registerTimer(since[1])
        return (DECISION(*key, *r) for r in out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        ledger, staged = self._ledger()
        out = list(ledger.expire(staged[0] + 1)) if staged else []
        if staged:
            self._put(ledger, None)
        return (DECISION(*key, *r) for r in out)

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay_stream(events: DataFrame, most: int = 3, keep_ms: int | None = None) -> DataFrame:
    """The same over a stream of events (run, seq, kind, units): a run's ledger is its state. Events of a run must arrive in order.

    With keep_ms the events also have `at`, with a watermark, and staged batches expire. State lives in RocksDB, as timers ask for.
    """
    events.sparkSession.conf.set(STORE, ROCKS)
    kind = events.schema["run"].dataType.simpleString()
    mode = "None" if keep_ms is None else "EventTime"
    return events.groupBy("run").transformWithState(Keeper(most, keep_ms), f"run {kind}, {OUT}", "Append", mode)
