"""Progress of runs as keyed state: trailing rate, time left, throttled reports, silence.

A run's events go, in the order of their times, through a small state that Spark keeps
for each run (``RunState``): the last 64 steps and their times, the last report, status
and stage.  A report is due when the last one is ``interval`` seconds old, and at once when
a stage starts or the run ends.  The state lives in the stream's checkpoint, so a
restarted stream goes on where it was; a timer reports runs that have fallen silent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WIDTH, LEAST = 64, 4
TERMINAL = ("done", "failed", "aborted")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_DDL = "status string, started double, reported double, last double, step long, total long, times array<double>, steps array<long>"
REPORT = "run string, at double, key long, status string, step long, total long, pct double, eta_seconds double, elapsed_seconds double"


@dataclass
class RunState:
    """What is kept of one run."""

    status: str = "running"
    started: float | None = None
    reported: float | None = None
    last: float | None = None
    step: int | None = None
    total: int | None = None
    times: list[float] = field(default_factory=list)
    steps: list[int] = field(default_factory=list)

    def eta(self) -> float | None:
        """Seconds left at the rate of the trailing window; None if that says nothing."""
        if not self.step or not self.total or len(self.steps) < LEAST:
            return None
        if self.steps[-1] <= self.steps[0] or self.times[-1] <= self.times[0]:
            return None
        return round((self.total - self.step) * (self.times[-1] - self.times[0]) / (self.steps[-1] - self.steps[0]), 1)

    def observe(self, at: float, kind: str, step: int | None, total: int | None, interval: float) -> bool:
        """Takes one event; whether a report is due.  ``stage`` events clear progress and window; terminal kinds end the run."""
        self.started = at if self.started is None else self.started
        self.last = at
        if kind == "stage":
            self.status, self.step, self.total, self.times, self.steps = "running", None, None, [], []
        elif kind in TERMINAL:
            self.status = kind
        elif step is not None:
            self.step, self.total = step, total if total is not None else self.total
            self.times, self.steps = [*self.times, at][-WIDTH:], [*self.steps, step][-WIDTH:]
        due = kind == "stage" or kind in TERMINAL or self.reported is None or at - self.reported >= interval
        self.reported = at if due else self.reported
        return due

    def report(self, run: str, at: float, key: int | None, status: str | None = None) -> tuple:
        share = round(100 * self.step / self.total, 2) if self.step and self.total else None
        return run, at, key, status or self.status, self.step, self.total, share, self.eta(), round(at - self.started, 1)


def fold(run: str, state: RunState, events: pd.DataFrame, interval: float) -> list[tuple]:
    """Reports of a run's events (at, key, kind, step, total), taken in the order of time and key."""
    whole = lambda x: None if pd.isna(x) else int(x)
    ordered = events.sort_values(["at", "key"], kind="stable")
    found = []
    for at, key, kind, step, total in zip(ordered["at"], ordered["key"], ordered["kind"], ordered["step"], ordered["total"], strict=True):
        if state.observe(float(at), kind, whole(step), whole(total), interval):
            found.append(state.report(run, float(at), whole(key)))
    return found


def as_frame(rows: Iterable[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in REPORT.split(", ")]
    frame = pd.DataFrame(list(rows), columns=names)
    return frame.astype({"key": "Int64", "step": "Int64", "total": "Int64"})


class Reporter(StatefulProcessor):
    """Keeps ``RunState`` for each run of a stream; a timer reports ``stale`` after ``silence`` seconds without an event."""

    def __init__(self, interval: float, silence: float) -> None:
        self.interval, self.silence = interval, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("run", STATE_DDL)

    def load(self) -> RunState:
        if not self.kept.exists():
            return RunState()
        status, *numbers, times, steps = self.kept.get()
        return RunState(status, *numbers, list(times), list(steps))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.load()
        found = fold(key[0], state, pd.concat(list(rows)), self.interval)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state.status not in TERMINAL:
            self.handle.registerTimer(int((state.last + self.silence) * 1000))
        self.kept.update(astuple(state))
        yield as_frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.load()
        yield as_frame([state.report(key[0], state.last + self.silence, None, "stale")])


def as_events(rows: DataFrame, run: Column, time: Column, key: Column, kind: Column, step: Column, total: Column) -> DataFrame:
    """Columns run, at (seconds), ts, key, kind, step, total, as the functions below want them."""
    return rows.select(
        run.cast("string").alias("run"), time.cast("double").alias("at"), time.cast("timestamp").alias("ts"), key.cast("long").alias("key"), kind.alias("kind"), step.cast("long").alias("step"), total.cast("long").alias("total")
    )


def reports(events: DataFrame, interval: float) -> DataFrame:
    """All reports of a whole log: every run folded where its rows lie, one after the other as they are."""

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return as_frame(fold(key[0], RunState(), pdf, interval))

    return events.select("run", "at", "key", "kind", "step", "total").groupBy("run").applyInPandas(of, REPORT)


def report_stream(events: DataFrame, interval: float, silence: float = 300.0, late: str = "0 seconds") -> DataFrame:
    """The same over a stream, event by event as they arrive; the session must use the RocksDB state store (``STATE_STORE``)."""
    keyed = events.withWatermark("ts", late).groupBy("run")
    return keyed.transformWithStateInPandas(statefulProcessor=Reporter(interval, silence), outputStructType=REPORT, outputMode="Append", timeMode="EventTime")
