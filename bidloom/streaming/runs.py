"""Run state as streams: transitions, stalls, retries, and windows over calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Which states may follow which; done, failed and dead are final.
FOLLOWS = {
    "": ("queued",),
    "queued": ("running", "failed"),
    "running": ("running", "paused", "done", "failed", "queued"),
    "paused": ("running", "queued", "failed"),
}
MOST_ATTEMPTS = 5


def advance(state: str, attempt: int, wanted: str) -> tuple[str, int, str]:
    """(state, attempt, effect) of a wanted transition: moved, refused, or dead after the last attempt."""
    if wanted not in FOLLOWS.get(state, ()):
        return state, attempt, "refused"
    if state == "running" and wanted == "queued":
        attempt += 1
        if attempt >= MOST_ATTEMPTS:
            return "dead", attempt, "moved"
    return wanted, attempt, "moved"


def replayed(events: list[str]) -> list[tuple[str, int, str]]:
    state, attempt, out = "", 0, []
    for wanted in events:
        state, attempt, effect = advance(state, attempt, wanted)
        out.append((state, attempt, effect))
    return out


OUTPUT = StructType([StructField("run_id", LongType()), StructField("ord", LongType()), StructField("state", StringType()), StructField("attempt", IntegerType()), StructField("effect", StringType())])


class RunState(StatefulProcessor):
    """Compare-and-set transitions of one run, in the order of ord within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("state", StringType()), StructField("attempt", IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, attempt = self.state.get() if self.state.exists() else ("", 0)
        df = pd.concat(list(rows)).sort_values("ord", kind="stable")
        out = []
        for ord_, wanted in zip(df["ord"], df["wanted"], strict=True):
            state, attempt, effect = advance(state, attempt, wanted)
            out.append((key[0], ord_, state, attempt, effect))
        self.state.update((state, attempt))
        yield pd.DataFrame(out, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def transitions(stream: DataFrame) -> DataFrame:
    """State after every event of a stream (run_id, ord, wanted)."""
    return stream.groupBy("run_id").transformWithStateInPandas(RunState(), OUTPUT, "Append", "None")


def batch_transitions(events: DataFrame) -> DataFrame:
    """The same over a table: a run's events are few and meet in one group."""

    def run(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ord", kind="stable")
        return pd.DataFrame([(key[0], o, *r) for o, r in zip(df["ord"], replayed(list(df["wanted"])), strict=True)], columns=OUTPUT.names)

    return events.select("run_id", "ord", "wanted").groupBy("run_id").applyInPandas(run, OUTPUT)


def call_windows(stream: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls per key in tumbling or sliding windows; later than the watermark is dropped. stream: key, at (timestamp)."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return stream.withWatermark("at", late).groupBy(w.alias("w"), "key").agg(F.count("*").alias("calls")).select("w.start", "w.end", "key", "calls")


def sessions(stream: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches of heartbeats without a longer gap: a run is stalled once its session closes."""
    s = F.session_window("at", gap)
    return stream.withWatermark("at", late).groupBy(s.alias("s"), "key").agg(F.count("*").alias("beats")).select("s.start", "s.end", "key", "beats")


def once_per_key(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """At most one active run per key: later starts within the watermark are dropped."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["key"])
