"""Per-user flags folded from a stream of on and off events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FLAGS = ("bookmarked", "practiced")


def flag_state(events: DataFrame) -> DataFrame:
    """One row for each user and identity with a flag on; `<flag>_at` is the last time it was switched on.

    `events` is `(event_id, ts, user_id, f_id, flag, is_on)`. The last event of a flag decides.
    """
    return _folded(events).filter(F.col(FLAGS[0]) | F.col(FLAGS[1]))


def _folded(events: DataFrame, *more: Column) -> DataFrame:
    at = F.struct("ts", "event_id")
    cols = []
    for f in FLAGS:
        mine = F.col("flag") == f
        cols += [F.coalesce(F.max_by("is_on", F.when(mine, at)), F.lit(False)).alias(f), F.max(F.when(mine & F.col("is_on"), F.col("ts"))).alias(f"{f}_at")]
    return events.groupBy("user_id", "f_id").agg(*cols, *more)


OUT = "user_id long, f_id long, bookmarked boolean, bookmarked_us long, practiced boolean, practiced_us long, version long"
STATE = ", ".join(f"{f}_{c}" for f in FLAGS for c in ("on boolean", "key string", "us long"))  #: of each flag: its value, the event that decided it, when it last went on
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FlagProcessor(StatefulProcessor):
    """Keeps the flags of one user and identity. Events may come late: each flag knows the event that decides it.

    With `expiry_ms` the state of a pair without events for so long goes, and its next events start anew.
    """

    def __init__(self, expiry_ms: int | None = None):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("flags", STATE, self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        events = parts[0] if len(parts) == 1 else pd.concat(parts)
        order, at, flags, on = (events[c].to_numpy() for c in ("order", "us", "flag", "is_on"))
        values: list = list(self.held.get()) if self.held.exists() else [False, "", None] * len(FLAGS)
        for i, flag in enumerate(FLAGS):
            mine = np.flatnonzero(flags == flag)
            if not len(mine):
                continue
            last = mine[order[mine].argmax()]
            if order[last] > values[3 * i + 1]:
                values[3 * i : 3 * i + 2] = bool(on[last]), order[last]
            switched = at[mine[on[mine].astype(bool)]]
            if len(switched):
                values[3 * i + 2] = int(max(switched.max(), values[3 * i + 2] or switched.max()))
        self.held.update(tuple(values))
        out = {"user_id": [key[0]], "f_id": [key[1]]}
        for i, flag in enumerate(FLAGS):
            out[flag], out[f"{flag}_us"] = [values[3 * i]], pd.array([values[3 * i + 2]], dtype="Int64")
        yield pd.DataFrame(out | {"version": [int(events["event_id"].max())]})

    def close(self) -> None:
        pass


def stream_flag_state(events: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """The same as an updating stream; both-off rows are sent too, so that a sink can drop them.

    A streaming aggregation keeps the state of each pair, without a call for it. Only with an expiry
    FlagProcessor keeps it. Its state needs the store that is named PROVIDER.
    """
    if expiry_ms:
        return processed_flag_state(events, expiry_ms)
    return _folded(events.withColumn("ts", F.col("ts").cast("timestamp")), F.max("event_id").alias("version")).select("user_id", "f_id", FLAGS[0], f"{FLAGS[0]}_at", FLAGS[1], f"{FLAGS[1]}_at", "version")


def processed_flag_state(events: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """`stream_flag_state` by FlagProcessor: a call of some milliseconds for each pair of a batch.

    With an expiry, a query that runs to the end of its input never ends, since time alone may change
    its state; run it with a processing-time trigger.
    """
    kind = "ProcessingTime" if expiry_ms else "None"
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    keyed = events.select("user_id", "f_id", "flag", "is_on", "event_id", us.alias("us"), F.format_string("%020d-%020d", us, "event_id").alias("order"))
    states = keyed.groupBy("user_id", "f_id").transformWithStateInPandas(FlagProcessor(expiry_ms), OUT, "Update", kind)
    at = [F.timestamp_micros(f"{f}_us").alias(f"{f}_at") for f in FLAGS]
    return states.select("user_id", "f_id", FLAGS[0], at[0], FLAGS[1], at[1], "version")


@contextmanager
def state_store(spark: SparkSession, provider: str = PROVIDER):
    """Queries started inside keep their state in `provider`."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
