"""A circuit breaker over a log of calls, as a batch and as a stream.

After ``THRESHOLD`` failures in a row a key's breaker opens; calls within the
next ``COOL`` seconds are skipped, so their answers count neither as failures
nor as successes; the first call after that probes again from zero.  Both forms
run the same step over a key's calls in order of time, and keep two numbers a
key: in the batch a sorted partition streams by, so no key is gathered.

Defined cases: calls without a time come first and never end a cool-down; calls
of one time go by their id; a null key is a key.  The stream takes files in
the order in which they arrive; within a micro-batch it sorts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import folder
from .windows import source

THRESHOLD, COOL = 2, 900
CALLS = "event_id long, user_id long, ts timestamp_ntz, outcome string, opens boolean"
STATE = "failures int, opened double"


def step(failures: int, opened: float | None, at: float, failed: bool) -> tuple[int, float | None, str, bool]:
    """The breaker after one call: failures in a row, when it opened, what
    became of the call, and whether it opened the breaker."""
    if opened is not None and at - opened < COOL:
        return failures, opened, "SKIPPED", False
    failures = (failures if opened is None else 0) + 1 if failed else 0
    opens = failures >= THRESHOLD
    return failures, at if opens else None, "FAILED" if failed else "ANSWERED", opens


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64").where(ts.notna(), 0) / 1e6


def _walk(rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    """Rows in order with their outcomes; ``state`` is (key, failures, opened)."""
    key, failures, opened = state
    outcome, opens = [], []
    for k, at, failed in zip(rows["_k"], _seconds(rows["ts"]), rows["failed"]):
        if k != key:
            key, failures, opened = k, 0, None
        failures, opened, what, now = step(failures, opened, at, failed)
        outcome.append(what)
        opens.append(now)
    return rows.assign(outcome=outcome, opens=opens)[["event_id", "user_id", "ts", "outcome", "opens"]], (key, failures, opened)


def _calls(log: DataFrame) -> DataFrame:
    return log.select("event_id", "user_id", "ts", F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"), F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("_k"))


def calls(log: DataFrame) -> DataFrame:
    """Every call of a log (event_id, user_id, ts, event_type) with its outcome."""

    def run(batches):
        state = (None, 0, None)
        for rows in batches:
            out, state = _walk(rows, state)
            yield out

    return _calls(log).repartition("_k").sortWithinPartitions("_k", "ts", "event_id").mapInPandas(run, CALLS)


def stream_calls(spark: SparkSession, path: str) -> DataFrame:
    """The same from a stream over all files there are."""
    out_dir = folder(spark)

    def run(key, frames, state: GroupState):
        failures, opened = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], na_position="first")
        out, (_, failures, opened) = _walk(rows, (key[0], failures, opened))
        state.update((failures, opened))
        yield out

    told = _calls(source(spark, path)).groupBy("_k").applyInPandasWithState(run, CALLS, STATE, "append", GroupStateTimeout.NoTimeout)
    stream = told.writeStream.outputMode("append").format("parquet").option("path", f"{out_dir}/out").option("checkpointLocation", f"{out_dir}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(CALLS).parquet(f"{out_dir}/out")
