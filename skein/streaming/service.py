"""Rate windows, seen-once tokens, change feeds, reuse and drift on streams; each has a batch twin with equal results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bounded_source(spark, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:  # noqa: ANN001
    """A queue of files: at most so many are taken per trigger, the rest waits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def rate_windows(events: DataFrame, time: str, key: str, size: str, late: str | None = None) -> DataFrame:
    """Hits per key in tumbling windows aligned to the epoch; a watermark lets a stream close them."""
    df = events.withWatermark(time, late) if late else events
    return df.groupBy(key, F.window(time, size)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def admitted(events: DataFrame, time: str, key: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Batch twin of admission with one window: the first `limit` hits of each window pass; rejected hits take up nothing."""
    slot = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    w = Window.partitionBy(key, slot).orderBy(time, order)
    return events.withColumn("admitted", F.row_number().over(w) <= limit)


def admit_stream(events: DataFrame, time: str, key: str, limits: list[tuple[int, int]]) -> DataFrame:
    """Admission with several windows (seconds, limit): a hit passes only if every window has room, and only then counts."""
    schema = f"{key} string, ts timestamp, admitted boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots: dict[int, tuple[int, int]] = {s: (a, n) for s, a, n in (state.get[0] if state.exists else [])}
        rows = []
        for pdf in batches:
            for t in sorted(pdf["ts"]):
                sec = int(t.timestamp())
                now = {s: slots[s] if s in slots and slots[s][0] == sec // s else (sec // s, 0) for s, _ in limits}
                ok = all(now[s][1] < n for s, n in limits)
                slots.update({s: (a, n + ok) for s, (a, n) in now.items()})
                rows.append((k[0], t, ok))
        state.update(([(s, a, n) for s, (a, n) in slots.items()],))
        yield pd.DataFrame(rows, columns=[key, "ts", "admitted"])

    keyed = events.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias("ts"))
    return keyed.groupBy(key).applyInPandasWithState(step, schema, "slots array<struct<s:bigint,a:bigint,n:bigint>>", "append", GroupStateTimeout.NoTimeout)


def seen_once(events: DataFrame, time: str, token: str, ttl: str = "300 seconds") -> DataFrame:
    """The first use of each token within its time to live."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark([token])


def changes_only(states: DataFrame, key: str, time: str, state: str, terminal: Column) -> DataFrame:
    """Batch twin of a change feed: rows whose state differs from the one before, up to the first terminal state."""
    w = Window.partitionBy(key).orderBy(time)
    df = states.withColumn("__p", F.lag(state).over(w)).withColumn("__done", F.coalesce(F.max(terminal.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.filter((F.col("__done") == 0) & (F.col("__p").isNull() | (F.col("__p") != F.col(state)))).drop("__p", "__done")


def change_stream(states: DataFrame, key: str, state: str, terminal: list[str]) -> DataFrame:
    """A change feed: a row leaves only if the state of its key is new; nothing after a terminal state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        rows = []
        for pdf in batches:
            for s in pdf[state]:
                if last not in terminal and s != last:
                    rows.append((k[0], s))
                    last = s
        held.update((last,))
        yield pd.DataFrame(rows, columns=[key, state])

    keyed = states.select(F.col(key).cast("string").alias(key), state)
    return keyed.groupBy(key).applyInPandasWithState(step, f"{key} string, {state} string", "last string", "append", GroupStateTimeout.NoTimeout)


def reusable(asked: DataFrame, results: DataFrame, keys: list[str], time: str, value: str, seconds: int = 600) -> DataFrame:
    """Requests with the last result of their key if it is at most so old."""
    from skein.operators.relate import as_of

    got = as_of(asked, results.withColumn("__at", F.col(time)), keys, time, [value, "__at"], strict=False)
    young = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("prev___at").cast("timestamp")) <= seconds * 1_000_000
    return got.withColumn(value, F.when(young, F.col(f"prev_{value}"))).drop(f"prev_{value}", "prev___at")


def drift_stream(entries: DataFrame, lock: DataFrame) -> DataFrame:
    """Stream-static join: entries whose hash differs from the locked one, or that the lock lacks."""
    j = entries.join(lock.select("entry_key", F.col("content_hash").alias("locked")), "entry_key", "left")
    return j.filter(F.col("locked").isNull() | (F.col("locked") != F.col("content_hash"))).withColumn("state", F.when(F.col("locked").isNull(), "new").otherwise("changed"))


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there and give its result as a table (tests and backfills)."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
