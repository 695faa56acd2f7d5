"""Streams of positions and triggers: the same results as the batch operators, with bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.operators.lineage import written
from driftline.operators.relational import first_per_key


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key has not come within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Rows by UTC window and keys."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n")


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    """The stream with a watermark on its whole seconds ``at``."""
    return stream.withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", delay)


#: Groups that keys are dealt into by their hash; fixed for the life of a stream's checkpoint.
BUCKETS = 1024


def _by_bucket(stream: DataFrame, keys: dict[str, str], values: list[str], step: Callable, fields: dict[str, str], result: dict[str, str], idle_s: int, delay: str, buckets: int) -> DataFrame:
    """Rows (keys, time, ``result``) of what ``step`` finds in each key's rows, by order of ``values``, the time first.

    ``step`` takes the key's state, None at first, and a row's values, and gives
    the next state, whose last field is a time, and a list of found tuples.
    A call of pandas costs far more than a key's few rows, so it is made for a
    bucket of keys; the bucket's state holds its keys' states in columns. A
    key's state lasts until the watermark is ``idle_s`` beyond its last time
    and beyond the watermark at its last row.
    """
    names, time = list(keys), values[0]

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark, kept, until, touched, out = state.getCurrentWatermarkMs(), {}, {}, set(), []
        if state.exists:
            held = list(zip(*state.get))
            kept = {row[: len(names)]: row[len(names) : -1] for row in held}
            until = {row[: len(names)]: row[-1] for row in held}
        if not state.hasTimedOut:
            rows = pd.concat([f[[*names, *(f"_no_{k}" for k in names), *values]] for f in frames]).sort_values(values, kind="stable")
            for row in rows.astype({time: "int64"}).itertuples(index=False, name=None):
                key = tuple(None if no else k for k, no in zip(row, row[len(names) : 2 * len(names)]))
                kept[key], found = step(kept.get(key), *row[2 * len(names) :])
                touched.add(key)
                out += [(*key, row[2 * len(names)], *f) for f in found]
        for key in touched:
            until[key] = max(kept[key][-1] * 1000, watermark) + idle_s * 1000
        held = [(*key, *kept[key], until[key]) for key in kept if until[key] >= watermark]
        if held:
            state.update(tuple(list(column) for column in zip(*held)))
            state.setTimeoutTimestamp(min(row[-1] for row in held))
        else:
            state.remove()
        if out:
            # nullable numbers, so that none goes through a double
            kinds = {**keys, time: "long", **result}
            yield pd.DataFrame({n: pd.array(c, dtype="Int64") if kinds[n] == "long" else pd.Series(c, dtype=object) for n, c in zip(kinds, map(list, zip(*out)))})

    schema = lambda kinds, kind="{}": ", ".join(f"{n} {kind.format(k)}" for n, k in kinds.items())
    known = [F.coalesce(k, F.lit("" if kind == "string" else 0).cast(kind)).alias(k) for k, kind in keys.items()]
    rows = _timed(stream, delay).select(F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("_bucket"), *known, *(F.isnull(k).alias(f"_no_{k}") for k in names), *values, "_ts")
    held = schema({**keys, **{f"_{n}": k for n, k in fields.items()}, "_until": "long"}, "array<{}>")
    return rows.groupBy("_bucket").applyInPandasWithState(run, schema({**keys, time: "long", **result}), held, "append", GroupStateTimeout.EventTimeTimeout)


def with_cooldown(stream: DataFrame, cooldown_s: int, idle_s: int, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Triggers (session_id, trigger, at) of which none follows an emitted one of its kind within the cooldown.

    The state of a session and trigger is the time of the last one emitted.
    Rows of one batch are taken in order of time; one that comes after a later
    one was emitted is within its cooldown or before it, and is not emitted.
    The state goes once no row has come for ``idle_s``, at least the cooldown.
    """
    if idle_s < cooldown_s:
        raise ValueError("state that goes before its cooldown ends would emit too early")

    def step(now: tuple | None, at: int) -> tuple[tuple, list[tuple]]:
        return ((at,), [()]) if now is None or at - now[0] >= cooldown_s else (now, [])

    return _by_bucket(stream, {"session_id": "long", "trigger": "string"}, ["at"], step, {"last": "long"}, {}, idle_s, delay, buckets)


# Metres at which a waypoint is approached, reached and left again, and what confirms an arrival.
APPROACH_M, ARRIVE_M, DEPART_M = 150.0, 60.0, 100.0
CONFIRM_SAMPLES, CONFIRM_S = 4, 30


def next_state(now: tuple, at: int, metres: float, skipped: bool, radii: tuple[float, float, float] = (APPROACH_M, ARRIVE_M, DEPART_M), samples: int = CONFIRM_SAMPLES, seconds: int = CONFIRM_S) -> tuple[tuple, list[str]]:
    """(state, samples inside, first of them, last time) after one position, and the states entered.

    An arrival needs enough samples in a row inside the arrival radius over
    enough time, and is fishing at once; the radii differ, so a position near
    one of them does not flip the state.
    """
    state, inside, first, _ = now
    approach, arrive, depart = radii
    entered: list[str] = []
    inside, first = (inside + 1, first if inside else at) if metres <= arrive else (0, at)
    if skipped and state not in ("COMPLETED", "SKIPPED"):
        entered = ["SKIPPED"]
    elif state in ("UPCOMING", "NAVIGATING"):
        if inside >= samples and at - first >= seconds:
            entered = ["ARRIVED", "FISHING"]
        elif state == "UPCOMING" and metres <= approach:
            entered = ["NAVIGATING"]
    elif state == "FISHING" and metres > depart:
        entered = ["COMPLETED"]
    return (entered[-1] if entered else state, inside, first, at), entered


def waypoint_states(stream: DataFrame, idle_s: int, delay: str = "1 day", buckets: int = BUCKETS, **limits) -> DataFrame:
    """State changes (session_id, waypoint_id, at, state) from rows (session_id, waypoint_id, at, metres, skipped).

    Rows of a batch are taken in order of time; one that is older than what a
    former batch has settled is too late and changes nothing. A waypoint that
    no row comes of for ``idle_s`` is forgotten, and would begin anew after it.
    """

    def step(now: tuple | None, at: int, metres: float, skipped: bool) -> tuple[tuple, list[tuple]]:
        now = now or ("UPCOMING", 0, 0, -(2**62))
        if at < now[3]:
            return now, []
        now, entered = next_state(now, at, metres, skipped, **limits)
        return now, [(e,) for e in entered]

    known = stream.withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    fields = {"state": "string", "inside": "long", "first": "long", "last": "long"}
    return _by_bucket(known, {"session_id": "long", "waypoint_id": "long"}, ["at", "metres", "skipped"], step, fields, {"state": "string"}, idle_s, delay, buckets)


def replayed(df: DataFrame, folder: str) -> DataFrame:
    """A stream of the rows of ``df``, by way of files in ``folder``."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


#: Rows of a replayed file, about.
FILE_ROWS = 250_000


def replayed_in_order(df: DataFrame, folder: str, order: str, batches: int) -> DataFrame:
    """A stream of the rows of ``df`` in ``batches`` micro-batches by ``order``, so that state lives on between them.

    A micro-batch is a number of files, the same for all. A batch is dealt over
    its files in turn, so with this many rows none of them is empty.
    """
    place = F.ntile(batches).over(Window.orderBy("_bucket"))
    # ranges of the order's values by their buckets, which are few, so that no row is sorted in one task
    span = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    width = max(1, ((span["high"] or 0) - (span["low"] or 0)) // (64 * batches) + 1)
    bucketed = df.withColumn("_bucket", F.floor((F.col(order) - (span["low"] or 0)) / width))
    files = bucketed.select("_bucket").distinct().withColumn("_file", place)
    rows = written(bucketed.join(F.broadcast(files), "_bucket"))
    # as many as the smallest batch can fill
    sizes = [r["n"] for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()]
    n = max(1, min([s // FILE_ROWS for s in sizes], default=1))
    for i in range(1, batches + 1):
        batch = rows.filter(F.col("_file") == i).select(*df.columns)
        (batch.coalesce(1) if n == 1 else batch.repartition(n)).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(folder)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream has to give now, written to ``folder`` and read again."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def upsert_latest(path: str, keys: list[str], time: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the latest row of each key below ``path``.

    Each batch writes the next version of the projection, named by the batch,
    so a repeated batch overwrites its own version and no other. Versions
    before the last ``keep`` are removed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, spark = batch, batch.sparkSession
        if batch_id:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/version={batch_id - 1}"))
        first_per_key(rows, keys, F.desc(time)).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        if batch_id >= keep:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch_id - keep}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write
