"""Structured Streaming jobs over the batch operators.

Order-dependent state (counters, open segments) is kept as small tables updated in
foreachBatch: rows of one batch go through the chunked batch operators, so a key with a
third of the events does not end in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators import state as st
from tilewright.operators.ordered import has_hot_group, islands, number_rows, running
from tilewright.session import STATE_STORE, ship_package
from tilewright.streaming.tables import BatchOutput, BucketedTable

# fixed values: event names of the annotation backend (both spellings of the delete event)
CREATED, UPDATED = "ANNOTATION_CREATED", "ANNOTATION_UPDATED"
DELETED = ["ANNOTATION_DELETED", "ANNOTATIONS_DELETED"]
START = "START_TRAINING"
RETRY_DELAY, RATE_LIMIT_DELAY, MAX_TRIES = 10, 60, 5


def file_stream(spark: SparkSession, directory: str, name: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Stream the files of a folder whose name matches `name`."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run over what is there now, append to parquet, return the result."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    def guarded(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            step(batch, batch_id)
        finally:
            batch.unpersist()

    query = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# ---- discovery and progress ---------------------------------------------


def stream_discover(images: DataFrame) -> DataFrame:
    """Image rows of many sub-boxes, each id once for ever: the first row that arrives is inserted, later ones are ignored.

    There is no watermark, so no id is forgotten and no late row is lost; the ids are kept in
    the RocksDB state store, dealt by key, which grows with them as the table of ids does.
    """
    return images.withColumn("image_id", F.col("image_id").cast("string")).dropDuplicates(["image_id"])


def stream_progress(changes: DataFrame, window: str, delay: str, time_col: str = "ts") -> DataFrame:
    """Status changes per tumbling window; late rows are dropped."""
    counted = changes.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "status", "n")


def stream_sessions(changes: DataFrame, gap: str, delay: str, key: str, time_col: str = "ts") -> DataFrame:
    """Activity sessions per key, merged within partitions before the shuffle."""
    changes.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    found = changes.withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


# ---- keyed tables --------------------------------------------------------


def stream_status(changes: DataFrame, base: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Status events (keys, status, at, id, stamp columns) applied to a state table.

    The table keeps (at, id) of the event that set a row, so an event that arrives in a later
    batch than a newer one changes nothing: the result does not depend on batch borders.
    """
    spark, keys = changes.sparkSession, list(keys)
    table = BucketedTable(spark, path, keys)
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    table.write(base.select("*", *[F.lit(None).cast(kinds[c]).alias(f"_{c}") for c in ("at", "id")]), 0)

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = table.touched(batch)
        before = table.read(batch_id, touched)
        last = st.latest_per_key(batch, keys, [F.desc("at"), F.desc("id")])
        stored = before.select(*keys, "_at", "_id")
        newer = F.col("_at").isNull() | (F.struct("at", "id") > F.struct("_at", "_id"))
        fresh = last.join(stored, keys, "left").filter(newer).drop("_at", "_id").withColumnsRenamed({"at": "_at", "id": "_id"})
        table.write(st.update_status(before, fresh, keys), batch_id + 1, touched)

    run_batches(changes, step, checkpoint)
    return table.read().drop("_at", "_id")


def stream_annotations(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Annotation events (ID, action, at, seq, values) to a table: insert, replace, remove.

    Rows keep (at, seq), and a removed one stays as a tombstone, so an older event of a later
    batch neither overwrites a newer value nor brings a removed annotation back.
    """
    spark = events.sparkSession
    table = BucketedTable(spark, path, ["ID"])

    def step(batch: DataFrame, batch_id: int) -> None:
        known = batch.filter(F.col("action").isin(CREATED, UPDATED, *DELETED)).withColumn("_gone", F.col("action").isin(*DELETED)).drop("action")
        touched = table.touched(known)
        last = st.latest_per_key(known, ["ID"], [F.desc("at"), F.desc("seq")])
        before = table.read(batch_id, touched)
        if before is not None:
            last = st.latest_per_key(before.unionByName(last), ["ID"], [F.desc("at"), F.desc("seq")])
        table.write(last, batch_id + 1, touched)

    run_batches(events, step, checkpoint)
    return table.read().filter(~F.col("_gone")).drop("_gone", "at", "seq")


def stream_train_trigger(events: DataFrame, n: int, out: str, state: str, checkpoint: str) -> DataFrame:
    """A trigger row when a project's labelled-task count is a multiple of n, or on a start event.

    `events` has project, action, at, id. Deletes lower the count and trigger nothing, as
    do unknown actions.
    """
    spark = events.sparkSession
    table, output = BucketedTable(spark, state, ["project"]), BatchOutput(spark, out)
    delta = F.when(F.col("action") == CREATED, 1).when(F.col("action").isin(*DELETED), -1).otherwise(0).cast("bigint")

    def step(batch: DataFrame, batch_id: int) -> None:
        known = batch.filter(F.col("action").isin(CREATED, UPDATED, START, *DELETED)).withColumn("_delta", delta)
        counted = running(known, ["project"], ["at", "id"], sums={"_sum": F.col("_delta")})
        touched = table.touched(known)
        before = table.read(batch_id, touched)
        if before is None:
            before = batch.select("project", F.lit(0).cast("bigint").alias("tasks")).limit(0)
        joined = counted.join(before, "project", "left").withColumn("tasks", F.coalesce("tasks", F.lit(0)) + F.col("_sum"))
        due = (F.col("action") == START) | (F.col("action").isin(CREATED, UPDATED) & (F.col("tasks") % n == 0))
        output.write(joined.filter(due).select("project", "at", "id", "action", "tasks"), batch_id)
        sums = known.groupBy("project").agg(F.sum("_delta").alias("_sum"))
        after = before.join(sums, "project", "full").select("project", (F.coalesce("tasks", F.lit(0)) + F.coalesce("_sum", F.lit(0))).alias("tasks"))
        table.write(after, batch_id + 1, touched)

    run_batches(events, step, checkpoint)
    return output.read()


def stream_retry(events: DataFrame, out: str, state: str, checkpoint: str, tries: int = MAX_TRIES) -> DataFrame:
    """Retry rows for failing items: action, attempt and the delay before the next try.

    `events` has item, outcome in ok / error / rate_limit, at, id. The `tries`-th error in
    a row fails the item; a rate limit waits longer and is not counted; ok starts over.
    """
    spark = events.sparkSession
    table, output = BucketedTable(spark, state, ["item"]), BatchOutput(spark, out)

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = table.touched(batch)
        before = table.read(batch_id, touched)
        if before is None:
            before = batch.select("item", F.lit(0).cast("bigint").alias("errors")).limit(0)
        is_ok, is_error = F.col("outcome") == "ok", F.col("outcome") == "error"
        hot = has_hot_group(batch, ["item"])
        grouped = running(batch, ["item"], ["at", "id"], sums={"_g": is_ok.cast("bigint")}, hot=hot).persist()  # used three times
        errors = number_rows(grouped.filter(is_error), ["item", "_g"], ["at", "id"], "_k", hot=None if hot else False)
        errors = errors.join(before, "item", "left").withColumn("_k", F.col("_k") + F.when(F.col("_g") == 0, F.coalesce("errors", F.lit(0))).otherwise(0))
        attempt = (F.col("_k") - 1) % tries + 1
        failed = attempt == tries
        rows = errors.select(
            "item", "at", "id", attempt.alias("attempt"), F.when(failed, "failed").otherwise("retry").alias("action"),
            F.when(~failed, F.lit(RETRY_DELAY)).alias("delay"),
        )
        waits = batch.filter(F.col("outcome") == "rate_limit").select(
            "item", "at", "id", F.lit(None).cast("bigint").alias("attempt"), F.lit("retry").alias("action"), F.lit(RATE_LIMIT_DELAY).alias("delay")
        )
        output.write(rows.unionByName(waits), batch_id)
        # errors after an item's last ok carry on into the next batch
        last = grouped.groupBy("item").agg(F.max("_g").alias("_g"))
        tail = grouped.filter(is_error).groupBy("item", "_g").agg(F.count("*").alias("_n"))
        fresh = last.join(tail, ["item", "_g"], "left").join(before, "item", "full")
        total = F.coalesce("_n", F.lit(0)) + F.when(F.coalesce("_g", F.lit(0)) == 0, F.coalesce("errors", F.lit(0))).otherwise(0)
        table.write(fresh.select("item", (total % tries).alias("errors")), batch_id + 1, touched)
        grouped.unpersist()

    run_batches(events, step, checkpoint)
    return output.read()


# ---- timers --------------------------------------------------------------


def _timeout_processor(timeout_ms: int, flying: str):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Timeouts(StatefulProcessor):
        """Keeps the newest status of an item and one timer while it is in flight."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("status", T.StringType())])
            self.last = handle.getValueState("last", schema)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            best = self.last.get() if self.last.exists() else None
            for frame in rows:  # one batch of rows at a time, only the newest is kept
                at = frame["ts"].astype("datetime64[us, UTC]" if frame["ts"].dt.tz is not None else "datetime64[us]").astype("int64")
                newest = frame.assign(at=at).sort_values(["at", "id"]).iloc[-1]
                candidate = (int(newest["at"]), int(newest["id"]), str(newest["status"]))
                if best is None or candidate[:2] > tuple(best)[:2]:
                    best = candidate
            self.last.update(tuple(best))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if best[2] == flying:
                self.handle.registerTimer(best[0] // 1000 + timeout_ms)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            at = expiredTimerInfo.getExpiryTimeInMs()
            self.last.clear()
            yield pd.DataFrame({"item": [key[0]], "status": ["pending"], "expired_ms": [at]})

        def close(self) -> None:
            pass

    return Timeouts()


def stream_timeouts(changes: DataFrame, timeout_ms: int, delay: str, flying: str = "in_progress") -> DataFrame:
    """Items in flight for longer than the timeout go back to pending, on an event-time timer.

    `changes` has item (bigint), status, ts, id.
    """
    ship_package(changes.sparkSession)
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("status", T.StringType()), T.StructField("expired_ms", T.LongType())])
    return changes.withWatermark("ts", delay).groupBy("item").transformWithStateInPandas(
        statefulProcessor=_timeout_processor(timeout_ms, flying), outputStructType=schema, outputMode="Append", timeMode="eventTime"
    )


# ---- online segments -----------------------------------------------------


def _batch_segments(rows: DataFrame) -> DataFrame:
    runs = islands(rows.select("seq_id", "t", "label", "score"), ["seq_id"], ["t"], ["label"], "_run")
    return runs.groupBy("seq_id", "_run").agg(
        F.first("label").alias("label"), F.min("t").alias("start"), F.max("t").alias("end"), F.sum("score").alias("total"), F.count("*").alias("n")
    ).drop("_run")


def stream_segments(rows: DataFrame, out: str, state: str, checkpoint: str, timeout: int | None = None, flush: bool = True) -> DataFrame:
    """Runs of equal labels, emitted when the label changes or the key has been silent.

    Each batch is cut into runs by the batch operator; the open run of a key is joined to
    its first new run, and the last run of each key stays open. `rows` arrive in order of
    t between batches. With `flush` the open runs are part of the result.
    """
    spark = rows.sparkSession
    table, output = BucketedTable(spark, state, ["seq_id"]), BatchOutput(spark, out)
    columns = ["seq_id", "label", "start", "end", "total", "n"]

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = _batch_segments(batch).select(*columns)
        touched = table.touched(batch) if timeout is None else None  # a silent key of any bucket may time out
        before = table.read(batch_id, touched)
        if before is None:
            merged = fresh
        else:
            ends = fresh.groupBy("seq_id").agg(F.min("start").alias("_first"), F.min_by("label", "start").alias("_label"))
            held = before.join(ends, "seq_id", "left")
            joins = F.coalesce(F.col("label") == F.col("_label"), F.lit(False))
            grow = held.filter(joins).select("seq_id", F.col("_first").alias("start"), F.col("start").alias("_s"), F.col("total").alias("_t"), F.col("n").alias("_n"))
            longer = fresh.join(grow, ["seq_id", "start"], "left").select(
                "seq_id", "label", F.coalesce("_s", "start").alias("start"), "end", (F.col("total") + F.coalesce("_t", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")
            )
            merged = longer.unionByName(held.filter(~joins).select(*columns))
        last = merged.groupBy("seq_id").agg(F.max("start").alias("_last"))
        marked = merged.join(last, "seq_id").withColumn("_open", F.col("start") == F.col("_last"))
        if timeout is not None:
            now = batch.agg(F.max("t").alias("now")).scalar()
            marked = marked.withColumn("_open", F.col("_open") & (F.col("end") + timeout > now))
        marked = marked.persist()  # written twice
        try:
            output.write(marked.filter(~F.col("_open")).select(*columns), batch_id)
            table.write(marked.filter("_open").select(*columns), batch_id + 1, touched)
        finally:
            marked.unpersist()

    run_batches(rows, step, checkpoint)
    done = output.read()
    if flush:
        done = done.unionByName(table.read())
    return done.select("seq_id", "label", "start", "end", (F.col("total") / F.col("n")).alias("score"))


__all__ = [
    "file_stream", "run_batches", "run_to_files", "stream_annotations", "stream_discover", "stream_progress", "stream_retry",
    "stream_segments", "stream_sessions", "stream_status", "stream_timeouts", "stream_train_trigger",
]
