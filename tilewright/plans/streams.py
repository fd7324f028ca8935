"""Queries that run the streaming jobs over the event table with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.plans.registry import query
from tilewright.session import shared_dir
from tilewright.streaming import jobs


PARTS = 4
FILE_ROWS = 250_000  # rows of a part that make one more file


def event_stream(v):
    schema = v.table("events").schema
    return jobs.file_stream(v.spark, v.dir, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def part_stream(v, in_order: bool):
    """The events as four parts, one micro-batch each: in order of the event id, or each part a mix of all times.

    Each part is the same number of files, all with rows, so a batch is as many files as tasks write and read side by side.
    """
    events = v.table("events")
    root = shared_dir(v.spark, "parts")
    part = F.floor(F.col("event_id") * PARTS / (F.col("_most") + 1)) if in_order else F.pmod(F.xxhash64("event_id"), F.lit(PARTS))
    most = events.agg(F.max("event_id").alias("m")).scalar()
    rows = events.withColumn("_most", most).withColumn("_part", part.cast("int")).drop("_most")
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    files = max(1, min(sizes) // FILE_ROWS) if len(sizes) == PARTS else 1
    for k in range(PARTS):  # one after the other: the file source goes by time of writing
        rows.filter(F.col("_part") == k).drop("_part").repartition(files).write.parquet(f"{root}/part={k}")
    reader = v.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return reader.parquet(root).withColumn("ts", F.col("ts").cast("timestamp"))


def folders(v, name):
    root = shared_dir(v.spark, name)
    return f"{root}/out", f"{root}/state", f"{root}/checkpoint"


@query("stream_discover", "select image_id from v_points")
def stream_discover(v):
    out, _, checkpoint = folders(v, "discover")
    events = part_stream(v, in_order=False).select(F.col("event_id").alias("image_id"), "ts")
    twice = events.withColumn("image_id", F.explode(F.array("image_id", "image_id")))  # two overlapping searches
    return jobs.run_to_files(jobs.stream_discover(twice), out, checkpoint).select("image_id")


@query(
    "stream_progress",
    """select start, start + interval 1 day as stop, status, count(*) as n from (select date_trunc('day', ts) as start, event_type as status from events) e
    where start + interval 1 day <= (select max(ts) from events) - interval 10 minutes group by start, status""",
)
def stream_progress(v):
    out, _, checkpoint = folders(v, "progress")
    changes = event_stream(v).select("ts", F.col("event_type").alias("status"))
    done = jobs.run_to_files(jobs.stream_progress(changes, "1 day", "10 minutes"), out, checkpoint)
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "status", "n")


@query(
    "stream_sessions",
    """with f as (select user_id, ts, case when ts - lag(ts) over(partition by user_id order by ts) <= interval 6 hours then 0 else 1 end as new from events),
    s as (select *, sum(new) over(partition by user_id order by ts) as sid from f)
    select user_id, min(ts) as start, max(ts) + interval 6 hours as stop, count(*) as n from s group by user_id, sid having max(ts) + interval 6 hours <= (select max(ts) from events) - interval 10 minutes""",
)
def stream_sessions(v):
    out, _, checkpoint = folders(v, "sessions")
    done = jobs.run_to_files(jobs.stream_sessions(event_stream(v), "6 hours", "10 minutes", "user_id"), out, checkpoint)
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


def micros():
    return F.unix_micros("ts").alias("at")


STATUS = "case event_type when 'click' then 'downloading' when 'purchase' then 'downloaded' when 'error' then 'failed' else 'pending' end"


@query(
    "stream_status",
    f"""with c as (select event_id%1000 as image_id, arg_max({STATUS}, event_id) as status from events group by 1)
    select o.o_orderkey as image_id, coalesce(c.status,'new') as status from orders o left join c on c.image_id=o.o_orderkey""",
)
def stream_status(v):
    _, state, checkpoint = folders(v, "status")
    t = F.col("event_type")
    status = F.when(t == "click", "downloading").when(t == "purchase", "downloaded").when(t == "error", "failed").otherwise("pending")
    # the event id is the clock of this job
    changes = part_stream(v, in_order=False).select((F.col("event_id") % 1000).alias("image_id"), status.alias("status"), F.col("event_id").alias("at"), F.col("event_id").alias("id"))
    base = v.table("orders").select(F.col("o_orderkey").alias("image_id"), F.lit("new").alias("status"))
    return jobs.stream_status(changes, base, ["image_id"], state, checkpoint)


@query(
    "stream_annotations",
    """select "ID", value from (select event_id%700 as "ID", arg_max(event_type, event_id) as kind, arg_max(value, event_id) as value from events where event_type<>'view' group by 1) q where kind<>'error'""",
)
def stream_annotations(v):
    _, state, checkpoint = folders(v, "annotations")
    t = F.col("event_type")
    action = F.when(t == "click", jobs.CREATED).when(t == "purchase", jobs.UPDATED).when(t == "signup", jobs.UPDATED).when(t == "error", jobs.DELETED[1]).otherwise("OTHER")
    events = part_stream(v, in_order=False).select((F.col("event_id") % 700).alias("ID"), action.alias("action"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"), "value")
    return jobs.stream_annotations(events, state, checkpoint)


@query(
    "stream_train_trigger",
    """with e as (select user_id%5 as project, event_id, event_type, sum(case event_type when 'click' then 1 when 'error' then -1 else 0 end) over(partition by user_id%5 order by event_id) as tasks from events where event_type<>'view')
    select project, event_id as id, case event_type when 'click' then 'ANNOTATION_CREATED' when 'purchase' then 'ANNOTATION_UPDATED' else 'START_TRAINING' end as action, cast(tasks as bigint) as tasks from e
    where event_type='signup' or (event_type in ('click','purchase') and tasks%10=0)""",
)
def stream_train_trigger(v):
    out, state, checkpoint = folders(v, "trigger")
    t = F.col("event_type")
    action = F.when(t == "click", jobs.CREATED).when(t == "purchase", jobs.UPDATED).when(t == "error", jobs.DELETED[0]).when(t == "signup", jobs.START).otherwise("OTHER")
    events = part_stream(v, in_order=True).select((F.col("user_id") % 5).alias("project"), action.alias("action"), F.col("event_id").alias("at"), F.col("event_id").alias("id"))
    return jobs.stream_train_trigger(events, 10, out, state, checkpoint).drop("at")


@query(
    "stream_retry",
    """with e as (select user_id as item, event_id as id, event_type, sum(case when event_type='purchase' then 1 else 0 end) over(partition by user_id order by event_id) as g from events),
    k as (select *, row_number() over(partition by item, g order by id) as k from e where event_type='error')
    select item, id, (k-1)%5+1 as attempt, case when k%5=0 then 'failed' else 'retry' end as action, case when k%5=0 then null else 10 end as delay from k
    union all select item, id, null, 'retry', 60 from e where event_type='view'""",
)
def stream_retry(v):
    out, state, checkpoint = folders(v, "retry")
    t = F.col("event_type")
    outcome = F.when(t == "purchase", "ok").when(t == "error", "error").when(t == "view", "rate_limit").otherwise("other")
    events = part_stream(v, in_order=True).select(F.col("user_id").alias("item"), outcome.alias("outcome"), F.col("event_id").alias("at"), F.col("event_id").alias("id"))
    return jobs.stream_retry(events, out, state, checkpoint).drop("at")


@query(
    "stream_timeouts",
    """with l as (select user_id as item, arg_max(event_type, event_id) as kind, epoch_us(arg_max(ts, event_id))//1000 + 3600000 as expired_ms from events group by user_id)
    select item, 'pending' as status, expired_ms from l where kind='click' and expired_ms <= (select epoch_us(max(ts))//1000 - 600000 from events)""",
)
def stream_timeouts(v):
    out, _, checkpoint = folders(v, "timeouts")
    status = F.when(F.col("event_type") == "click", "in_progress").otherwise("completed")
    changes = event_stream(v).select(F.col("user_id").alias("item"), status.alias("status"), "ts", F.col("event_id").alias("id"))
    return jobs.run_to_files(jobs.stream_timeouts(changes, 3_600_000, "10 minutes"), out, checkpoint)


@query(
    "stream_segments",
    """with r as (select user_id as seq_id, event_id as t, event_type as label, value from events), c as (select *, case when label is distinct from lag(label) over(partition by seq_id order by t) then 1 else 0 end as chg from r),
    g as (select *, sum(chg) over(partition by seq_id order by t) as run from c)
    select seq_id, label, min(t) as start, max(t) as "end", round(avg(value),9) as score from g group by seq_id, run, label""",
)
def stream_segments(v):
    out, state, checkpoint = folders(v, "segments")
    rows = part_stream(v, in_order=True).select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("t"), F.col("event_type").alias("label"), F.col("value").alias("score"))
    return jobs.stream_segments(rows, out, state, checkpoint).withColumn("score", F.round("score", 9))
