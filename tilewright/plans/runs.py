"""Queries of experiment tracking and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import text as tf
from tilewright.operators import runs as rn
from tilewright.operators.scoring import compose, pipe
from tilewright.operators.state import tile_stats
from tilewright.plans.registry import query
from tilewright.session import shared_dir
from tilewright.sources import runs as sr
from tilewright.sources.named_files import write_named_files

KEYS = ["model", "tile", "n"]


@query("read_run_history", "select cast(run_id as varchar) as run_dir, epoch, round(train_loss,9) as train_loss, round(valid_loss,9) as valid_loss, epoch%300 as seconds from v_runs")
def read_run_history(v):
    path = shared_dir(v.spark, "history")
    e = F.col("epoch")
    clock = F.format_string("%02d:%02d", F.floor(e % 300 / 60), e % 60)
    rows = v.runs.select("run_id", "epoch", "train_loss", "valid_loss", clock.alias("time"))
    rows.repartition("run_id", F.floor(e / 65_536)).write.partitionBy("run_id").csv(path, header=True)
    out = sr.read_run_history(v.spark, path)
    return out.select(F.regexp_replace("run_dir", "^run_id=", "").alias("run_dir"), "epoch", F.round("train_loss", 9).alias("train_loss"), F.round("valid_loss", 9).alias("valid_loss"), "seconds")


@query(
    "parse_run_log",
    """select run_id as run, epoch//10+1 as attempt, 'start' as kind, null as epoch, null as valid_loss, null as outcome, null as seconds from v_runs where epoch%10=0
    union all select run_id, epoch//10+1, 'epoch', epoch%10, round(valid_loss,9), null, epoch%60*1e0 from v_runs
    union all select run_id, epoch//10+1, 'outcome', null, null, case when run_id%2=0 then 'SUCCESS' else 'FAILED' end, 3600e0+epoch%60+0.5e0 from v_runs where epoch%10=9""",
)
def parse_run_log(v):
    e = F.col("epoch")
    start = F.when(e % 10 == 0, F.concat(F.lit("=== run "), "run_id", F.lit(" | attempt "), F.floor(e / 10) + 1, F.lit(" | start: 2026-01-25 12:24:16.925714 ===")))
    row = F.concat(F.lit("["), e % 10, F.lit(", "), "train_loss", F.lit(", "), "valid_loss", F.lit(", '"), F.format_string("00:%02d", e % 60), F.lit("']"))
    end = F.when(e % 10 == 9, F.concat(F.lit("=== "), F.when(F.col("run_id") % 2 == 0, "SUCCESS").otherwise("FAILED"), F.lit(" | attempt_time: 1:00:"), F.format_string("%02d.500000", e % 60), F.lit(" ===")))
    lines = v.runs.select("run_id", "epoch", F.posexplode(F.array(start, F.lit("some other output"), row, end)).alias("k", "line")).filter("line is not null")
    folder = shared_dir(v.spark, "logs")
    named = lines.select(F.concat(F.lit("logs/"), "run_id").alias("path"), (e * 4 + F.col("k")).alias("pos"), F.concat("line", F.lit("\n")).alias("content"))
    write_named_files(named, folder, "pos")
    return sr.parse_run_log(v.spark, folder).select(F.col("run").cast("bigint").alias("run"), "attempt", "kind", "epoch", F.round("valid_loss", 9).alias("valid_loss"), "outcome", "seconds")


@query("params_table", "select run_id, 'model' as key, model as value from v_params union all select run_id, 'tile', tile from v_params union all select run_id, 'n', n from v_params")
def params_table(v):
    return rn.params_long(rn.read_params(rn.params_json(v.params, KEYS)))


@query("differing_params", "select 'model' as key, count(distinct model) as n_values from v_params union all select 'tile', count(distinct tile) from v_params union all select 'n', count(distinct n) from v_params")
def differing_params(v):
    return rn.differing_params(rn.params_long(rn.params_map(v.params, KEYS)))


def grid(v):
    """Parameter lists are few by nature: the distinct values of each column, sorted."""
    lists = {k: [r[0] for r in v.params.select(k).distinct().orderBy(k).collect()] for k in KEYS}
    lists["n"] = [*lists["n"], "9000"]
    return rn.param_grid(v.spark, lists)


GRID = """(select row_number() over(order by m.model, t.tile, case when q.n='9000' then 1 else 0 end, q.n)-1 as idx, m.model, t.tile, q.n from (select distinct model from v_params) m, (select distinct tile from v_params) t, (select distinct n from v_params union all select '9000') q)"""


@query("param_grid", f"select idx, model, tile, n from {GRID} g")
def param_grid(v):
    return grid(v)


@query("new_experiments", f"select idx, g.model, g.tile, g.n, max(p.run_id) as run_id, max(p.run_id) is not null as cached from {GRID} g left join v_params p on p.model=g.model and p.tile=g.tile and p.n=g.n group by all")
def new_experiments(v):
    return rn.new_experiments(grid(v), v.params, KEYS)


@query("what_if_run", "select p.run_id, p.model, p.tile, p.n from v_params p join v_params b on b.run_id=12 and p.model=b.model and p.n=b.n and p.tile='75'")
def what_if_run(v):
    return rn.what_if_run(rn.params_map(v.params, KEYS), 12, {"tile": "75"}).select("run_id", *KEYS)


@query("run_name", "select run_id, concat('model=',model,'-n=',n,'-tile=',tile) as name, concat('model=',model,'-tile=',tile) as short, tile as back from v_params")
def run_name(v):
    rows = rn.params_map(v.params, KEYS).withColumn("name", tf.run_name("params"))
    return rows.select("run_id", "name", tf.run_name("params", ["n"]).alias("short"), F.element_at(tf.parse_run_name("name"), "tile").alias("back"))


@query("run_attempts_grid", f"select idx, concat('model=',model,'-n=',n,'-tile=',tile) as name, 'x' as base, n as env_n, 2 as retries, concat('out/model=',model,'-n=',n,'-tile=',tile) as output_dir from {GRID} g")
def run_attempts_grid(v):
    out = rn.run_attempts_grid(grid(v), KEYS, "out", 2, {"BASE": "x"})
    return out.select("idx", "name", F.col("env")["BASE"].alias("base"), F.col("env")["n"].alias("env_n"), "retries", "output_dir")


@query("select_runs", "select run_id, printf('%03d',run_id) as run_dir, concat(model,'-',tile) as name from v_params where run_id>=20 and model='small' and run_id%3<>0")
def select_runs(v):
    kinds = F.filter(F.array(F.lit("export"), F.lit("history"), F.when(F.col("run_id") % 3 != 0, "result")), lambda k: k.isNotNull())
    files = v.params.select(F.format_string("%03d", "run_id").alias("run_dir"), F.concat_ws("-", "model", "tile").alias("name"), F.explode(kinds).alias("kind"))
    extra = files.withColumn("run_dir", F.concat(F.lit("old_"), "run_dir"))
    return rn.select_runs(files.unionByName(extra), 20, "small")


def log_rows(v):
    t = F.col("event_type")
    kind = F.when(t == "click", "start").when(t == "purchase", "success").when(t == "error", "failed")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return v.table("events").select(F.col("user_id").alias("run_id"), at.alias("at"), F.col("event_id").alias("id"), kind.alias("kind")).filter("kind is not null")


ATTEMPTS = """a0 as (select user_id as run_id, epoch_us(ts) as tm, event_id as id, case event_type when 'click' then 'start' when 'purchase' then 'success' when 'error' then 'failed' end as kind from events where event_type in ('click','purchase','error')),
    a1 as (select *, sum(case when kind='start' then 1 else 0 end) over(partition by run_id order by tm,id) as attempt from a0),
    a2 as (select run_id, attempt, min(tm) filter (kind='start') as s, arg_min(kind, (tm,id)) filter (kind<>'start') as outcome, min(tm) filter (kind<>'start') as e from a1 where attempt>0 group by run_id, attempt),
    a3 as (select *, least(coalesce(min(case when outcome='success' then attempt end) over(partition by run_id),1000000), max(attempt) over(partition by run_id), 6) as fin from a2),
    a4 as (select run_id, attempt, outcome, (e-s)/1e6 as seconds, attempt=fin as final from a3 where attempt<=fin)"""


@query("attempts", f"with {ATTEMPTS} select run_id, cast(attempt as bigint) as attempt, outcome, round(seconds,3) as seconds, final from a4")
def attempts(v):
    return rn.attempts(log_rows(v), 5).withColumn("seconds", F.round("seconds", 3))


@query("run_summary", f"with {ATTEMPTS} select run_id, count(*) as attempts, bool_or(coalesce(outcome='success',false)) as success, round(coalesce(sum(seconds),0),3) as seconds from a4 group by run_id")
def run_summary(v):
    return rn.run_summary(rn.attempts(log_rows(v), 5)).withColumn("seconds", F.round("seconds", 3))


@query("total_summary", f"with {ATTEMPTS} select count(distinct run_id) as runs, count(distinct case when outcome='success' then run_id end) as succeeded, round(sum(seconds),2) as seconds from a4")
def total_summary(v):
    return rn.total_summary(rn.run_summary(rn.attempts(log_rows(v), 5))).withColumn("seconds", F.round("seconds", 2))


@query(
    "run_quality",
    """select run_id, count(*) as epochs, round(arg_max(valid_loss,epoch),9) as last_loss, round(min(valid_loss),9) as best_loss, (select min(epoch) from v_runs q where q.run_id=r.run_id and q.valid_loss=min(r.valid_loss)) as best_epoch,
    round(arg_max(train_loss-valid_loss,epoch),9) as gap from v_runs r group by run_id""",
)
def run_quality(v):
    out = rn.run_quality(v.runs)
    return out.select("run_id", "epochs", F.round("last_loss", 9).alias("last_loss"), F.round("best_loss", 9).alias("best_loss"), "best_epoch", F.round("gap", 9).alias("gap"))


@query("epoch_phases", "select run_id, epoch as pos, epoch%7 as epoch, epoch//7 as phase from v_runs")
def epoch_phases(v):
    rows = v.runs.select("run_id", F.col("epoch").alias("pos"), (F.col("epoch") % 7).alias("epoch"))
    return rn.epoch_phases(rows)


# ---- text helpers --------------------------------------------------------


@query("local_path_from_url", "select page_id, concat('/data/',page_id,'.jpg') as path from pages")
def local_path_from_url(v):
    url = F.concat(F.lit("/data/local-files/?d=data/"), "page_id", F.lit(".jpg"))
    return v.table("pages").select("page_id", tf.local_path_from_url(url).alias("path"))


FORMS = ["url", "concat('upload/1/',page_id)", "concat('/upload/1/',page_id)", "concat('/data/local-files/?d=',page_id)", "concat('s3://b/',page_id)", "concat('azure-blob://b/',page_id)", "concat('/data/plain/',page_id)", "concat('just text ',page_id)", "concat('mailto:',page_id)", "concat('gs://',page_id)"]
EXPECTED = [True, True, True, True, True, True, False, False, False, True]


@query("needs_preload", " union all ".join(f"select page_id, {i} as form, {str(e).lower()} as preload from pages" for i, e in enumerate(EXPECTED)))
def needs_preload(v):
    forms = F.array(*[F.expr(f) for f in FORMS])
    rows = v.table("pages").select("page_id", F.posexplode(forms).alias("form", "u"))
    return rows.select("page_id", "form", tf.needs_preload("u").alias("preload"))


@query("safe_name", "select p_partkey, replace(replace(concat(p_name,'/',p_brand,'\\',p_type),'/','_'),'\\','_') as name, concat(p_name,'|',p_brand) as items from part")
def safe_name(v):
    raw = F.concat("p_name", F.lit("/"), "p_brand", F.lit("\\"), "p_type")
    items = tf.comma_items(F.concat(F.lit(" "), "p_name", F.lit(" ,, "), "p_brand", F.lit(", ")))
    return v.table("part").select("p_partkey", tf.safe_name(raw).alias("name"), F.array_join(items, "|").alias("items"))


@query("coerce_text", "select task_id, ord, trim(value,'\"') as value, trim(value,'\"') as first from v_regions")
def coerce_text(v):
    return v.regions.select("task_id", "ord", tf.coerce_text("value").alias("value"), tf.coerce_list(F.array("value", F.lit("other"))).alias("first"))


@query(
    "error_fields",
    """select event_id, case event_id%4 when 0 then 'OAuth' when 1 then 'Rate' end as error_type, case event_id%4 when 0 then concat('bad ',event_id) when 1 then concat('slow ',event_id) end as error_message,
    case event_id%4 when 0 then 190 end as error_code, case event_id%4 when 0 then concat('call failed: bad ',event_id,' (type: OAuth) [code: 190]') when 1 then concat('call failed: slow ',event_id,' (type: Rate)') else 'call failed' end as full_message from events""",
)
def error_fields(v):
    e = F.col("event_id")
    body = (
        F.when(e % 4 == 0, F.concat(F.lit('{"error":{"type":"OAuth","code":190,"message":"bad '), e, F.lit('"}}')))
        .when(e % 4 == 1, F.concat(F.lit('{"error":{"type":"Rate","error_user_msg":"slow '), e, F.lit('"}}')))
        .when(e % 4 == 2, F.col("props")).otherwise(F.lit("not json"))
    )
    return v.table("events").select("event_id", tf.error_fields(body, "call failed").alias("f")).select("event_id", "f.*")


@query("render_prompt", "select doc_id, md5(concat('Label: ',text,' as one of a,b by ',source,'.')) as prompt_md5 from documents")
def render_prompt(v):
    prompt = tf.render_prompt("Label: {text} as one of {labels} by {source}.", {"labels": F.lit("a,b"), "source": F.col("source"), "text": F.col("text")})
    return v.table("documents").select("doc_id", F.md5(prompt).alias("prompt_md5"))


@query("model_version", "select p_partkey, 'Model' as name, p_size as major, p_partkey%7 as minor, 3 as patch, concat('Model-v',p_size,'.',p_partkey%7+1,'.0') as bumped, concat('Model-v',p_size,'.',p_partkey%7,'.3') as stamped from part")
def model_version(v):
    k = F.col("p_partkey")
    text = F.concat(F.lit("Model-v"), "p_size", F.lit("."), k % 7, F.lit(".3"))
    rows = v.table("part").select("p_partkey", text.alias("v"))
    parts = rows.select("p_partkey", "v", tf.model_version("v").alias("m"))
    return parts.select("p_partkey", "m.name", "m.major", F.col("m.minor").cast("bigint").alias("minor"), "m.patch", tf.bump_version("v").alias("bumped"), tf.stamp_version(F.lit(None).cast("string"), "v").alias("stamped"))


@query("materialize", "select status, count(*) as tiles, cast(coalesce(sum(image_count),0) as bigint) as images from v_tiles group by status")
def materialize(v):
    root = shared_dir(v.spark, "cache")
    build = lambda zoom, note: tile_stats(v.tiles.filter(F.col("z") == zoom))
    sr.materialize(v.spark, root, "tile_stats", {"zoom": 8, "note": "first"}, ["zoom"], build)
    return sr.materialize(v.spark, root, "tile_stats", {"zoom": 8, "note": "second call reads the first one's output"}, ["zoom"], build)


@query("pipe", "select user_id, count(*) as n from events where value>10 group by user_id")
def pipe_query(v):
    busy = pipe(lambda df: df.filter("value > 10"), lambda df: df.groupBy("user_id").agg(F.count("*").alias("n")))
    return busy(v.table("events"))


@query("parse_run_name", "select run_id, 'model' as key, model as value from v_params union all select run_id, 'tile', tile from v_params")
def parse_run_name(v):
    names = rn.params_map(v.params, KEYS).select("run_id", tf.run_name("params", ["n"]).alias("name"))
    return names.select("run_id", F.explode(tf.parse_run_name("name")).alias("key", "value"))


@query("compose", "select event_type, count(*) as n from events where value>20 group by event_type")
def compose_query(v):
    busy = compose(lambda df: df.groupBy("event_type").agg(F.count("*").alias("n")), lambda df: df.filter("value > 20"))
    return busy(v.table("events"))
