"""Experiment grids, run logs, histories and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.text import run_name
from tilewright.operators.datasets import path_exists_kinds
from tilewright.operators.ordered import position_chunk, running


# ---- parameters ----------------------------------------------------------


def params_map(runs: DataFrame, keys: Sequence[str], name: str = "params") -> DataFrame:
    """Fold parameter columns into one map of texts."""
    pairs = []
    for k in keys:
        pairs += [F.lit(k), F.col(k).cast("string")]
    return runs.withColumn(name, F.create_map(*pairs))


def params_json(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run id and its parameters as JSON text."""
    return runs.select("run_id", F.to_json(F.struct(*keys)).alias("json"))


def read_params(jsons: DataFrame) -> DataFrame:
    return jsons.select("run_id", F.from_json("json", "map<string,string>").alias("params"))


def params_long(runs: DataFrame) -> DataFrame:
    """(run_id, key, value) rows of the parameter map."""
    return runs.select("run_id", F.explode("params").alias("key", "value"))


def differing_params(long: DataFrame) -> DataFrame:
    """Parameters with more than one value over all runs."""
    pairs = long.select("key", "value").distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n_values")).filter("n_values > 1")


def param_grid(spark: SparkSession, grid: dict[str, Sequence]) -> DataFrame:
    """All combinations in nested-loop order of the given lists, numbered by idx from 0."""
    rows = spark.range(1).select(F.lit(0).cast("bigint").alias("idx"))
    for name, values in grid.items():
        listed = F.array(*[F.lit(x) for x in values])
        rows = rows.select("*", F.posexplode(listed).alias("_pos", name)).withColumn("idx", F.col("idx") * len(values) + F.col("_pos")).drop("_pos")
    return rows


def new_experiments(grid: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid rows with `cached` and the id of the stored run with equal parameters, null values included.

    Keys the stored runs lack are not compared.
    """
    shared = [k for k in keys if k in runs.columns]
    stored = runs.groupBy(*[F.col(k).alias(f"_{k}") for k in shared]).agg(F.max("run_id").alias("run_id"))
    cond = [F.col(k).cast("string").eqNullSafe(F.col(f"_{k}").cast("string")) for k in shared]
    return grid.join(stored, cond, "left").drop(*[f"_{k}" for k in shared]).withColumn("cached", F.col("run_id").isNotNull())


def what_if_run(runs: DataFrame, base_id, changes: dict[str, str]) -> DataFrame:
    """Runs whose parameters equal the base run's with some changed."""
    pairs = [p for k, v in changes.items() for p in (F.lit(k), F.lit(v))]
    kept = F.map_filter("params", lambda k, _: ~k.isin(list(changes)))
    wanted = F.map_concat(kept, F.create_map(*pairs)) if pairs else F.col("params")
    entries = lambda m: F.array_sort(F.map_entries(m))
    base = runs.filter(F.col("run_id") == base_id).select(entries(wanted).alias("_want"))
    return runs.join(base, entries("params") == F.col("_want"), "left_semi")


def run_attempts_grid(grid: DataFrame, keys: Sequence[str], root: str, retries: int, env: dict[str, str], exclude: Sequence[str] = ()) -> DataFrame:
    """Experiment rows: name, environment map, output folder, retries."""
    rows = params_map(grid, keys)
    base = F.create_map(*[F.lit(x) for pair in env.items() for x in pair]) if env else F.create_map().cast("map<string,string>")
    name = run_name("params", exclude)
    return rows.select(
        "idx", name.alias("name"), F.map_concat(base, "params").alias("env"), F.lit(retries).alias("retries"), F.concat(F.lit(f"{root}/"), name).alias("output_dir")
    )


def select_runs(files: DataFrame, least: int, prefix: str = "", needed: Sequence[str] = ("export", "history", "result")) -> DataFrame:
    """Numeric run folders from `least` on whose name starts with `prefix` and that hold all needed files."""
    number = F.when(F.col("run_dir").rlike("^[0-9]+$"), F.col("run_dir").try_cast("bigint"))
    rows = files.withColumn("run_id", number).filter((F.col("run_id") >= least) & F.col("name").startswith(prefix))
    return path_exists_kinds(rows, ["run_id", "run_dir", "name"], "kind", needed)


# ---- logs ----------------------------------------------------------------

# fixed values: line formats of run logs
START_LINE = r"^=== (.*) \| attempt (\d+) \| start: (.+) ===$"
EPOCH_LINE = r"^\[(\d+), ([0-9.eE+-]+|nan|inf), ([0-9.eE+-]+|nan|inf), '(?:(\d+):)?(\d+):(\d+)'\]$"
OUTCOME_LINE = r"^=== (SUCCESS|FAILED) \| attempt_time: (?:(\d+) days?, )?(\d+):(\d+):([0-9.]+) ===$"


def clock_seconds(text: Column) -> Column:
    """Seconds of a clock text `m:s` or `h:m:s`; null for anything else."""
    clock = r"^(?:(\d+):)?(\d+):(\d+)$"
    part = lambda i: F.regexp_extract(text, clock, i).try_cast("bigint")
    return F.coalesce(part(1), F.lit(0)) * 3600 + part(2) * 60 + part(3)


def parse_log_lines(lines: DataFrame, keys: Sequence[str] = ("run",), order: Sequence[str] = ("pos",), chunk: Column | None = None) -> DataFrame:
    """Start, epoch and outcome rows of log lines, each with the attempt it belongs to."""
    text = F.trim("line")
    started = F.regexp_extract(text, START_LINE, 2)
    epoch, outcome = F.regexp_extract(text, EPOCH_LINE, 1), F.regexp_extract(text, OUTCOME_LINE, 1)
    kind = F.when(started != "", "start").when(epoch != "", "epoch").when(outcome != "", "outcome")
    rows = lines.withColumn("kind", kind).filter("kind is not null")
    if chunk is None:
        chunk = position_chunk(order[0])
    rows = running(rows, keys, order, sums={"attempt": (F.col("kind") == "start").cast("bigint")}, chunk=chunk)
    num = lambda pattern, i: F.regexp_extract(text, pattern, i).try_cast("double")
    none0 = lambda e: F.coalesce(e, F.lit(0.0))
    clock = none0(num(EPOCH_LINE, 4)) * 3600 + num(EPOCH_LINE, 5) * 60 + num(EPOCH_LINE, 6)
    spent = none0(num(OUTCOME_LINE, 2)) * 86400 + num(OUTCOME_LINE, 3) * 3600 + num(OUTCOME_LINE, 4) * 60 + num(OUTCOME_LINE, 5)
    return rows.select(
        *keys, *order, "attempt", "kind",
        F.when(F.col("kind") == "start", F.try_to_timestamp(F.regexp_extract(text, START_LINE, 3))).alias("started_at"),
        F.when(F.col("kind") == "epoch", epoch.try_cast("bigint")).alias("epoch"),
        F.when(F.col("kind") == "epoch", num(EPOCH_LINE, 2)).alias("train_loss"),
        F.when(F.col("kind") == "epoch", num(EPOCH_LINE, 3)).alias("valid_loss"),
        F.when(F.col("kind") == "outcome", outcome).alias("outcome"),
        F.when(F.col("kind") == "epoch", clock).when(F.col("kind") == "outcome", spent).alias("seconds"),
    )


def attempts(log_rows: DataFrame, retries: int, chunk: Column | None = None) -> DataFrame:
    """Attempts per run from (run_id, at, id, kind in start / success / failed) rows.

    An outcome belongs to the last start before it. Attempts after the first success or
    beyond the retries did not happen; the last one left is marked final.
    """
    numbered = running(log_rows, ["run_id"], ["at", "id"], sums={"attempt": (F.col("kind") == "start").cast("bigint")}, chunk=chunk)
    ended = F.col("kind") != "start"
    first_end = F.min(F.when(ended, F.struct("at", "id", "kind")))
    per = numbered.filter("attempt > 0").groupBy("run_id", "attempt").agg(
        F.min(F.when(~ended, F.col("at"))).alias("started"), first_end.alias("e")
    )
    per = per.select("run_id", "attempt", "started", F.col("e.kind").alias("outcome"), ((F.col("e.at") - F.col("started")) / 1e6).alias("seconds"))
    stop = per.groupBy("run_id").agg(F.min(F.when(F.col("outcome") == "success", F.col("attempt"))).alias("_won"), F.max("attempt").alias("_last"))
    joined = per.join(stop, "run_id").withColumn("_final", F.least(F.col("_won"), F.col("_last"), F.lit(retries + 1)))
    kept = joined.filter(F.col("attempt") <= F.col("_final"))
    return kept.select("run_id", "attempt", "outcome", "seconds", (F.col("attempt") == F.col("_final")).alias("final"))


def run_summary(tries: DataFrame) -> DataFrame:
    """Attempts, success and duration per run."""
    return tries.groupBy("run_id").agg(
        F.count("*").alias("attempts"), F.bool_or(F.coalesce(F.col("outcome") == "success", F.lit(False))).alias("success"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")
    )


def total_summary(summary: DataFrame) -> DataFrame:
    """Runs, successes and wall time over all runs; one row."""
    return summary.agg(
        F.count("*").alias("runs"), F.count(F.when(F.col("success"), 1)).alias("succeeded"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds")
    )


def run_quality(history: DataFrame) -> DataFrame:
    """Last and best valid loss, the epoch of the best, and the last gap train - valid."""
    best = F.struct("valid_loss", "epoch")
    return history.groupBy("run_id").agg(
        F.count("*").alias("epochs"), F.max_by("valid_loss", "epoch").alias("last_loss"), F.min(best).alias("b"),
        F.max_by(F.col("train_loss") - F.col("valid_loss"), "epoch").alias("gap"),
    ).select("run_id", "epochs", "last_loss", F.col("b.valid_loss").alias("best_loss"), F.col("b.epoch").alias("best_epoch"), "gap")


def epoch_phases(history: DataFrame, order: str = "pos") -> DataFrame:
    """Phase number of each history row, from 0; a phase starts where the epoch is 0 again."""
    out = running(history, ["run_id"], [order], sums={"_p": (F.col("epoch") == 0).cast("bigint")}, chunk=position_chunk(order))
    return out.withColumn("phase", F.greatest(F.lit(0), F.col("_p") - 1)).drop("_p")
