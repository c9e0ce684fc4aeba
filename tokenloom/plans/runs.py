"""Run-log plans over ``events`` (run = user_id, step = order by ts within
the run, metric = event_type, value = loss): metric CSV log, daily report,
throughput, iteration time, cadence, totals, tokens/sec, compute to target,
learning-rate schedules and FLOPs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.scalar import cosine_lr, flops, linear_warmup
from tokenloom.operators.metrics import (cadence, compute_to_target, daily_report, first_n, iter_time, run_totals,
                                         throughput, tokens_per_sec, with_steps)
from tokenloom.operators.offsets import measured_bucket
from tokenloom.plans.common import r, table
from tokenloom.session import scratch_path
from tokenloom.sources.tables import read_metrics, write_metrics

MBS, ACCUM, EVERY, WINDOW = 5, 4, 10, 50
TARGET = 1.0
LR, WARMUP, DECAY, MIN_LR = 6e-4, 10, 60, 6e-5
FT_LR, FT_WARMUP = 3e-4, 20
SEQ = 2048


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id", "ts",
                                          F.col("event_type").alias("metric"), "value", "props")
    when = F.unix_micros(F.col("ts").cast("timestamp"))  # buckets by time, wide enough for the log's size
    return with_steps(e, "run", ["ts", "event_id"], measured_bucket(e, when))


def _t():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def run_config(spark: SparkSession, sf: str) -> DataFrame:
    """One configuration row per run, derived from the run id."""
    runs = table(spark, sf, "events").select(F.col("user_id").alias("run")).distinct()
    return runs.select("run", F.lit(SEQ).alias("seq"), (F.col("run") % 6 + 6).alias("layers"),
                       ((F.col("run") % 4 + 1) * 256).alias("embd"),
                       ((F.col("run") % 10 + 1) * 1_000_000).alias("trainable"),
                       ((F.col("run") % 3) * 500_000).alias("frozen"))


def q_s8_metric_log(spark, sf):
    path = scratch_path(spark, "metrics")
    write_metrics(run_log(spark, sf), path)
    m = read_metrics(spark, path)
    return m.select("run", "step", "metric", r("value").alias("value"))


def q_s9_daily_report(spark, sf):
    e = table(spark, sf, "events")
    d = daily_report(e, "ts", "event_type", "value", "event_id")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "day_label", F.col("event_type").alias("metric"),
                    r("first_value").alias("first_value"), r("last_value").alias("last_value"),
                    r("min_value").alias("min_value"), r("max_value").alias("max_value"),
                    r("mean_value", 9).alias("mean_value"), r("total_value", 9).alias("total_value"), "n")


def q_a15_run_totals(spark, sf):
    t = run_totals(run_log(spark, sf), "run", "step", "value", MBS)
    return t.select("run", "step", r("lengths_total").alias("lengths_total"), F.col("samples").cast("bigint").alias("samples"))


def q_w1_throughput(spark, sf):
    t = run_totals(run_log(spark, sf), "run", "step", "value", MBS)
    t = t.withColumn("batches", F.col("step") + 1)
    w = throughput(t, "run", "step", _t(), ["batches", "samples", "lengths_total"], WINDOW)
    return w.select("run", "step", r("batches_per_sec").alias("batches_per_sec"),
                    r("samples_per_sec").alias("samples_per_sec"), r("lengths_total_per_sec").alias("lengths_per_sec"))


def q_w2_iter_time(spark, sf):
    w = iter_time(run_log(spark, sf), "run", "step", _t(), ACCUM)
    return w.select("run", "step", r("dt").alias("dt"), "is_optimizer_step")


def q_w3_cadence(spark, sf):
    return cadence(run_log(spark, sf), "step", EVERY, ACCUM).select("run", "step", "event_id")


def q_w5_first_n(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return first_n(e, ["ts", "event_id"], 100).select("event_id")


def q_a16_tokens_per_sec(spark, sf):
    w = iter_time(run_log(spark, sf), "run", "step", _t(), ACCUM)
    g = w.select("run", F.round(F.col("value") * 100).cast("bigint").alias("total"),
                 F.get_json_object("props", "$.k").cast("bigint").alias("prompt"),
                 F.coalesce(F.col("dt"), F.lit(0.0)).alias("seconds"))
    t = tokens_per_sec(g, "run", "total", "prompt", "seconds")
    return t.select("run", F.col("generated").cast("bigint").alias("generated"), r("seconds").alias("seconds"),
                    r("tokens_per_sec").alias("tokens_per_sec"))


def _flops_col(c, training=True):
    return flops(c["seq"], c["layers"], c["embd"], c["trainable"], c["frozen"], training)


def q_c3_flops(spark, sf):
    c = run_config(spark, sf)
    return c.select("run", _flops_col(c, True).alias("flops_train"), _flops_col(c, False).alias("flops_eval"))


def q_a17_compute_to_target(spark, sf):
    log = run_log(spark, sf)
    c = run_config(spark, sf)
    lg = log.join(c.select("run", (_flops_col(c, True) * MBS).alias("fps")), "run")
    out = compute_to_target(lg, "run", "step", "value", F.col("fps"), TARGET)
    # runs that never reach the target: first_step -1, compute -1, rank 0
    return out.select("run", F.coalesce(F.col("first_step").cast("bigint"), F.lit(-1).cast("bigint")).alias("first_step"),
                      F.coalesce("compute", F.lit(-1.0)).alias("compute"),
                      F.coalesce(F.col("rank").cast("bigint"), F.lit(0).cast("bigint")).alias("rank"))


def q_c1_cosine_lr(spark, sf):
    log = run_log(spark, sf)
    return log.select("event_id", r(cosine_lr(F.col("step"), LR, WARMUP, DECAY, MIN_LR), 12).alias("lr"))


def q_c2_linear_warmup(spark, sf):
    log = run_log(spark, sf)
    return log.select("event_id", r(linear_warmup(F.col("step"), FT_LR, FT_WARMUP), 12).alias("lr"))


QUERIES = {
    "s8_metric_log": q_s8_metric_log,
    "s9_daily_report": q_s9_daily_report,
    "a15_run_totals": q_a15_run_totals,
    "w1_throughput": q_w1_throughput,
    "w2_iter_time": q_w2_iter_time,
    "w3_cadence": q_w3_cadence,
    "w5_first_n": q_w5_first_n,
    "a16_tokens_per_sec": q_a16_tokens_per_sec,
    "c3_flops": q_c3_flops,
    "a17_compute_to_target": q_a17_compute_to_target,
    "c1_cosine_lr": q_c1_cosine_lr,
    "c2_linear_warmup": q_c2_linear_warmup,
}

_RL = """rl AS (SELECT user_id AS run, event_id, ts, event_type AS metric, value, props,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step,
        epoch_us(ts) / 1e6 AS t FROM events)"""
_TOT = _RL + f""", tot AS (SELECT *, sum(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS lengths_total, (step + 1) * {MBS} AS samples, step + 1 AS batches FROM rl)"""
_IT = _RL + """, it AS (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY step) AS dt FROM rl)"""
_CFG = _RL + f""", cfg AS (SELECT DISTINCT run, {SEQ} AS seq, run % 6 + 6 AS layers, (run % 4 + 1) * 256 AS embd,
        (run % 10 + 1) * 1000000 AS trainable, (run % 3) * 500000 AS frozen FROM rl),
    fl AS (SELECT run,
        2.0 * trainable * seq + layers * 4.0 * embd * seq * seq AS ft,
        2.0 * frozen * seq + layers * 4.0 * embd * seq * seq AS ff FROM cfg)"""
_W = f"(PARTITION BY run ORDER BY step ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)"


def _rate(c: str) -> str:
    return f"round(CASE WHEN t - first_value(t) OVER {_W} > 0 THEN ({c} - first_value({c}) OVER {_W}) / (t - first_value(t) OVER {_W}) END, 6)"


_COS = (f"CASE WHEN step < {WARMUP} THEN {LR} * step / {float(WARMUP)} WHEN step > {DECAY} THEN {MIN_LR} "
        f"ELSE {MIN_LR} + 0.5 * (1.0 + cos(pi() * (step - {WARMUP}) / {float(DECAY - WARMUP)})) * {LR - MIN_LR} END")

ORACLE = {
    "s8_metric_log": f"WITH {_RL} SELECT run, step, metric, round(value, 6) AS value FROM rl",
    "s9_daily_report": """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, strftime(CAST(ts AS DATE), '%d/%m/%Y') AS day_label,
        event_type AS metric, round(arg_min(value, ts), 6) AS first_value, round(arg_max(value, ts), 6) AS last_value,
        round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
        round(avg(value), 9) AS mean_value, round(sum(value), 9) AS total_value,
        CAST(count(*) AS BIGINT) AS n FROM events GROUP BY CAST(ts AS DATE), event_type""",
    "a15_run_totals": f"WITH {_TOT} SELECT run, step, round(lengths_total, 6) AS lengths_total, CAST(samples AS BIGINT) AS samples FROM tot",
    "w1_throughput": f"""WITH {_TOT} SELECT run, step, {_rate('batches')} AS batches_per_sec, {_rate('samples')} AS samples_per_sec,
        {_rate('lengths_total')} AS lengths_per_sec FROM tot""",
    "w2_iter_time": f"WITH {_IT} SELECT run, step, round(dt, 6) AS dt, (step + 1) % {ACCUM} = 0 AS is_optimizer_step FROM it",
    "w3_cadence": f"WITH {_RL} SELECT run, step, event_id FROM rl WHERE (step + 1) % {ACCUM} = 0 AND ((step + 1) // {ACCUM}) % {EVERY} = 0",
    "w5_first_n": "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100",
    "a16_tokens_per_sec": f"""WITH {_IT}, g AS (SELECT run, CAST(round(value * 100) AS BIGINT) AS total,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt, coalesce(dt, 0.0) AS seconds FROM it)
        SELECT run, CAST(sum(total - prompt) AS BIGINT) AS generated, round(sum(seconds), 6) AS seconds,
        round(CASE WHEN sum(seconds) > 0 THEN sum(total - prompt) / sum(seconds) END, 6) AS tokens_per_sec FROM g GROUP BY run""",
    "c3_flops": f"""WITH {_CFG} SELECT run, CAST(3.0 * ft + 2.0 * ff AS DOUBLE) AS flops_train,
        CAST(ft + ff AS DOUBLE) AS flops_eval FROM fl""",
    "a17_compute_to_target": f"""WITH {_CFG}, hit AS (SELECT run, min(step) AS first_step FROM rl WHERE value <= {TARGET} GROUP BY run),
        c AS (SELECT fl.run, hit.first_step, (hit.first_step + 1) * ((3.0 * ft + 2.0 * ff) * {MBS}) AS compute
              FROM fl LEFT JOIN hit ON fl.run = hit.run)
        SELECT run, CAST(coalesce(first_step, -1) AS BIGINT) AS first_step, CAST(coalesce(compute, -1.0) AS DOUBLE) AS compute,
               CAST(coalesce(CASE WHEN compute IS NOT NULL THEN rank() OVER (PARTITION BY compute IS NULL ORDER BY compute, run) END, 0)
                    AS BIGINT) AS rank
        FROM c""",
    "c1_cosine_lr": f"WITH {_RL} SELECT event_id, round({_COS}, 12) AS lr FROM rl",
    "c2_linear_warmup": f"""WITH {_RL} SELECT event_id, round(CASE WHEN step <= {FT_WARMUP} THEN {FT_LR} * step / {float(FT_WARMUP)}
        ELSE {FT_LR} END, 12) AS lr FROM rl""",
}
