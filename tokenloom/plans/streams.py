"""Streaming plans: the driver tables replayed as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions.hashing import h48
from tokenloom.operators.tokenize import ByteTokenizer
from tokenloom.plans.common import CHUNK, SEED, SEP, h_sql, ids_md5, r, table
from tokenloom.plans.runs import _RL, _W, MBS, WINDOW as RECORDS
from tokenloom.session import scratch_path
from tokenloom.streaming.jobs import latest, packed_chunks, stream_metrics, stream_pack, stream_throughput

WINDOW, SLIDE, WATERMARK = "1 hour", "30 minutes", "3 hours"
ARRIVALS = 3  # parts in which a table arrives; every part is a micro-batch after a restart
LANES = 4     # sub-streams of a source
LATE = 50     # records


def arriving(spark, df, arrival, job) -> None:
    """Replay a table as a stream: parts are written one after the other, and the job is started from
    its checkpoint after each."""
    folder = scratch_path(spark, "arrivals")
    for k in range(ARRIVALS):
        df.where(arrival == k).write.mode("append").parquet(folder)
        job(spark.readStream.schema(df.schema).parquet(folder))


def late_events(spark, sf):
    """(events, part in which a record arrives): thirds of the time; every seventh record of the two hours
    before a third ends comes with the next part, so late."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = max(1, (hi - lo) // ARRIVALS + 1)
    at = F.unix_micros("ts") - F.lit(lo)
    delay = F.when(F.col("event_id") % 7 == 0, F.lit(2 * 3600 * 1000000)).otherwise(F.lit(0))
    return e, F.least(((at + delay) / third).cast("bigint"), F.lit(ARRIVALS - 1))


def q_x1_stream_pack(spark, sf):
    out, ck = scratch_path(spark, "x1-out"), scratch_path(spark, "x1-ckpt")
    lane = F.pmod(h48(SEED, F.col("doc_id")), F.lit(LANES))
    arriving(spark, table(spark, sf, "documents"), F.col("doc_id") % ARRIVALS,
             lambda sdf: stream_pack(sdf, "source", ByteTokenizer(), CHUNK, SEP, out, ck, LANES, lane))
    res = packed_chunks(spark, out)
    return res.select("source", F.col("lane").cast("bigint").alias("lane"), "chunk_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                      ids_md5("ids").alias("ids_md5"))


def q_x2_stream_metrics(spark, sf):
    out, ck = scratch_path(spark, "x2-out"), scratch_path(spark, "x2-ckpt")
    e, arrival = late_events(spark, sf)
    arriving(spark, e, arrival, lambda sdf: stream_metrics(sdf, "ts", ["event_type"], "value", WINDOW, SLIDE, WATERMARK, out, ck))
    res = latest(spark, out, ["window_start", "event_type"])
    return res.select("window_start", F.col("event_type").alias("metric"), F.col("n").cast("bigint").alias("n"),
                      r("total", 9).alias("total"), r("mean", 9).alias("mean"), r("per_sec", 9).alias("per_sec"))


def q_x2_stream_throughput(spark, sf):
    out, ck = scratch_path(spark, "x2r-out"), scratch_path(spark, "x2r-ckpt")
    e, arrival = late_events(spark, sf)
    counters = {"batches": F.lit(1), "samples": F.lit(MBS), "lengths": F.col("value")}
    arriving(spark, e, arrival, lambda sdf: stream_throughput(sdf, "user_id", F.unix_micros("ts") / 1e6, "event_id", counters, out, ck, RECORDS, LATE))
    res = latest(spark, out, ["run", "tie"]).where("NOT dropped")
    return res.select("run", F.col("tie").alias("event_id"), *[r(f"{c}_per_sec").alias(f"{c}_per_sec") for c in counters])


QUERIES = {
    "x1_stream_pack": q_x1_stream_pack,
    "x2_stream_metrics": q_x2_stream_metrics,
    "x2_stream_throughput": q_x2_stream_throughput,
}


def _rate(c: str) -> str:
    return f"round(CASE WHEN t - first_value(t) OVER {_W} > 0 THEN ({c} - first_value({c}) OVER {_W}) / (t - first_value(t) OVER {_W}) END, 6)"


ORACLE = {
    "x1_stream_pack": f"""WITH sx AS (SELECT source, {h_sql('doc_id')} % {LANES} AS lane, doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS l FROM documents),
        so AS (SELECT *, coalesce(sum(l + 1) OVER (PARTITION BY source, lane ORDER BY doc_id % {ARRIVALS}, doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM sx),
        t1 AS (SELECT source, lane, st, l, hx, unnest(range(1, l + 2)) AS i FROM so),
        tk AS (SELECT source, lane, st + i - 1 AS pos,
                 CASE WHEN i = l + 1 THEN 2 ELSE CAST(('0x' || substr(hx, 2 * i - 1, 2)) AS INTEGER) + 3 END AS id FROM t1),
        c AS (SELECT source, lane, pos // {CHUNK} AS chunk_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS a
              FROM tk GROUP BY source, lane, pos // {CHUNK})
        SELECT source, CAST(lane AS BIGINT) AS lane, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(n AS BIGINT) AS n_tokens,
               md5(a || repeat(',{SEP}', CAST({CHUNK} - n AS INTEGER))) AS ids_md5 FROM c""",
    "x2_stream_metrics": """WITH b AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS s, event_type, value FROM events),
        w AS (SELECT s AS ws, event_type, value FROM b UNION ALL SELECT s - INTERVAL '30 minutes' AS ws, event_type, value FROM b)
        SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS metric, CAST(count(*) AS BIGINT) AS n,
               round(sum(value), 9) AS total, round(avg(value), 9) AS mean, round(count(*) / 3600.0, 9) AS per_sec
        FROM w GROUP BY ws, event_type""",
    "x2_stream_throughput": f"""WITH {_RL}, tot AS (SELECT *, sum(value) OVER (PARTITION BY run ORDER BY step) AS lengths,
        (step + 1) * {MBS} AS samples, step + 1 AS batches FROM rl)
        SELECT run, event_id, {_rate('batches')} AS batches_per_sec, {_rate('samples')} AS samples_per_sec, {_rate('lengths')} AS lengths_per_sec FROM tot""",
}
