"""Streaming jobs: state carried across micro-batches and restarts from the checkpoint equals
the batch form over the same arrival order."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenloom.operators.tokenize import ByteTokenizer
from tokenloom.session import scratch_path
from tokenloom.streaming.jobs import latest, packed_chunks, stream_pack, stream_throughput

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, text string"


def _expected(parts, lane, C, sep=0):
    """Sequential packing per (source, lane): parts in order, ids in order inside a part."""
    streams = {}
    for part in parts:
        for doc_id, source, text in sorted(part, key=lambda r: (r[0] is not None, r[0] or 0)):
            streams.setdefault((source, lane(doc_id)), []).extend([b + 3 for b in (text or "").encode()] + [2])
    return {(k, i // C): (min(C, len(x) - i), x[i:i + C] + [sep] * (C - len(x[i:i + C]))) for k, x in streams.items() for i in range(0, len(x), C)}


def _pack(spark, tmp_path, parts, C, lanes=1, files=1):
    """Write the parts one after the other and restart the job after each; the number of micro-batches."""
    src, out, ck = str(tmp_path / "in"), scratch_path(spark, "t-x1-out"), scratch_path(spark, "t-x1-ck")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(files).write.mode("append").parquet(src)
        lane = F.coalesce(F.col("doc_id") % lanes, F.lit(0))
        stream_pack(spark.readStream.schema(SCHEMA).parquet(src), "source", ByteTokenizer(), C, 0, out, ck, lanes, lane)
    return out


def _same(spark, out, expected):
    got = {((r["source"], r["lane"]), r["chunk_id"]): (r["n_tokens"], list(r["ids"])) for r in packed_chunks(spark, out).collect()}
    assert got == expected


def test_stream_pack_of_three_parts_with_restarts(spark, tmp_path):
    C = 512
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").where("source < 'src3'").collect()]
    parts = [[d for d in docs if d[0] % 3 == k] for k in range(3)]
    _same(spark, _pack(spark, tmp_path, parts, C), _expected(parts, lambda d: 0, C))


def test_hot_source_is_spread_and_closed_chunks_are_written_once(spark, tmp_path):
    C, rnd = 64, random.Random(3)
    docs = [(i, rnd.choice(["hot"] * 9 + ["b", None]), "x" * rnd.choice([0, 3, 62, 63, 64, 200])) for i in range(300)] + [(None, "hot", "no id"), (1000, "b", None)]
    parts = [docs[k::3] for k in range(3)]
    out = _pack(spark, tmp_path, parts, C, lanes=5, files=3)
    _same(spark, out, _expected(parts, lambda d: 0 if d is None else d % 5, C))
    rows = spark.read.parquet(out).withColumn("closed", F.col("closed").cast("boolean"))
    closed = rows.where("closed")
    assert closed.select("source", "lane", "chunk_id").distinct().count() == closed.count()
    assert closed.where("source = 'hot'").select("lane").distinct().count() == 5
    assert rows.where("NOT closed").count() <= 3 * rows.select("source", "lane").distinct().count()  # a tail per lane and batch


def test_tail_that_closes_exactly_is_taken_back(spark, tmp_path):
    parts = [[(1, "a", "x" * 3)], [(2, "a", "x" * 3)], [(3, "a", "y")]]  # 4 + 4 tokens close a chunk of 8
    _same(spark, _pack(spark, tmp_path / "1", parts[:2], 8), _expected(parts[:2], lambda d: 0, 8))
    _same(spark, _pack(spark, tmp_path / "2", parts, 8), _expected(parts, lambda d: 0, 8))


# ------------------------------------------------------------ X2 by records --

def _rates(rows, window):
    """rows: (run, t, tie, x) -> {(run, tie): rate over the last ``window`` records}"""
    out = {}
    for run in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == run)
        for i, (t, tie, _) in enumerate(own):
            first = max(0, i - window + 1)
            dt = t - own[first][0]
            out[run, tie] = sum(r[2] for r in own[first + 1:i + 1]) / dt if dt > 0 else None
    return out


def _stream_rates(spark, tmp_path, parts, window, late):
    src, out, ck = str(tmp_path / "in"), scratch_path(spark, "t-x2-out"), scratch_path(spark, "t-x2-ck")
    schema = "run long, t double, tie long, x double"
    for part in parts:
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(src)
        stream_throughput(spark.readStream.schema(schema).parquet(src), "run", F.col("t"), "tie", {"x": F.col("x")}, out, ck, window, late)
    rows = latest(spark, out, ["run", "tie"]).collect()
    return {(r["run"], r["tie"]): r["x_per_sec"] for r in rows if not r["dropped"]}, {(r["run"], r["tie"]) for r in rows if r["dropped"]}


def test_record_rates_equal_the_batch_form_with_late_records(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(run, float(i // 2), 1000 * run + i, rnd.random()) for run in (1, 2) for i in range(120)]
    # some records of the end of a part come with the next one
    part = lambda i: min(2, (i + (8 if i % 5 == 0 else 0)) // 40)
    parts = [[r for r in rows if part(r[2] % 1000) == k] for k in range(3)]
    assert any(r[2] % 1000 < 40 for r in parts[1])
    got, dropped = _stream_rates(spark, tmp_path, parts, window=10, late=12)
    want = _rates(rows, 10)
    assert not dropped and set(got) == set(want)
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or got[k] == pytest.approx(want[k], abs=1e-9)) for k in want)


def test_records_later_than_the_buffer_are_marked(spark, tmp_path):
    rows = [(1, float(i), i, 1.0) for i in range(60)]
    late = (1, 3.5, 900, 1.0)
    got, dropped = _stream_rates(spark, tmp_path, [rows[:30], rows[30:], [late]], window=5, late=4)
    assert dropped == {(1, 900)}
    want = _rates(rows, 5)
    assert got == {k: pytest.approx(v) if v is not None else None for k, v in want.items()}


def test_state_calls_do_not_grow_with_the_runs(spark, tmp_path):
    """More runs than groups: each micro-batch makes one state call per group, and every run keeps its own window."""
    from tokenloom.streaming import jobs
    calls = []

    class State:
        rows = []
        exists = lambda self: bool(self.rows)

        def get(self):
            calls.append("get")
            return self.rows

        def put(self, rows):
            calls.append("put")
            self.rows = list(rows)

    rnd = random.Random(8)
    rows = [(run, float(i), 100 * run + i, rnd.random()) for run in range(300) for i in range(24)]
    p = jobs.RateWindow(["x"], 5, 4)
    p.rings = State()
    got, dropped = {}, set()
    for k in range(2):
        part = [r for r in rows if r[1] // 12 == k] + [(7, 0.5, 99999, 1.0)] * (k == 1)  # the last one is too late
        rnd.shuffle(part)
        pdf = pd.DataFrame(part, columns=["run", "t", "tie", "x"]).assign(none=False)
        for out in p.handleInputRows((0,), iter([pdf[:1000], pdf[1000:]]), None):
            for r in out.itertuples():
                dropped |= {(r.run, r.tie)} if r.dropped else set()
                if not r.dropped:
                    got[r.run, r.tie] = None if pd.isna(r.x_per_sec) else r.x_per_sec
    assert calls == ["put", "get", "put"]
    assert dropped == {(7, 99999)}
    assert got == {k: pytest.approx(v) if v is not None else None for k, v in _rates(rows, 5).items()}


def test_runs_without_a_name_are_a_run_of_their_own(spark, tmp_path):
    rows = [(run, float(i), 100 * (run or 0) + i + (50 if run is None else 0), float(i)) for run in (0, None) for i in range(12)]
    got, dropped = _stream_rates(spark, tmp_path, [rows], window=4, late=4)
    assert not dropped and got == {k: pytest.approx(v) if v is not None else None for k, v in _rates(rows, 4).items()}


def test_stream_metric_log_equals_batch(spark, tmp_path):
    from tokenloom.sources.tables import read_metrics
    from tokenloom.streaming.jobs import stream_metric_log
    ev = spark.read.parquet(f"{SF}/events.parquet")
    sdf = (spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
           .select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("ts").cast("timestamp").alias("ts"),
                   F.col("event_type").alias("metric"), "value"))
    out, ck = str(tmp_path / "log"), str(tmp_path / "ck")
    stream_metric_log(sdf, out, ck)
    stream_metric_log(sdf, out, ck)  # restart with no new input: nothing is written twice
    got = read_metrics(spark, out)
    assert got.count() == ev.count()
    assert got.select("step").distinct().count() == ev.count()
    s = got.agg(F.sum("value")).first()[0]
    assert abs(s - ev.agg(F.sum("value")).first()[0]) < 1e-6


def test_stream_metrics_tumbling_equals_batch(spark, tmp_path):
    from tokenloom.streaming.jobs import latest, stream_metrics
    ev = spark.read.parquet(f"{SF}/events.parquet")
    sdf = (spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
           .withColumn("ts", F.col("ts").cast("timestamp")))
    out, ck = str(tmp_path / "m"), str(tmp_path / "ck")
    stream_metrics(sdf, "ts", ["event_type"], "value", "1 hour", None, "10 minutes", out, ck)
    got = {(r.window_start, r.event_type): (r.n, round(r.total, 9)) for r in latest(spark, out, ["window_start", "event_type"]).collect()}
    b = (ev.groupBy(F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("w"), "event_type")
         .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 9).alias("t")))
    want = {(r.w, r.event_type): (r.n, r.t) for r in b.collect()}
    assert got == want
