"""Packing, offsets, blocks, shards and groups: corner rows and properties."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenloom.operators.offsets import contiguous_shards, running_offset
from tokenloom.operators.packing import assign_shards, blocks, chunk_groups, pack


def _docs(spark, lengths, start_id=0):
    rows = [(i + start_id, list(range(100 * i + 1, 100 * i + 1 + n))) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id bigint, ids array<int>")


def _pack(spark, lengths, C):
    d = _docs(spark, lengths)
    out = pack(d, C, 0, order="doc_id", bucket=F.shiftright(F.col("doc_id"), 1))
    return [(r.chunk_id, r.n_tokens, list(r.ids)) for r in out.orderBy("chunk_id").collect()]


def test_exact_multiple_has_no_fill_and_no_extra_chunk(spark):
    ch = _pack(spark, [3, 5], 4)
    assert [c[1] for c in ch] == [4, 4]
    assert ch[0][2] == [1, 2, 3, 101] and ch[1][2] == [102, 103, 104, 105]


def test_long_document_spans_chunks_and_last_is_filled(spark):
    ch = _pack(spark, [13], 4)
    assert len(ch) == 4
    assert ch[-1][1] == 1 and ch[-1][2] == [13, 0, 0, 0]
    flat = [x for c in ch for x in c[2][:c[1]]]
    assert flat == list(range(1, 14))


def test_empty_document_adds_nothing(spark):
    ch = _pack(spark, [0, 2], 4)
    assert ch == [(0, 2, [101, 102, 0, 0])]


def test_concat_of_chunks_equals_concat_of_documents(spark):
    lengths = [5, 0, 17, 1, 9, 33, 2]
    ch = _pack(spark, lengths, 8)
    flat = [x for c in ch for x in c[2][:c[1]]]
    expect = [x for i, n in enumerate(lengths) for x in range(100 * i + 1, 100 * i + 1 + n)]
    assert flat == expect
    assert all(c[1] == 8 for c in ch[:-1])


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_running_offset_equals_plain_window(spark, parts):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7 + 1).alias("w"),
                                 (F.col("id") % 3).alias("p")).repartition(parts)
    got = running_offset(df, "k", F.shiftright(F.col("k"), 5), "w", "p", out="start")
    ref = df.withColumn("ref", F.coalesce(F.sum("w").over(
        Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = got.join(ref, ["k", "p"])
    assert j.filter(F.col("start") != F.col("ref")).count() == 0
    assert j.count() == 500


def test_contiguous_shards_match_ntile_rule(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    s = contiguous_shards(df, "k", F.lit(0), 4)
    sizes = [r["count"] for r in s.groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [3, 3, 2, 2]


def test_block_remainder_dropped(spark):
    ch = spark.createDataFrame([(0, list(range(10)))], "chunk_id bigint, ids array<int>")
    b = blocks(ch, 4, 10).orderBy("block_id").collect()
    assert [list(r.ids) for r in b] == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_shard_drop(spark):
    files = spark.range(10).withColumnRenamed("id", "f")
    s = assign_shards(files, "f", 2, 2).collect()
    assert len(s) == 8
    by = {}
    for r in s:
        by.setdefault(r.shard, []).append(r.f)
    assert all(len(v) == 2 for v in by.values()) and sorted(by[1]) == [1, 5]


def test_group_drop_and_wrap(spark):
    files = spark.range(5).withColumnRenamed("id", "f")
    g = chunk_groups(files, "f", 2, epochs=2, wrap=True).collect()
    groups = sorted({(r.epoch, r.group_id, r.f) for r in g})
    assert [x for x in groups if x[0] == 0] == [(0, 0, 0), (0, 0, 1), (0, 1, 2), (0, 1, 3)]
    assert {x[2] for x in groups} == {0, 1, 2, 3}
    assert {x[0] for x in groups} == {0, 1}


def test_pack_independent_of_buckets_and_partitions(spark):
    from tokenloom.functions.hashing import h48
    from tokenloom.operators.offsets import hash_bucket
    rows = [(i, list(range(i * 10, i * 10 + (i * 7) % 23))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>").withColumn("h", h48(7, F.col("doc_id")))
    outs = []
    for bits, parts, nparts in [(1, 1, None), (6, 4, 3), (12, 13, 17)]:
        d = df.repartition(parts)
        ch = pack(d, 16, 0, order=["h", "doc_id"], bucket=hash_bucket(F.col("h"), bits), num_partitions=nparts)
        outs.append(sorted((r.chunk_id, r.n_tokens, tuple(r.ids)) for r in ch.collect()))
    assert outs[0] == outs[1] == outs[2]


def test_halo_window_equals_plain_window_across_buckets(spark):
    from tokenloom.operators.metrics import iter_time, throughput
    rows = [(r, s, float(s * 3 + r + (s % 5) * 0.25), float(s * 2 + r)) for r in range(3) for s in range(57)]
    df = spark.createDataFrame(rows, "run bigint, step bigint, t double, c double")
    got = throughput(df, "run", "step", F.col("t"), ["c"], window=5, bucket_rows=8)
    it = iter_time(df, "run", "step", F.col("t"), 4, bucket_rows=8)
    fr = Window.partitionBy("run").orderBy("step").rowsBetween(-4, 0)
    dt = F.col("t") - F.first("t").over(fr)
    ref = df.withColumn("ref", F.when(dt > 0, (F.col("c") - F.first("c").over(fr)) / dt)) \
            .withColumn("ref_dt", F.col("t") - F.lag("t").over(Window.partitionBy("run").orderBy("step")))
    j = got.join(ref, ["run", "step"]).join(it.select("run", "step", "dt"), ["run", "step"])
    assert j.count() == len(rows)
    bad = j.filter(~F.col("c_per_sec").eqNullSafe(F.col("ref")) | ~F.col("dt").eqNullSafe(F.col("ref_dt")))
    assert bad.count() == 0


def test_running_offset_with_one_row_per_bucket(spark):
    from pyspark.sql import functions as F

    from tokenloom.operators.offsets import running_offset
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("w"), (F.col("id") % 3).alias("p"))
    got = running_offset(df, "id", F.col("id"), "w", "p", total="all")
    assert "BroadcastExchange" not in got._jdf.queryExecution().sparkPlan().toString()
    seen, want = {0: 0, 1: 0, 2: 0}, {}
    for i in range(5000):
        want[i] = seen[i % 3]
        seen[i % 3] += i % 7
    assert {r.id: r.start for r in got.collect()} == want
    assert {r.p: r.all for r in got.select("p", "all").distinct().collect()} == seen


def test_one_long_row_packs(spark):
    from pyspark.sql import functions as F

    from tokenloom.operators.packing import pack
    n = 1_000_000
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: (x % 251).cast("int")).alias("ids"))
    got = pack(df, 4096, 0, order=["id"], bucket=F.lit(0)).select("chunk_id", "n_tokens", F.element_at("ids", 1).alias("first")).collect()
    assert sum(r.n_tokens for r in got) == n and all(r.first == r.chunk_id * 4096 % 251 for r in got)
