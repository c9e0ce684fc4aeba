"""Losses, quantisers, int4 codes and binary formats."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.quant import (fsq_codes, fsq_codes_to_index, fsq_index_to_codes, lfq_indices,
                                       lfq_quantize, pack_nibbles, unpack_nibbles)
from tokenloom.operators.metrics import cross_entropy
from tokenloom.operators.vectors import kernel_sums, quant_params
from tokenloom.sources import binary


def test_cross_entropy_all_ignored(spark):
    df = spark.createDataFrame([([1.0, 2.0], -1), ([0.5, 0.1], -1)], "z array<double>, t int")
    assert np.isnan(cross_entropy(df, "z", "t").first().loss)
    assert cross_entropy(df, "z", "t", empty="zero").first().loss == 0.0


def test_lfq_zero_component(spark):
    df = spark.createDataFrame([([0.0, 1.0, -2.0, 0.5],)], "x array<double>")
    r = df.select(lfq_quantize(F.col("x")).alias("q"), lfq_indices(F.col("x"), 4, 1).alias("i")).first()
    assert list(r.q) == [-1.0, 1.0, -1.0, 1.0] and list(r.i) == [0b0101]


def test_fsq_indices_roundtrip_all_codes(spark):
    levels = [8, 5, 5, 5]
    n = int(np.prod(levels))
    df = spark.range(n).withColumnRenamed("id", "idx")
    codes = fsq_index_to_codes(F.col("idx"), levels)
    back = fsq_codes_to_index([codes[j] for j in range(len(levels))], levels)
    assert df.filter(back != F.col("idx")).count() == 0


def test_nibble_pack_roundtrip(spark):
    df = spark.createDataFrame([([1.0, 15.0, 0.0, 7.0, 3.0],), ([],)], "c array<double>")
    r = df.select(pack_nibbles(F.col("c")).alias("p"), unpack_nibbles(pack_nibbles(F.col("c")), F.size("c")).alias("u")).collect()
    assert bytes(r[0].p) == bytes([0xF1, 0x70, 0x03]) and list(r[0].u) == [1, 15, 0, 7, 3]


def test_all_zero_group_gets_unit_range(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0)], "g int, v double")
    r = quant_params(df, ["g"], "v", 4).first()
    assert (r.xmin, r.xmax) == (-1.0, 1.0)


def test_kernel_block_sum_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(37, 8)).astype(np.float32)
    b = rng.normal(size=(23, 8)).astype(np.float32)
    A = spark.createDataFrame([(i, a[i].tolist()) for i in range(len(a))], "k bigint, v array<float>")
    B = spark.createDataFrame([(i, b[i].tolist()) for i in range(len(b))], "k bigint, v array<float>")

    def brute(x, y):
        d = ((x[:, None, :].astype(np.float64) - y[None, :, :]) ** 2).sum(-1)
        return np.exp(-d / 64.0).sum()

    got_ab = kernel_sums(A, B, "v", "k", 8, block_rows=5).first().ksum
    got_aa = kernel_sums(A, None, "v", "k", 8, block_rows=5).first().ksum
    assert got_ab == pytest.approx(brute(a, b), rel=1e-9)
    assert got_aa == pytest.approx(brute(a, a), rel=1e-9)


def _write_chunks(spark, path, rows, chunk):
    df = spark.createDataFrame(rows, "prefix string, chunk_id bigint, ids array<int>")
    binary.write_packed(df, path, chunk, "auto", vocab_size=1000)


def test_packed_roundtrip_and_header(spark, tmp_path):
    p = str(tmp_path / "pk")
    rows = [("train", i, list(range(i, i + 4))) for i in range(5)]
    _write_chunks(spark, p, rows, 4)
    assert sorted(f for f in os.listdir(p) if f != binary.MANIFEST)[0] == "train_0000000000.bin"
    head = open(os.path.join(p, "train_0000000003.bin"), "rb").read()[:24]
    assert head[:7] == binary.HDR_MAGIC and struct.unpack("<Q", head[7:15])[0] == 1 and head[15] == 8
    back = binary.read_packed(spark, p).orderBy("chunk_id").collect()
    assert [list(r.ids) for r in back] == [r[2] for r in rows]


def test_corrupt_headers_raise(spark, tmp_path):
    p = str(tmp_path / "bad")
    _write_chunks(spark, p, [("t", 0, [1, 2, 3, 4])], 4)
    f = os.path.join(p, "t_0000000000.bin")
    raw = bytearray(open(f, "rb").read())
    raw[:7] = b"XXXXXXX"
    open(f, "wb").write(raw)
    with pytest.raises(Exception):
        binary.read_packed(spark, p).collect()
    q = str(tmp_path / "v2")
    _write_chunks(spark, q, [("t", 0, [1, 2, 3, 4])], 4)
    g = os.path.join(q, "t_0000000000.bin")
    raw = bytearray(open(g, "rb").read())
    raw[7:15] = struct.pack("<Q", 2)
    open(g, "wb").write(raw)
    with pytest.raises(Exception):
        binary.read_packed(spark, q).collect()
    m = str(tmp_path / "mixed")
    _write_chunks(spark, m, [("t", 0, [1, 2, 3, 4])], 4)
    _write_chunks(spark, m, [("t", 1, [1, 2, 3, 4, 5, 6])], 6)
    with pytest.raises(Exception):
        binary.read_packed(spark, m).collect()


def test_uint16_overflow_raises(spark, tmp_path):
    df = spark.createDataFrame([("train", 0, [1, 70000])], "split string, start bigint, ids array<int>")
    with pytest.raises(Exception):
        binary.write_token_stream(df, str(tmp_path / "ts"))


def test_token_stream_roundtrip(spark, tmp_path):
    p = str(tmp_path / "ts")
    df = spark.createDataFrame([("train", 0, list(range(10))), ("train", 10, list(range(10, 15)))],
                               "split string, start bigint, ids array<int>")
    binary.write_token_stream(df, p)
    back = binary.read_token_stream(spark, p, tokens_per_row=4).orderBy("start").collect()
    assert [x for r in back for x in r.ids] == list(range(15))
    # rows never cross a multiple of tokens_per_row (nor a part-file boundary)
    assert [r.start for r in back] in ([0, 4, 8, 12], [0, 4, 8, 10, 12])
    # a shorter rewrite by URI leaves no stale parts
    binary.write_token_stream(df.limit(1), f"file://{p}", part_bytes=8)
    back = binary.read_token_stream(spark, f"file://{p}", tokens_per_row=4).orderBy("start").collect()
    assert [x for r in back for x in r.ids] == list(range(10))
    assert len([f for f in os.listdir(os.path.join(p, "train")) if f.endswith(".bin")]) == 1


@pytest.mark.parametrize("name,values", [
    ("uint8", [0, 255]), ("int8", [-128, 127]), ("int16", [-32768, 32767]), ("int32", [-2**31, 2**31 - 1]), ("int64", [2**33 + 7, -2**40]),
    ("float32", [0.75, 1.5]), ("float64", [0.1, -2.5]), ("uint16", [0, 65535])])
def test_every_dtype_code(spark, tmp_path, name, values):
    kind = "double" if name.startswith("float") else "bigint"
    df = spark.createDataFrame([("t", 0, values), ("t", 1, values[::-1])], f"prefix string, chunk_id bigint, ids array<{kind}>")
    binary.write_packed(df, f"file://{tmp_path}/p", 2, name)
    back = binary.read_packed(spark, f"file://{tmp_path}/p").orderBy("chunk_id").collect()
    assert [list(r.ids) for r in back] == [values, values[::-1]] and back[0].dtype_code == binary.NAMES[name]
    stream = df.selectExpr("prefix AS split", "chunk_id * 2 AS start", "ids")
    binary.write_token_stream(stream, f"file://{tmp_path}/s", name)
    back = binary.read_token_stream(spark, f"file://{tmp_path}/s", name).orderBy("start").collect()
    assert [x for r in back for x in r.ids] == values + values[::-1]


def test_cut_values_raise(spark, tmp_path):
    df = spark.createDataFrame([("t", 0, [0.5, 1.0])], "prefix string, chunk_id bigint, ids array<double>")
    with pytest.raises(Exception):
        binary.write_packed(df, str(tmp_path / "x"), 2, "int32")


def test_batch_mmd_equals_brute_force(spark):
    from tokenloom.operators.vectors import batch_mmd, normal_draws
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 8))
    df = spark.createDataFrame([(i // 10, x[i].tolist()) for i in range(30)], "b bigint, v array<double>")
    z = np.array([r.z for r in normal_draws(spark, 16, 8, 3).orderBy("draw").collect()])
    assert abs(z.mean()) < 0.3 and 0.6 < z.std() < 1.4
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(-1) / 64.0).mean()
    got = {r.b: r.mmd for r in batch_mmd(df, "b", "v", 8, 16, 3).collect()}
    for b in range(3):
        a = x[b * 10:b * 10 + 10]
        assert got[b] == pytest.approx(k(a, a) + k(z, z) - 2 * k(a, z), rel=1e-9)


def test_registered_mmd_and_bootstrap_have_the_reference_counts(spark):
    from tests.conftest import SF_SMALL
    from tokenloom.operators.vectors import normal_draws
    from tokenloom.plans import lookups, vectors
    z = np.array([r.z for r in normal_draws(spark, 256, vectors.DIM, vectors.SEED).orderBy("draw").collect()])
    rows = vectors.batched(spark, SF_SMALL).where("batch = 0").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(-1) / vectors.DIM ** 2).mean()
    got = vectors.q_j4_pairwise(spark, SF_SMALL).where("batch = 0").first()
    assert [got.k_aa, got.k_ab, got.k_bb] == pytest.approx([k(x, x), k(x, z), k(z, z)], abs=2e-9)
    assert {r.bootstrap_iters for r in lookups.q_a18_eval_rollup(spark, SF_SMALL).collect()} == {100000}


def test_vectors_of_another_length_raise(spark):
    from tokenloom.functions.quant import fsq, lfq
    df = spark.createDataFrame([([0.1] * 7,)], "v array<double>")
    with pytest.raises(Exception):
        df.select(fsq(F.col("v"), [8, 5], 4)[1]).collect()
    with pytest.raises(ValueError):
        lfq(F.col("v"), 12, 2)
