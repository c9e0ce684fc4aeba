"""Nearest codes of a table, tiled Gram matrices, loss switches, error sums and many stop sequences, by brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import vectors as V
from tokenloom.operators.batches import truncate_at_stop
from tokenloom.operators.stops import StopAutomaton, truncate_at_stops


def frame(spark, x, names=("k", "v")):
    return spark.createDataFrame([(i, [float(f) for f in r]) for i, r in enumerate(x)], f"{names[0]} long, {names[1]} array<double>")


@pytest.mark.parametrize("block", [1 << 14, 700])
def test_nearest_of_five_thousand_codes(spark, monkeypatch, block):
    monkeypatch.setattr(V, "CODE_BLOCK", block)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 150)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 12)), rng.normal(size=(5000, 12))
    y[4000:4010] = y[10:20]  # equal codes: the least id stands
    x[:20] = y[10:30]
    d = ((x[:, None] - y[None]) ** 2).sum(-1)
    df = frame(spark, x).unionByName(spark.createDataFrame([(1000, None)], "k long, v array<double>")).repartition(3)
    got = {r["k"]: (r["code"], r["distance"]) for r in V.nearest_codes(df, "k", "v", frame(spark, y, ("c", "y")), "c", "y").collect()}
    assert set(got) == set(range(400))
    for k in range(400):
        assert got[k][0] == int(d[k].argmin()) and got[k][1] == pytest.approx(d[k].min(), abs=1e-12)


def test_nearest_of_no_codes_and_other_lengths(spark):
    df = frame(spark, [[1, 2]])
    assert V.nearest_codes(df, "k", "v", frame(spark, [], ("c", "y")), "c", "y").collect() == []
    with pytest.raises(Exception):
        V.nearest_codes(df, "k", "v", spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "c long, y array<double>"), "c", "y").collect()


@pytest.mark.parametrize("dim,tile,room", [(1, 256, 1 << 27), (10, 4, 1 << 27), (10, 4, 200), (13, 5, 1)])
def test_tiles_equal_the_product(spark, monkeypatch, dim, tile, room):
    monkeypatch.setattr(V, "TILE", tile)
    monkeypatch.setattr(V, "TILE_BYTES", room)
    monkeypatch.setattr(V, "TILE_FAN", 2)
    x = np.random.default_rng(dim).normal(size=(70, dim))
    got = {(r["i"], r["j"]): r["h"] for r in V.gram(frame(spark, x).repartition(7), "v", dim).collect()}
    h = 2 / 70 * x.T @ x
    assert set(got) == {(i, j) for i in range(dim) for j in range(i, dim)}
    assert all(v == pytest.approx(h[k], abs=1e-12) for k, v in got.items())


def test_wide_vectors_stay_within_the_workers_memory(spark):
    import resource
    dim, rows = 4096, 24
    df = spark.range(rows).select(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.sin(j * 0.37 + F.col("id") * 1.3)).alias("v")).repartition(3)
    tiles = V.gram_tiles(df, "v", dim)
    x = np.sin(np.arange(dim)[None] * 0.37 + np.arange(rows)[:, None] * 1.3)
    seen = 0

    @F.udf("long")
    def peak(_):
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024

    for r in tiles.where("i = 15 AND j = 15 OR i = 0 AND j = 9").select("i", "j", "n", "tile", peak("i").alias("mb")).collect():
        t = np.frombuffer(bytes(r["tile"]), np.float64).reshape(256, 256)
        assert r["n"] == rows and r["mb"] < 1500
        assert np.allclose(t, x[:, r["i"] * 256:(r["i"] + 1) * 256].T @ x[:, r["j"] * 256:(r["j"] + 1) * 256], atol=1e-9)
        seen += 1
    assert seen == 2 and tiles.count() == 16 * 17 // 2


def test_gram_of_no_rows_and_other_lengths(spark):
    assert V.gram(frame(spark, []), "v", 3).collect() == []
    with pytest.raises(Exception):
        V.gram(frame(spark, [[1, 2]]), "v", 3).collect()


def test_losses_outside_training_are_zero(spark):
    df = spark.createDataFrame([(i, i // 3, [0.1 * i, -0.2, 0.3, 0.4]) for i in range(6)], "k long, b long, v array<double>")
    off = V.lfq_losses(df, "k", "v", 2, 2, batch="b", training=False)
    assert sorted(tuple(r) for r in off.collect()) == [(0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0)]
    assert V.lfq_losses(df, "k", "v", 2, 2, training=False, return_breakdown=False).collect()[0].asDict() == {"aux_loss": 0.0}
    on = V.lfq_losses(df, "k", "v", 2, 2, batch="b")
    short = V.lfq_losses(df, "k", "v", 2, 2, batch="b", return_breakdown=False)
    assert on.columns == off.columns and short.columns == ["batch", "aux_loss"]
    assert {r["batch"]: r["aux_loss"] for r in on.collect()} == {r["batch"]: r["aux_loss"] for r in short.collect()}


def test_error_sums(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5, 2.0), ("a", 2.0, 2.5, 4.0), ("b", None, 1.0, 1.0), ("b", 1.0, 1.0, 1.0)], "g string, w double, q double, d double")
    got = {r["g"]: (r["error"], r["n"]) for r in V.quant_error(df, ["g"], F.col("w"), F.col("q"), F.col("d")).collect()}
    assert got == {"a": (0.25 * 2 + 0.25 * 4, 2), "b": (0.0, 1)}
    assert {r["g"]: r["error"] for r in V.quant_error(df, ["g"], F.col("w"), F.col("q")).collect()} == {"a": 0.5, "b": 0.0}


@pytest.mark.parametrize("options", [{}, {"keep_stop": True}, {"compat": True}])
def test_many_stops_equal_one_search_each(spark, options):
    rnd = random.Random(11)
    rows = [([rnd.randrange(6) for _ in range(rnd.randint(0, 40))],) for _ in range(200)] + [([],), (None,)]
    stops = [[rnd.randrange(6) for _ in range(rnd.randint(2, 5))] for _ in range(25)] + [[0, 1, 2, 3], [1, 2], [2, 2, 2, 2, 2, 2]]
    df = spark.createDataFrame(rows, "ids array<int>")
    both = df.select("ids", truncate_at_stops(F.col("ids"), stops, **options).alias("a"), truncate_at_stop(F.col("ids"), stops, **options).alias("b")).collect()
    for r in both:
        assert r["a"] == r["b"], (r, options)


def test_a_thousand_stops_are_linear():
    rnd = random.Random(2)
    stops = [[rnd.randrange(50) for _ in range(rnd.randint(3, 8))] for _ in range(1000)]
    texts = [[rnd.randrange(60) for _ in range(rnd.randint(0, 300))] for _ in range(300)]
    offsets = np.cumsum([0, *map(len, texts)])
    ids = np.array([x for t in texts for x in t], np.int64)
    end, length = StopAutomaton(stops).run(offsets, ids)
    for t, e, n in zip(texts, end, length, strict=True):
        found = [(i + len(s), -len(s)) for s in stops for i in range(len(t) - len(s) + 1) if t[i:i + len(s)] == s]
        assert (e, -n) == min(found, default=(0, 0))
    assert StopAutomaton([]).run(offsets, ids)[0].sum() == 0 and StopAutomaton([[]]).classes == 0
