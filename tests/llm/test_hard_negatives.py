"""Hard negatives against plain Python, and the threshold join against full products."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every=50, positives=5, negatives=3):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (label, None)) if i in best else (label, [math.floor(256 * float(np.float32(x))) for x in v]), (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in best.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            window = [i for i in order if best[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(window[:negatives])]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, every=50):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, F.col("label")).collect())


def vectors(seed, n, dims, labels=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * np.linspace(2, 0.2, dims)
    return [(i, int(rng.integers(labels)), [float(v) for v in x[i] / np.linalg.norm(x[i])]) for i in range(n)]


@pytest.mark.parametrize("dims", [3, 20])
def test_equals_plain_python(spark, monkeypatch, dims):
    for name, size in (("ROW_BLOCK", 64), ("ANCHOR_BLOCK", 3), ("STEP", 2), ("GROUP", 4)):
        monkeypatch.setattr(H, name, size)
    rows = vectors(dims, 260, dims)
    rows += [(300 + i, i % 2, rows[50][2]) for i in range(40)]  # a group of equal vectors, anchors among them
    assert mined(spark, rows, every=25) == brute(rows, every=25)


def test_corner_rows(spark):
    rows = vectors(1, 60, 6, labels=2)
    rows += [(None, 1, [0.5] * 6), (70, None, [0.5] * 6), (71, 1, None), (72, 1, [0.5, None, 0.1]), (73, 1, [float("nan")] * 6), (74, 0, [float("inf")] * 6),
             (75, 0, []), (100, 1, [0.0] * 6), (150, 1, [0.9, 0.1]), (3, 0, rows[3][2]), rows[5], rows[5], rows[0]]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [(50, 1, [1.0, 0.0]), (51, 1, [0.5, 0.5])]) == []  # no other label
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == []


def test_clashing_columns_and_large_components(spark):
    rows = [(*r, 1, 2, "x") for r in vectors(2, 80, 5, labels=3)]
    assert mined(spark, rows, SCHEMA + ", rank int, score int, vector string") == brute([r[:3] for r in rows])
    big = [(i, i % 2, [float(2.0 ** 20 * (1 + i % 5)), 1.0]) for i in range(60)]
    assert mined(spark, big) == brute(big)
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(50, 1, [1e30]), (51, 0, [1e30])])


def test_index_finds_all_pairs_over_the_threshold():
    rng = np.random.default_rng(0)
    rows, anchors = (rng.integers(-50, 50, (n, 30)).astype(float) for n in (200, 17))
    rows[:, 10:] /= 10
    rows = np.floor(rows)
    cuts = np.append(np.arange(0, 30, 8), 30)
    norms = H._suffix_norms(anchors, cuts)
    full = anchors @ rows.T
    for level in (0.0, 2000.0, 9000.0):
        threshold = np.full(17, level)
        index = H.Index(rows, cuts, level, norms)
        assert level == 0.0 or index.lists[-1] < 200 or level < 5000
        q, x, s = index.pairs(anchors, norms, threshold)
        found = {(int(a), int(b)): v for a, b, v in zip(q, x, s)}
        for a, b in zip(*np.nonzero(full >= level)):
            assert found[int(a), int(b)] == full[a, b]
        assert all(full[k] == v for k, v in found.items())
