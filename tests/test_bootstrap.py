"""The bootstrap against plain Python draws, theory, and other partitionings."""
import hashlib
import math

import numpy as np
import pytest

from tokenloom.operators import metrics as M


def uniform(key, i):
    m = (1 << 64) - 1
    z = (key + (i + 1) * 0x9E3779B97F4A7C15) & m
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
    return (((z ^ (z >> 31)) >> 16) + 0.5) / 2 ** 48


def weight(n, u):
    k, p = 0, math.exp(-n)
    total = p
    while total < u:
        k += 1
        p *= n / k
        total += p
    return k


def brute(rows, iters, seed=42):
    out = {}
    for task in {t for t, _ in rows}:
        counts = {}
        for t, s in rows:
            if t == task and s is not None:
                counts[s] = counts.get(s, 0) + 1
        means = []
        for i in range(iters):
            w = {s: weight(n, uniform(int(hashlib.md5(f"{seed}:{task}:{s}".encode()).hexdigest()[:12], 16), i)) for s, n in counts.items()}
            if sum(w.values()):
                means.append(sum(s * x for s, x in w.items()) / sum(w.values()))
        if means:
            out[task] = (np.std(means, ddof=1) if len(means) > 1 else None, len(means))
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_plain_draws(spark, monkeypatch, partitions):
    monkeypatch.setattr(M, "BOOT_BLOCK", 70)
    monkeypatch.setattr(M, "BOOT_HOLD", 2)
    rows = [("a", float(i % 3)) for i in range(40)] + [("b", 0.5)] * 7 + [("b", None), ("c", None), ("one", 2.0), ("a", -1.25)]
    df = spark.createDataFrame(rows, "task string, score double").repartition(partitions)
    got = {r["task"]: (r["stderr"], r["iters"]) for r in M.bootstrap_se(df, "task", "score", 300).collect()}
    want = brute(rows, 300)
    assert set(got) == set(want)
    for t in want:
        assert got[t][1] == want[t][1] and got[t][0] == pytest.approx(want[t][0], abs=1e-12)
    assert got["one"][1] < 300  # an iteration that draws nothing has no mean


def test_standard_error_of_a_share(spark):
    rows = [("t", float(i % 4 == 0)) for i in range(2000)]
    se = M.bootstrap_se(spark.createDataFrame(rows, "task string, score double"), "task", "score", 20000).first()["stderr"]
    assert se == pytest.approx(math.sqrt(0.25 * 0.75 / 2000), rel=0.03)


def test_tables_and_empty_input(spark):
    for n in (1, 2, 37, 5000, 10 ** 7):
        lo, cdf = M.poisson_table(n)
        assert cdf[-1] == pytest.approx(1, abs=1e-6) and lo + np.searchsorted(cdf, 0.5) == pytest.approx(n, abs=1)
    assert M.bootstrap_se(spark.createDataFrame([], "task string, score double"), "task", "score", 100).collect() == []


def test_every_example_draws_its_own_weight(spark, monkeypatch):
    monkeypatch.setattr(M, "BOOT_BLOCK", 70)
    rows = [("a", float(i % 2), i) for i in range(40)] + [("b", 0.5 * (i % 3), i) for i in range(9)] + [("b", None, 50), ("b", 1.0, None), ("a", 1.0, 3), (None, 2.0, 7), (None, 1.0, 8)]
    df = spark.createDataFrame(rows, "task string, score double, id long").repartition(3)
    got = {r["task"]: (r["stderr"], r["iters"]) for r in M.bootstrap_se(df, "task", "score", 200, key="id").collect()}
    key = lambda i: int(hashlib.md5(("42" if i is None else f"42:{i}").encode()).hexdigest()[:12], 16)
    for task in ("a", "b", None):
        own = [(s, key(i)) for t, s, i in rows if t == task and s is not None]
        drawn = [[(s, weight(1, uniform(k, it))) for s, k in own] for it in range(200)]
        means = [sum(s * w for s, w in d) / sum(w for _, w in d) for d in drawn if sum(w for _, w in d)]
        assert got[task][1] == len(means) and got[task][0] == pytest.approx(np.std(means, ddof=1), abs=1e-12)


def test_the_registered_query_draws_per_example(spark, tmp_path):
    from tokenloom.plans import lookups
    spark.createDataFrame([(i, i % 2, int(i < 5)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["task"]: r["stderr"] for r in lookups.q_a19_bootstrap_se(spark, str(tmp_path)).collect()}
    scores = lookups.task_scores(spark, str(tmp_path))
    want = {r["task"]: r["stderr"] for r in M.bootstrap_se(scores, "task", "score", lookups.BOOT_ITERS, key="doc_id").collect()}
    assert all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want) and set(got) == set(want)
    grouped = {r["task"]: r["stderr"] for r in M.bootstrap_se(scores, "task", "score", lookups.BOOT_ITERS).collect()}
    assert got["quality"] != pytest.approx(grouped["quality"], abs=1e-8)
