"""The stored answer cache: nothing is computed or stored twice, whoever retries or comes first."""
import os

import pytest
from pyspark.sql import functions as F

from tokenloom.sources.cache import AnswerCache


@pytest.fixture
def cache(spark, tmp_path):
    return AnswerCache(spark, str(tmp_path / "c"), "id", "answer string, n int")


class Model:
    """Counts the requests it is asked for."""

    def __init__(self):
        self.asked = []

    def __call__(self, requests):
        self.asked.append(sorted((r["id"] is not None, r["id"] or 0) for r in requests.collect()))
        return requests.select("id", F.upper("text").alias("answer"), F.length("text").alias("n"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def result(df):
    return sorted(((r["id"], r["text"], r["answer"], r["n"], r["from_cache"]) for r in df.collect()), key=str)


def test_second_run_computes_nothing(spark, cache):
    m, rows = Model(), [(i, f"t{i}") for i in range(10)] + [(3, "t3")]
    first = result(cache.lookup(frame(spark, rows), m))
    assert first == sorted([(i, t, t.upper(), 2, False) for i, t in rows], key=str)
    assert len(m.asked[0]) == 10  # a repeated request is computed once
    version = cache.version()
    assert result(cache.lookup(frame(spark, rows), m)) == [(*r[:4], True) for r in first]
    assert m.asked[1] == [] and cache.version() == version == 1
    more = result(cache.lookup(frame(spark, [(9, "t9"), (10, "t10")]), m))
    assert [r[4] for r in more] == [False, True] and m.asked[2] == [(True, 10)] and cache.version() == 2


def test_a_retried_job_stores_nothing_twice(spark, cache, monkeypatch):
    rows = [(i, f"t{i}") for i in range(6)]
    # the job dies between writing its answers and committing them
    monkeypatch.setattr(AnswerCache, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        cache.lookup(frame(spark, rows), Model())
    monkeypatch.undo()
    assert cache.version() == 0 and cache.answers().count() == 0 and len(os.listdir(f"{cache.root}/data")) == 1
    m = Model()
    cache.lookup(frame(spark, rows), m)  # the retry
    cache.lookup(frame(spark, rows), m)  # and a retry of the whole job after its commit
    assert [len(a) for a in m.asked] == [6, 0]
    assert cache.answers().count() == 6 and cache.answers().select("id").distinct().count() == 6
    assert len(cache.vacuum()) == 1 and cache.answers().count() == 6


def test_two_writers_at_once(spark, cache):
    other = AnswerCache(spark, cache.root, "id", "answer string, n int")
    late = []

    def slow(requests):
        if not late:  # while this job computes, another one stores some of the same keys
            late.append(1)
            other.lookup(frame(spark, [(1, "t1"), (2, "t2"), (50, "t50")]), Model())
        return Model()(requests)

    got = result(cache.lookup(frame(spark, [(i, f"t{i}") for i in range(5)]), slow))
    assert [r[:4] for r in got] == [(i, f"t{i}", f"T{i}", 2) for i in range(5)]
    assert cache.version() == 2
    stored = sorted(r["id"] for r in cache.answers().collect())
    assert stored == [0, 1, 2, 3, 4, 50]


def test_compaction_keeps_answers_and_older_readers(spark, cache):
    for k in range(4):
        cache.lookup(frame(spark, [(i, f"t{i}") for i in range(5 * k, 5 * k + 5)]), Model())
    before, reader = sorted(map(tuple, cache.answers().collect())), cache.answers()
    assert len(cache.folders(4)) == 4
    assert cache.compact(2) == 5 and len(cache.folders(5)) == 1
    assert sorted(map(tuple, cache.answers().collect())) == before == sorted(map(tuple, reader.collect()))
    assert cache.compact() == 5
    m = Model()
    assert all(r[4] for r in result(cache.lookup(frame(spark, [(i, f"t{i}") for i in range(20)]), m))) and m.asked == [[]]
    assert len(cache.vacuum()) == 4 and sorted(map(tuple, cache.answers().collect())) == before and cache.version() == 5


def test_no_requests_and_requests_without_a_key(spark, cache):
    m = Model()
    assert cache.lookup(frame(spark, []), m).collect() == [] and cache.version() == 0
    got = cache.lookup(frame(spark, [(None, "a"), (None, "b"), (1, "c")]), m).collect()
    assert sorted((r["id"] is None, r["answer"], r["from_cache"]) for r in got) == [(False, "C", False), (True, "A", False), (True, "B", False)]
    assert cache.answers().count() == 1
