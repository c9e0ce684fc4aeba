"""R3 by document offsets: equal to cutting the whole stream, and only covering documents are tokenised."""
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.sampling import sample_windows_by_offset


def corpus(seed, n):
    rnd = random.Random(seed)
    docs, at, stream = [], 0, []
    for k in range(n):
        ids = [rnd.randrange(1000) for _ in range(rnd.choice([0, 1, 3, 10, 50, 400]))]
        docs.append((k, at, len(ids), ids))
        at += len(ids)
        stream += ids
    return docs, stream


@pytest.mark.parametrize("span", [7, 64, None])
def test_equals_cutting_the_stream(spark, span):
    docs, stream = corpus(1, 60)
    offsets = spark.createDataFrame([d[:3] for d in docs], "doc long, start long, len long").repartition(3)
    texts = spark.createDataFrame([(d[0], d[3]) for d in docs], "doc long, ids array<int>")
    asked = []

    def tokens(keys):
        asked.append(sorted(r["doc"] for r in keys.collect()))
        return texts.join(keys, "doc")

    bs = 25
    rows = sample_windows_by_offset(offsets, "doc", tokens, 40, bs, seed=9, span=span).collect()
    assert len(rows) == 40 and {r["draw"] for r in rows} == set(range(40))
    covering = set()
    for r in rows:
        assert 0 <= r["i"] < len(stream) - bs
        assert list(r["x"]) == stream[r["i"]:r["i"] + bs] and list(r["y"]) == stream[r["i"] + 1:r["i"] + 1 + bs]
        covering |= {k for k, at, n, _ in docs if n and at < r["i"] + bs + 1 and at + n > r["i"]}
    assert asked == [sorted(covering)] and len(covering) < 60


def test_registered_windows_tokenise_only_covering_documents(spark, monkeypatch):
    from tests.conftest import SF_SMALL
    from tokenloom.plans import corpus as C
    seen = []
    real = C.tokenize
    monkeypatch.setattr(C, "tokenize", lambda df, *a, **k: (seen.append(df.count()), real(df, *a, **k))[1])
    monkeypatch.setattr(C, "WINDOWS", 5)
    got = C.q_r3_sample_windows(spark, SF_SMALL).collect()
    assert len(got) == 5 and seen[0] < 30 < spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert C.train_offsets(spark, SF_SMALL).columns == ["doc_id", "start", "len"]


def test_whole_division_of_large_offsets(spark):
    big = (1 << 60) + 4095
    offsets = spark.createDataFrame([(1, big, 10)], "doc long, start long, len long")
    from tokenloom.operators.sampling import covering_rows
    draws = spark.createDataFrame([(0, big + 9), (1, big + 10)], "draw long, i long")
    assert [r["draw"] for r in covering_rows(draws, offsets, "doc", 1, 4096).collect()] == [0]
