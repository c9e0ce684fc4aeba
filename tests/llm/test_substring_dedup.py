import random

import pytest

from tests.llm import brute
from tokenloom.llm import substring_dedup as S


def result(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(10, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rnd.choice(["alpha", "é", "beta", "γ,", "Delta."]) for _ in range(rnd.randint(0, 40))) for _ in range(3)]
        parts.insert(rnd.randint(0, 3), rnd.choice(passages))
        rows.append((i * 7, rnd.choice(["\n", "  ", " \t", "\r\n"]).join(parts)))
    rows += [(5, None), (6, ""), (8, "  \n"), (9, rows[3][1]), (2, rows[3][1]), (1000, " ".join(["x"] * 5000)), (1001, " x " * 30)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", [1 << 23, 900])
def test_equals_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(S, "RANGE_BYTES", ranges)
    monkeypatch.setattr(S, "BUCKET_WINDOWS", 400)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(S.removals(df)) == brute.substring_dedup(rows)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (1, text), (None, "other " + text), (3, None)]
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["n_removed"]) for r in S.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(False, None, 0), (True, 1, 20), (True, 1, 20), (True, 3, 0)]


def test_empty_table_and_clashing_columns(spark):
    assert S.removals(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = " ".join(f"w{i}" for i in range(13))
    df = spark.createDataFrame([(1, text, "a", 4), (2, "lead  in " + text + "\ntail", "b", 5), (3, None, None, 6)], "doc_id long, text string, hashes string, id_range int")
    rows = {r["doc_id"]: r for r in S.cut_repeats(df).collect()}
    assert rows[1]["text"] == text and rows[2]["text"] == "lead  in tail" and rows[2]["hashes"] == "b" and rows[3]["text"] is None
    spans = {r["doc_id"]: r["intervals"] for r in S.removals(df).collect()}
    assert [tuple(x) for x in spans[2]] == [(2, 15)] and spans[1] == []


def test_messages_do_not_depend_on_the_order_of_the_rows(spark):
    """One row per (flush, bucket), however many id ranges a task holds."""
    import numpy as np
    import pyarrow as pa
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(40))) for i in range(400)]
    sent = {}
    for name, order in (("sorted", rows), ("shuffled", rnd.sample(rows, len(rows)))):
        send = S._sender("doc_id", "text", 13, [i * 20 - 1 for i in range(1, 20)], 7)
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in order]), pa.array([r[1] for r in order])], names=["doc_id", "text"])
        out = [b for b in send(iter([batch]))]
        sent[name] = sum(b.num_rows for b in out)
        pairs = [(h, r) for b in out for x, u, c in zip(*(b.column(k).to_pylist() for k in ("hashes", "ranges", "codes")))
                 for h, r in zip(S.B.unpack_sorted(x), S._unpack_ranges(u, c, len(S.B.unpack_sorted(x))))]
        assert len(set(pairs)) == len(pairs)
        sent[name, "pairs"] = set(pairs)
    assert sent["sorted"] == sent["shuffled"] == 7
    assert sent["sorted", "pairs"] == sent["shuffled", "pairs"] and len({r for _, r in sent["sorted", "pairs"]}) == 20
    assert np.array_equal(S._unpack_ranges(*S._pack_ranges(np.array([5, 5, 5])), 3), [5, 5, 5])
