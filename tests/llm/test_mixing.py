"""Mixing against a plain Python version: targets, cuts, epochs and the texts themselves."""
import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tokenloom.llm import mixing as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(3, 1, 2)):
    """rows: (doc_id, source, text) -> sorted [(doc_id, size, source_size, target, taken)]"""
    docs = defaultdict(list)
    for d, s, t in rows:
        key = int(hashlib.md5(f"42:{'null' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
        docs[s].append((key, len(WORDS.findall(t or "")), -1 if d is None else d, d))
    names = sorted(docs, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[1] for x in docs[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), Fraction(3 * sum(size.values()), 2)
    while True:
        open_ = [s for s in names if s not in full]
        fair = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if fair[s] > 2 * size[s]]
        target.update(fair)
        if not above:
            break
        for s in above:
            target[s] = Fraction(2 * size[s])
            left -= 2 * size[s]
        full.update(above)
    out = []
    for s in names:
        budget = int(float(target[s]) + 0.5)
        epochs = budget // size[s] if size[s] else 0
        rest = budget - epochs * size[s]
        for _, n, _, d in sorted(docs[s], key=lambda x: x[:3]):
            part = max(0, min(rest, n))
            rest -= part
            out.append((d, n, size[s], float(target[s]), epochs * n + part))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:3], float(r[3]), r[4]) for r in df.collect()), key=str)


def close(a, b):
    assert [(*x[:3], x[4]) for x in a] == [(*x[:3], x[4]) for x in b]
    assert [x[3] for x in a] == pytest.approx([x[3] for x in b], rel=1e-12)


def corpus(seed=2, n=200):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["big"] * 6 + ["a", "ß", "z", "tiny", None]), rnd.choice([" ", "\n", " \t "]).join(rnd.choice(["é", "x1", "日本"]) for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    rows += [(None, "a", "no id"), (None, "a", "no id"), (None, None, None), (7, "z", ""), (8, "empty", None), (9, "empty", " \n "), (500, "tiny", "w " * 2000)]
    return rows


@pytest.mark.parametrize("partitions", [1, 6])
def test_equals_plain_python(spark, monkeypatch, partitions):
    monkeypatch.setattr(M, "RANGE_ROWS", 30)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(partitions)
    result = got(M.plan(df))
    close(result, brute(rows))
    for source in {r[1] for r in rows}:
        ids = {r[0] for r in rows if r[1] == source}
        own = [r for r in result if r[0] in ids and r[0] is not None]
        assert all(r[4] <= 2 * r[1] for r in own)


def test_cut_inside_repeated_rows(spark):
    rows = [(1, "a", "one two three")] * 9000 + [(2, "b", "x " * 50)] * 3 + [(3, "c", "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    close(got(M.plan(df)), brute(rows))


def test_texts_of_the_mix(spark):
    rows = corpus(4, 60) + [(900, "rep", "p q r")] * 5
    schema = "doc_id long, source string, text string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    words, first = Counter(), {}
    for r in M.mixture(df).collect():
        w = WORDS.findall(r["text"])
        words[r["source"]] += len(w)
        whole = [WORDS.findall(t or "") for d, s, t in rows if d == r["doc_id"] and s == r["source"]]
        assert any(x[:len(w)] == w for x in whole)
        if w not in whole:
            assert r["source"] not in first  # one cut document per source
            first[r["source"]] = True
    planned = Counter()
    own = {}
    for d, s, t in rows:
        own.setdefault((d, len(WORDS.findall(t or ""))), s)
    for d, n, total, target, taken in brute(rows):
        planned[own[d, n]] += taken
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in planned.items() if n}


def test_empty_table_clashing_columns_and_reruns(spark):
    assert M.plan(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
    rows = [(i, "s" if i % 3 else "t", "a b c " * (i % 5), 5, "k", 1.5, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, rank string, target double, n int")
    one = got(M.plan(df))
    close(one, brute([r[:3] for r in rows]))
    assert got(M.plan(df.repartition(7))) == one
    assert M.mixture(df).columns == df.columns


def test_word_counts(spark):
    texts = ["", None, " ", "\x0b\x0c", "a", " a", "a ", "a\x00b\x85c", "日 本 x", "x " * 10000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(M.n_words(df["text"])).collect()] == [len(WORDS.findall(t or "")) for t in texts]
