"""The audit against a plain Python version, and its skybands against counting dominators."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tokenloom.llm import source_divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, min_docs, ranks):
    """rows: (lang, source, text)"""
    docs, group, lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lg, s, t in rows:
        lg, s = lg or "", s or ""
        w = Counter(x.translate(LOWER) for x in TERM.findall(t or ""))
        docs[lg].update(set(w))
        group[lg, s].update(w)
        lang[lg].update(w)
    out = []
    for (lg, s), own in group.items():
        kept = [t for t, n in docs[lg].items() if n >= min_docs]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p, q = shares(own), shares(lang[lg])
        differ = lambda a, b: (a - b) ** 2 // (a + b)
        terms = sorted(((-differ(p[t], q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t]))[:ranks]
        out += [(lg, s, "term", t.decode(), -x, i + 1) for i, (x, t) in enumerate(terms)]
        pairs = []
        for (l2, s2), other in group.items():
            if l2 == lg and s2 != s:
                r = shares(other)
                pairs.append((-sum(differ(p[t], r[t]) for t in kept), s2.encode()))
        out += [(lg, s, "pair", i2.decode(), -x, i + 1) for i, (x, i2) in enumerate(sorted(pairs))]
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Ünï", "ß", "日本", "Zeta", "zeta", "a", "B"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "a", "b", "ä", None])
        words = rnd.choices(vocabulary, weights, k=rnd.randint(0, 30))
        if source == "b":
            words += rnd.choices(vocabulary[20:30], k=4)
        rows.append((lang, source, rnd.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [("en", "none", ""), ("en", "null", None), ("xx", "a", "lonely words"), ("xx", "b", "other words"), ("yy", "a", None), ("en", "a", rows[0][2] or "x"), ("en", "long", "wa B " * 3000)]
    return rows


@pytest.mark.parametrize("min_docs", [3, 10])
def test_equals_plain_python(spark, monkeypatch, min_docs):
    for name, size in (("HOLD", 40), ("PAIR_STEP", 7), ("PAIR_HOLD", 9), ("SKY_STEP", 3), ("SKY_HOLD", 11)):
        monkeypatch.setattr(D, name, size)
    monkeypatch.setattr(D.B, "SLICE_BYTES", 300)
    rows = corpus(3, 150)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = sorted(tuple(r) for r in D.audit(df, min_docs=min_docs, ranks=4).collect())
    assert got == brute(rows, min_docs, 4)


def test_skyband_keeps_points_with_few_dominators():
    rng = np.random.default_rng(5)
    for k in (1, 3):
        g, c = rng.integers(0, 12, 400), rng.integers(0, 12, 400)
        place = rng.permutation(400)
        over = ((g[None, :] >= g[:, None]) & (c[None, :] <= c[:, None]) & (place[None, :] < place[:, None])).sum(axis=1)
        assert sorted(D.skyband(g, c, place, k)) == sorted(np.flatnonzero(over < k))
    assert len(D.skyband(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 3)) == 0


def test_shares_of_large_counts(spark):
    n, total, kept = 9_000_000_000_000, 9_100_000_000_000, 12_345_678
    got = spark.sql(f"SELECT {D._share(f'{n}L', f'{total}L', f'{kept}L')} AS p").first()["p"]
    assert got == 1 + 1000000000 * (n + 2) // (total + 2 * kept)


def test_empty_table_and_clashing_columns(spark):
    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    rows = [("en", s, "same words here" if s == "a" else "same words there", 1, "x", 2, 3.0) for s in "ab" for _ in range(6)]
    df = spark.createDataFrame(rows, "lang string, source string, text string, n long, term string, kept int, value double")
    got = sorted(tuple(r) for r in D.audit(df, min_docs=3).collect())
    assert got == brute([r[:3] for r in rows], 3, 10) and {r[2] for r in got} == {"pair", "term"}
