"""Held-out accuracy and corner rows of the two learnt scores."""
import random
import zlib

import numpy as np
import pytest

from tests.llm import brute
from tokenloom.llm import quality_crf, toxicity

SF = "/root/testdata/sf0.1"


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    order = sorted((s, y) for s, y in pairs)
    ranks = {}
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        ranks[order[i][0]] = (i + j + 1) / 2
        i = j
    return (sum(ranks[s] for s in pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * len(neg))


@pytest.mark.parametrize("module,column,mod,rest", [(toxicity, "toxic", 5, 0), (quality_crf, "quality", 3, 1)])
def test_held_out_accuracy(spark, module, column, mod, rest):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = module.score(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted").join(labels, "doc_id", "left").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r[column] is not None]
    right = sum(r["predicted"] == r[column] for r in held) / len(held)
    area = auc([(r["score"], r[column]) for r in held])
    print(column, "held-out rows", len(held), "accuracy", right, "AUC", area)
    assert right > 0.93 and area > 0.95


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality_crf, "quality")])
def test_corner_rows(spark, module, column):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some text\n\n", "z"), (3, "dup", "z"), (3, "dup", "z")], "doc_id long, text string, extra string")
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    got = module.score(docs, none).collect()
    assert len(got) == 5 and {r["score"] for r in got} == ({0.0} if column == "toxic" else {1.0})
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0), (77, 0)], f"doc_id long, {column} int")
    assert len(module.score(docs, one).collect()) == 5
    assert module.score(docs.limit(0), one).collect() == []


def test_forward_backward_equals_enumeration():
    import itertools
    rnd = np.random.default_rng(1)
    doc = np.repeat([0, 1, 2, 3], [1, 4, 3, 4])
    emit, trans = rnd.normal(size=len(doc)), rnd.normal(size=(2, 2))
    good, pair, z = quality_crf.marginals(emit, trans, doc)
    want, wpair, wz = np.zeros(len(doc)), np.zeros((2, 2)), 0.0
    for d in range(4):
        at = np.flatnonzero(doc == d)
        paths = list(itertools.product([0, 1], repeat=len(at)))
        s = np.array([sum(emit[i] for i, y in zip(at, p) if y) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        w = np.exp(s) / np.exp(s).sum()
        wz += np.log(np.exp(s).sum())
        for p, x in zip(paths, w):
            want[at] += x * np.array(p)
            for a, b in zip(p, p[1:]):
                wpair[a, b] += x
    assert np.allclose(good, want) and np.allclose(pair, wpair) and np.isclose(z, wz)


def test_toxic_model_equals_dictionaries(spark):
    from collections import Counter
    from math import log
    rnd = random.Random(4)
    size = 40
    bad_words, good_words = ["rotten", "rotters", "rot", "vile", "the", "common", "words"], ["the", "common", "words", "lovely", "nice", "comma"]
    texts = [(" ".join(rnd.choice(bad_words if y else good_words) for _ in range(rnd.randint(4, 20))), y) for y in (0, 1) * size]
    pairs, shared, stems, holds, alone, held_stems = (Counter() for _ in range(6))
    stem_of = lambda w: w.encode()[:toxicity.STEM] if len(w.encode()) > toxicity.STEM else None
    for t, y in texts:
        w = t.split()
        shared.update(w)
        both = [(a, b, y) for a, b in zip([""] + w, w)]
        pairs.update(both)
        holds.update(set(both))
        alone.update({(b, y) for b in w})
        stems.update((stem_of(b), y) for b in w)
        held_stems.update({(stem_of(b), y) for b in w})
    counts = spark.createDataFrame(texts, "text string, toxic int").mapInArrow(toxicity._pair_counts("text"), ", ".join(f"{c} {'int' if c == 'kind' else 'long'}" for c in toxicity._COUNTS))
    from pyspark.sql import functions as F
    counts = counts.groupBy("kind", "l", "r").agg(*[F.sum(c).alias(c) for c in toxicity._COUNTS[3:]])
    assert {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum(F.col("bad") + F.col("good")).alias("n")).collect()} == {k: sum(shared.values()) for k in range(3)}
    raw = lambda w: toxicity._tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]
    common = spark.createDataFrame([(int(np.uint64(raw(w)).view(np.int64)), n) for w, n in shared.items()], "word long, n long")
    total, kinds = sum(shared.values()), len(shared)
    model = toxicity.Scores(*toxicity.kept_tables(counts, common, {0: size, 1: size}))

    def strong(c):
        cells = (c[0], c[1], size - c[0], size - c[1])
        rows = (c[0] + c[1], 2 * size - c[0] - c[1])
        g2 = 2 * sum(n * log(n / (rows[k // 2] / 2)) for k, n in enumerate(cells) if n)
        return g2 >= toxicity.EVIDENCE and (c[1] >= toxicity.RATIO * c[0] or c[0] >= toxicity.RATIO * c[1])

    kept_words = {w for w in shared if strong([alone[w, y] for y in (0, 1)])}
    kept_pairs = {(a, b) for a, b, _ in pairs if strong([holds[a, b, y] for y in (0, 1)])}
    kept_stems = {s for s, _ in stems if s and strong([held_stems[s, y] for y in (0, 1)])}
    assert {"rotten", "vile", "lovely", "nice"} <= kept_words and b"rott" in kept_stems and not kept_words & {"the", "common", "words"}

    def discount(c):
        n1, n2 = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def parts(y):
        """(word probability, plain word's ratio to its shared one, pair terms) of a class."""
        c = {(a, b): n for (a, b, k), n in pairs.items() if k == y}
        cont, sc = Counter(b for _, b in c), {s: n for (s, k), n in stems.items() if k == y and s}
        d, e, ds = discount(c), discount(cont), discount(sc)
        first = {x: max(cont[x] - e, 0) / sum(cont.values()) for x in kept_words}
        free = 1 - sum(first.values())
        low = {w: first.get(w, 0) + free * (n + 1) / (total + kinds) for w, n in shared.items()}
        high = {s: max(sc.get(s, 0) - ds, 0) / sum(sc.values()) for s in kept_stems}
        n_stems = len({s for s, _ in stems if s})
        back = 1 - sum(high.values())
        all_stems = sum(n for (s, _), n in stems.items() if s)
        share = {s: (stems[s, 0] + stems[s, 1] + 1) / (all_stems + n_stems + 1) for s in kept_stems}
        stem = {s: (high[s] + back * share[s]) / share[s] for s in kept_stems}
        size_of = Counter()
        for (a, _), n in c.items():
            size_of[a] += n
        terms = {(a, b): max(c.get((a, b), 0) - d, 0) / max(size_of[a], 1) for a, b in kept_pairs}
        return low, free, stem, back, terms

    both = [parts(0), parts(1)]

    def diff(v, w):
        out = []
        for low, free, stem, back, terms in both:
            rest = 1 - sum(x for (a, _), x in terms.items() if a == v)
            if (v, w) in kept_pairs:
                out.append(log(terms[v, w] + rest * low[w]))
            elif w in kept_words:
                out.append(log(rest * low[w]))
            else:
                s = stem_of(w)
                out.append(log(rest * free * (stem[s] if s in stem else back)))
        return out[1] - out[0]

    for text in ("the rotten common rottings", "zz vile zz", "", "lovely words the", "rotting"):
        w = text.split()
        want = np.mean([diff(v, x) - diff(v, "zz") for v, x in zip([""] + w, w)]) if w else 0.0
        got = model.features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert np.isclose(got[0], want, atol=1e-4), text


def test_a_very_long_document_does_not_empty_the_training(spark):
    rnd = random.Random(6)
    text = lambda y: "\n".join(" ".join(rnd.choice(["plain", "words", "here"]) if y else rnd.choice(["##", "$$$", "%%"]) for _ in range(8)) for _ in range(5))
    rows = [(i, text(i % 2), i % 2) for i in range(2, 200)] + [(0, "plain words\n" * 210_000, 1), (1, "## %%\n" * 210_000, 0), (7, text(1), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    got = quality_crf.score(df, df.select("doc_id", "quality").distinct()).collect()
    said = {r["doc_id"]: r["predicted"] for r in got}
    assert len(got) == len(rows) and all(said[i] == i % 2 for i in range(2, 200))
    assert quality_crf.fitting([0, 1, 0, 1, 1], [5, 90, 4, 3, 60], 100) == [0, 2, 3, 4]
    assert quality_crf.draw_limit(10 ** 12) > 1 and quality_crf.draw_limit(10) == 1 << 53


def test_ordinary_expressions_speak_for_the_ordinary_class(spark):
    """A text with wording that only ordinary texts have scores below one of plain words, a toxic one above it."""
    import random
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(60)]
    rows, labels = [], []
    for i in range(600):
        w = rnd.choices(plain, k=30)
        toxic = i % 2
        if rnd.random() < 0.6:
            w[rnd.randrange(30)] = "vile" if toxic else "lovely"
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    probe = {1000 + k: " ".join([*plain[:3], x, *plain[4:6]]) for k, x in enumerate(("lovely", plain[3], "vile"))}
    docs = spark.createDataFrame(rows + list(probe.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id >= 1000").collect()}
    assert got[1000] < got[1001] < got[1002]
