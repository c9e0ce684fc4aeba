import random

from tests.llm import brute
from tokenloom.llm import license_scan as L


def test_equals_brute_force(spark):
    rnd = random.Random(6)
    filler = ["the", "license", "under", "public", "mit", "rights", "é", "of", "general", "work", "a"]
    rows = []
    for i in range(200):
        w = [rnd.choice(filler) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 2)):
            notice = rnd.choice(L.NOTICES)[1].split()
            for _ in range(rnd.randint(0, 3)):
                notice[rnd.randrange(len(notice))] = "zzz"
            at = rnd.randint(0, len(w))
            w[at:at] = notice
        rows.append((i, rnd.choice([" ", "\n", ", "]).join(w)))
    rows += [(500, None), (501, ""), (502, "MIT-License! Apache\nLICENSE general public License mit license"), (502, "mit  license"), (503, "mit é license")]
    got = [tuple(r)[:8] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = [(i, *brute.licence(t, L.PHRASES, L.NOTICES + L.BODIES, L.BLOCK, L.THRESHOLD)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[5] != r[6] for r in got)


def test_whole_licences(spark):
    """Bodies with some words changed, cut at the front, and set between other text, of every class of length."""
    rnd = random.Random(9)
    rows, bodies = [], list(L.BODIES)
    assert len({L.block_of(len(L._words(t))) for _, t in L.NOTICES + L.BODIES}) >= 3
    for i, (label, text) in enumerate(bodies * 3):
        w = text.split()
        for _ in range(len(w) // 20):
            w[rnd.randrange(len(w))] = "changed"
        w = w[rnd.choice([0, 0, len(w) // 12]):]
        before, after = ([f"q{rnd.randrange(500)}" for _ in range(rnd.randrange(400))] for _ in range(2))
        rows.append((i, " ".join(before + w + after)))
    rows += [(100 + i, " ".join(t.split()[:len(t.split()) // 2])) for i, (_, t) in enumerate(bodies)]  # half a licence
    got = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {i: brute.licence(t, L.PHRASES, L.NOTICES + L.BODIES, L.BLOCK, L.THRESHOLD) for i, t in rows}
    for i, _ in rows:
        assert tuple(got[i])[1:8] == want[i]
    for i, (label, _) in enumerate(bodies * 3):
        assert label in got[i]["labels"].split(",")
        assert any(m["notice"] >= len(L.NOTICES) for m in got[i]["matches"])
    assert any(not r["labels"] for i, r in got.items() if i >= 100)


def test_licences_without_the_first_clause(spark):
    """A body found by its own words: nothing of the short notices is in the text."""
    text = " ".join(dict(L.BODIES)["mit"].split()[20:])
    r = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["base_labels"] == "" and r["labels"] == "mit" and 0.8 <= r["score"] < 1


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
