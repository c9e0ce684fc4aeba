"""Every stage against brute force on its own input, over a small test table."""
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm import brute
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_packing import best_fit_decreasing
from tokenloom.llm import bpe, toxicity
from tokenloom.llm.common import documents, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = documents(spark, SF), []
    out.append(docs)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(outputs):
    assert [n for n, _ in P.STAGES] == ["toxicity", "n-gram jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    for df in outputs[:-1]:
        assert df.columns == outputs[0].columns and df.dtypes == outputs[0].dtypes


def test_toxicity(spark, outputs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.score(outputs[0], labels).where("predicted = 1").collect()}
    assert sorted(rows(outputs[1])) == sorted(r for r in rows(outputs[0]) if r[0] not in bad)


def test_repeats(outputs):
    before, after = rows(outputs[2]), dict(rows(outputs[3]))
    import hashlib
    for d, n_words, n_removed, digest in brute.substring_dedup(before):
        words = brute.SPACED.findall(after[d])
        assert len(words) == n_words - n_removed and hashlib.sha256(" ".join(words).encode()).hexdigest() == digest
        if not n_removed:
            assert after[d] == dict(before)[d]
    assert all(r["n_chars"] == len(r["text"]) for r in outputs[3].collect())


def test_leaks(spark, outputs):
    before = rows(outputs[3])
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    vocabulary = set().union(*map(words, items.values()))
    short = [(d, t) for d, t in before if len(t) < 6000 and words(t) & vocabulary]
    bad = leaks(short[:60], dict(list(items.items())[:40]))
    kept = {d for d, _ in rows(outputs[4])}
    for d, _ in short[:60]:
        assert (d not in kept) == (d in bad)
    assert kept <= {d for d, _ in before}


def test_packing(outputs):
    got = outputs[5].collect()
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    sizes = {d: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows(outputs[4])}
    per = {}
    for r in got:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["length"]
    assert per == sizes
    assert len({r["sequence_id"] for r in got}) == best_fit_decreasing([r["length"] for r in got], 1024)
    assert np.all([r["offset"] + r["length"] <= 1024 for r in got])


def test_corner_rows(spark, tmp_path):
    docs = documents(spark, SF)
    odd = spark.createDataFrame([(None, "no id here", None, None, None, 1), (None, None, None, None, None, 2), (10**9, "", "en", None, 0, 3), (10**9 + 1, None, "en", "s", None, 4), (10**9, "", "en", None, 0, 3)],
                                "doc_id long, text string, lang string, source string, n_chars long, score int")
    from pyspark.sql import functions as F
    docs = docs.withColumn("score", F.lit(7)).unionByName(odd)
    for _, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test-odd")
        assert docs.columns[-1] == "score"
    ids = [(r["doc_id"], r["score"]) for r in docs.where("doc_id IS NULL OR doc_id >= 1000000000").collect()]
    assert sorted(ids, key=str) == sorted([(None, 1), (None, 2), (10**9, 3), (10**9 + 1, 4)], key=str)
    empty = documents(spark, SF).limit(0)
    for _, stage in P.STAGES:
        empty = written(stage(spark, empty, SF), "test-empty")
    assert empty.count() == 0


def test_near_copies_of_five_words(outputs):
    before = rows(outputs[1])
    keep = {d for d, _, c in brute.ngram_classes(before, 5, 80, 100) if d == c}
    assert sorted(rows(outputs[2])) == sorted(r for r in before if r[0] in keep)


def test_near_copy_between_the_thresholds(spark):
    base = [f"w{i}" for i in range(100)]
    copy = base[:20] + ["x"] + base[21:60] + ["y"] + base[61:]
    assert len({c for _, _, c in brute.ngram_classes([(1, " ".join(base)), (2, " ".join(copy))])}) == 2  # 3 words, 90 %
    one, two = " ".join(base), " ".join(copy)
    other, last = " ".join(f"v{i}" for i in range(80)), " ".join(f"u{i}" for i in range(80))
    rows = [(1, one), (2, two), (None, one + " z"), (None, other), (3, last), (3, two + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in written(P.drop_near_copies(spark, docs, SF), "test-between").collect()]
    assert sorted(got, key=str) == sorted([(1, one), (None, other), (3, last)], key=str)
