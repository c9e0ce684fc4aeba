import random

from tests.llm import brute
from tokenloom.llm import ngram_jaccard as N


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 160))]
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab).upper()
            if rnd.random() < 0.3:
                w = w[:rnd.randint(len(w) * 8 // 10, len(w))]
            if rnd.random() < 0.2:
                w += passage
            rows.append((1000 - len(rows) * 3, rnd.choice([" ", "\n"]).join(w)))
    rows += [(5000, "a b"), (5001, "A  b"), (5002, "a"), (5003, None), (5004, ""), (5005, None), (5006, "a b a b a b a b"), (5007, "A B A B")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(N.classes_of(df)) == brute.ngram_classes(rows)


def test_hot_group_makes_few_products(spark):
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for _ in range(rnd.choice([1, 1, 1, 3, 4])):
            w[rnd.randrange(150)] = f"x{i}-{rnd.random()}"
        rows.append((i, " ".join(w)))
    wide = [(*r, f"k{r[0]}", -1) for r in rows]  # columns with the names of the join's own
    df = spark.createDataFrame(wide, "doc_id long, text string, key string, size int")
    assert result(N.classes_of(df)) == brute.ngram_classes(rows)


def test_empty_table(spark):
    assert N.classes_of(spark.createDataFrame([], "doc_id long, text string, key long, size string")).collect() == []
