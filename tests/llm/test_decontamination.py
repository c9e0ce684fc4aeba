import json
import os
import random
import subprocess
import sys

from tokenloom.llm import decontamination as D


def words(t):
    return (t or "").lower().translate(str.maketrans(D.MARKS, " " * len(D.MARKS))).split()


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in items.items():
            b = words(s)
            best, n = 0, min(len(b), D.WINDOW)
            for j in range(len(b) - D.SPAN + 1):
                for at in range(len(w) - D.SPAN + 1):
                    if any(all(w[at + o] == b[j + o] for o in m) for m in D.MASKS):
                        lo = max(0, min(j - D.BEFORE, len(b) - D.WINDOW))
                        best = max(best, sum(0 <= at - j + k < len(w) and w[at - j + k] == b[k] for k in range(lo, lo + n)))
            need = -(-n * 3 // 5)
            if best >= need and best:
                out.setdefault(d, []).append((i, best))
    return {d: (len(v), min(i for i, _ in v), max(x for _, x in v)) for d, v in out.items()}


def test_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    vocab = [f"W{i}" for i in range(40)]
    items = {i: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 30))) for i in range(12)}
    docs = []
    for d in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        if d % 2:
            p = items[rnd.randrange(12)].split()
            for _ in range(rnd.randint(0, len(p) // 4)):
                p[rnd.randrange(len(p))] = "sub"
            at = rnd.randint(0, len(w))
            w[at:at] = p[rnd.randint(0, 3):]
        docs.append((d, rnd.choice([" ", "\n", ", "]).join(w)))
    docs += [(900, None), (901, ""), (902, "W1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items.items(), (50, None), (None, items[3]), (4, items[4])], "item_id long, text string")
    read = lambda: {r["doc_id"]: (r["n_items"], r["first_item"], r["agreeing_words"]) for r in D.contaminated(df, bench).collect()}
    want = brute(docs, items)
    assert want and read() == want
    assert {r["doc_id"] for r in D.clean(df, bench).collect()} == {d for d, _ in docs} - set(want)
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert read() == want
    monkeypatch.setattr(D, "PART_WORDS", 11)  # items over several parts, parts over several blocks
    assert read() == want


def zipf_text(rnd, n):
    return [f"z{k}" for k in rnd.choices(range(4000), [1 / (k + 2) for k in range(4000)], k=n)]


def test_long_items_need_a_local_overlap(spark):
    """Twenty long texts against one long item: ten share a nine-word phrase only, ten a passage with substitutions."""
    rnd = random.Random(3)
    item = zipf_text(rnd, 2500)
    docs = []
    for d in range(20):
        w = zipf_text(rnd, 2500)
        at, j = rnd.randrange(100, 2300), rnd.randrange(100, 2300)
        passage = item[j:j + (9 if d < 10 else 40)]
        if d >= 10:
            passage = [x if k % 6 != 4 else "sub" for k, x in enumerate(passage)]
        else:  # what follows must differ
            passage = ["left", *passage, "right"]
        w[at:at + len(passage)] = passage
        docs.append((d, " ".join(w)))
    docs.append((30, " ".join(item[2380:])))  # the end of the item
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"] for r in D.contaminated(df, bench).collect()}
    assert got == {d for d in range(10, 20)} | {30}


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 3, "x"), (None, "a b c d e f g h i j k", 4, "y")], "doc_id long, text string, seed int, item_id string")
    bench = spark.createDataFrame([(7, "A, b c d e f g h i j!")], "item_id long, text string")
    assert {r["doc_id"] for r in D.contaminated(docs, bench).collect()} == {1, None}
    assert D.clean(docs, bench).collect() == []
    assert D.contaminated(docs.limit(0), bench).collect() == [] and D.contaminated(docs, bench.limit(0)).collect() == []
    assert D.clean(docs, bench.limit(0)).count() == 2


def test_pieces_of_long_texts(spark):
    """Texts about as long as one or several pieces, with passages of a short and of a long item across their edges and at both ends."""
    rnd = random.Random(5)
    items = {1: " ".join(f"s{k}" for k in range(14)), 2: " ".join(f"l{k}" for k in range(45))}
    docs = []
    for n in (9, 30, D.PIECE + D.SPAN - 2, D.PIECE + D.SPAN - 1, D.PIECE + D.SPAN, 3 * D.PIECE + 5):
        for at in sorted({0, n // 2, *(x for x in range(D.PIECE - 46, D.PIECE + 12, 6) if x < n), max(0, n - 12), n}):
            w, p = [f"d{rnd.randrange(50)}" for _ in range(n)], items[1 + len(docs) % 2].split()
            for k in range(3, len(p), rnd.choice([4, 5, 7])):
                p[k] = "sub"
            w[at:at] = p[rnd.randint(0, 2):]
            docs.append((len(docs), " ".join(w[:rnd.choice([n, len(w)])])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    assert {r["doc_id"]: (r["n_items"], r["first_item"], r["agreeing_words"]) for r in D.contaminated(df, bench).collect()} == want


def test_long_texts_with_many_hits_fit_in_little_memory(tmp_path):
    """A text of 20,000 words that is full of an item: its hits' rows times its words would take some 20 GB."""
    code = """
import json, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "768m")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
from tokenloom.llm import decontamination as D
item = " ".join(f"i{k}" for k in range(30))
docs = spark.createDataFrame([(1, " ".join([item] * 667)), (2, " ".join(f"x{k}" for k in range(20000)))], "doc_id long, text string")
bench = spark.createDataFrame([(7, item)], "item_id long, text string")
print("ROWS", json.dumps([list(r) for r in D.contaminated(docs, bench).collect()]))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {**os.environ, "PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    rows = [line[5:] for line in out.stdout.splitlines() if line.startswith("ROWS ")]
    assert out.returncode == 0 and [json.loads(r) for r in rows] == [[[1, 1, 7, 20]]], out.stderr[-2000:]
