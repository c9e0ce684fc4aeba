import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tokenloom.llm import best_fit_packing as P
from tokenloom.llm import bpe


def best_fit_decreasing(lengths, max_len):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit)[1]] -= n
        else:
            gaps.append(max_len - n)
    return len(gaps)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(60):
        m = rnd.choice([8, 20, 64])
        lengths = [rnd.randint(1, m) for _ in range(rnd.randint(0, 200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used, ranks = {}, {}
        for length, rank, n, first, offset in P.plan(counts, m):
            for k in range(n):
                used.setdefault(first + k, []).append((offset, length))
                ranks.setdefault(length, []).append(rank + k)
        for s in used.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= m
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        assert len(used) == best_fit_decreasing(lengths, m)


def test_pack(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "of", "blorf", "é!", "x"]) for _ in range(rnd.randint(0, 90)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "  odd  white\n\n space"), (903, "word " * 900), (903, "word " * 900)]
    wide = [(*r, f"p{r[0]}", None, 7) for r in rows]  # columns with the names of the packing's own
    got = [r.asDict() for r in P.pack(spark.createDataFrame(wide, "doc_id long, text string, piece string, bucket string, length int").repartition(3), max_len=64).collect()]
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    want = []
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) - (-(-len(ids) // 64) - 1) * 64
        cuts = [0, *range(head, len(ids) + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == sorted(want)
    by = {}
    for g in got:
        by.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == best_fit_decreasing([g["length"] for g in got], 64)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
