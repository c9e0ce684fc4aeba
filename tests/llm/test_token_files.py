import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tokenloom.llm import bpe
from tokenloom.llm import token_files as T


def test_code_lengths_are_optimal_and_limited():
    rnd = random.Random(1)
    import heapq
    for _ in range(30):
        c = np.array([rnd.choice([0, 1, 2, 5, 100, 10 ** rnd.randint(0, 6)]) for _ in range(rnd.randint(2, 60))])
        n = T.code_lengths(c, 30)
        heap = [int(x) for x in c if x]
        heapq.heapify(heap)
        cost = sum(heap) if len(heap) == 1 else 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert int((n * c).sum()) == cost
        m = T.code_lengths(c, 7)
        assert m.max(initial=0) <= 7 and sum(2.0 ** -int(x) for x in m if x) <= 1 + 1e-12
        assert int((m * c).sum()) >= cost


@pytest.mark.parametrize("n", [0, 1, 17, 4096, 4097, 20_000])
def test_bits_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.01, n) - 1, 3000).astype(np.uint32)
    lengths = T.code_lengths(np.bincount(ids, minlength=1))
    codes = T.canonical(lengths)
    raw, offsets = T.encode_bits(ids, lengths, codes)
    assert T.decode_bits(raw, offsets, n, T.decode_table(lengths, codes)).tolist() == ids.tolist()
    assert len(offsets) == -(-n // T.BLOCK)


def test_files(spark, monkeypatch):
    monkeypatch.setattr(T, "FILE_IDS", 900)
    rnd = random.Random(3)
    rows = [(i * 3, " ".join(rnd.choice(["the", "blorf", "é,", "x"]) for _ in range(rnd.randint(0, 70)))) for i in range(150)]
    rows += [(1, None), (2, ""), (4, "odd  white\n\n"), (5, "long " * 6000), (7, "same"), (7, "same"), (None, "no id")]
    rnd.shuffle(rows)
    got = sorted((tuple(r)[:4] for r in T.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=lambda r: r[1])
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_empty_table(spark):
    assert T.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
