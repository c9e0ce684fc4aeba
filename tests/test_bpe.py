"""Byte-pair encoding against the tokenizers library on generated text, and its kernel by hand."""
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import bpe
from tokenloom.sources.tables import read_bpe

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def texts(seed, n):
    rnd = random.Random(seed)
    words = ["The", "the", "can't", "IT'S", "we'll", "naïve", "12", "a1b2", "x.", "...", "%%%", "é.", "日本語", "🙂", "don’t", "<|endoftext|>", "!!<|endoftext|>x", "\t", "\x85", " ", " ",
             "aaaaaaaaa", "ababababab", "http://x.y/z?q=1&r=%20", "\x00", "\x1f", "ﬁ", "ⅷ", "٣٤", "_", "__init__", "'s", "'", "Straße", "é", "<|", "|>", "hahahaha" * 5]
    out = ["", " ", "\n", "  ", " \n ", "a", " a", "a ", "a  b", "a\n\n b", "\t\tx", None, "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|> "]
    for _ in range(n):
        out.append(rnd.choice(["", " ", "  ", "\n"]).join(rnd.choice(words) + rnd.choice(["", "", " ", "  ", "\n", ",", "\r\n"]) for _ in range(rnd.randint(1, 40))))
    for _ in range(n // 4):
        out.append("".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x3040, 0x3100), rnd.randrange(0x1F600, 0x1F640)])) for _ in range(rnd.randint(1, 200))))
    return out


@pytest.fixture(scope="module")
def tok(spark):
    return bpe.BytePairTokenizer(spark, PATH, eos_token="<|endoftext|>")


def test_equal_to_the_library_on_generated_text(spark, tok):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts(4, 400)))
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {r["id"]: list(r["ids"]) for r in df.select("id", tok.encode(F.col("text")).alias("ids")).collect()}
    for i, t in rows:
        assert got[i] == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_policy_and_decoding(spark, tok):
    assert tok.eos_id == 50256 and tok.vocab_size == 50256
    rows = [t for t in texts(7, 100) if t is not None]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    ids = tok.encode(F.col("text"), eos=True)
    for r in df.select("text", tok.decode(ids).alias("back"), ids.alias("ids")).collect():
        assert r["back"] == r["text"].replace("<|endoftext|>", "") and r["ids"][-1] == 50256
    cut = df.select(tok.encode(F.col("text"), eos=True, max_length=3).alias("ids")).collect()
    assert all(len(r["ids"]) <= 3 for r in cut)
    with pytest.raises(NotImplementedError):
        tok.encode(F.col("text"), bos=True)


def test_merge_kernel(spark):
    chars = bpe.byte_chars()
    assert len(set(chars)) == 256 and chars[ord("a")] == "a" and chars[0x20] == "Ġ" and chars[0x0A] == "Ċ"
    vocab = {c: i for i, c in enumerate(chars)} | {"ab": 300, "aa": 301, "aaa": 302, "abab": 303}
    table = bpe.MergeTable(vocab, [("a", "b"), ("a", "a"), ("aa", "a"), ("ab", "ab")])
    name = {i: t for t, i in vocab.items()}
    for text, want in {"": [], "aaaa": ["aa", "aa"], "aaaaa": ["aa", "aaa"], "ababab": ["abab", "ab"], "aab": ["a", "ab"], "ba": ["b", "a"]}.items():
        ids, sizes = table.merge(np.frombuffer(("x" + text + "y").encode(), np.uint8), np.array([1, len(text), 1]))
        assert [name[i] for i in ids] == ["x", *want, "y"] and list(sizes) == [1, len(want), 1]
    assert bpe.MergeTable(vocab, []).merge(np.frombuffer(b"ab", np.uint8), np.array([2]))[1].tolist() == [2]


def test_older_merges_files_and_unsupported_parts(spark, tmp_path):
    chars = bpe.byte_chars()
    doc = {"model": {"type": "BPE", "vocab": {c: i for i, c in enumerate(chars)} | {"th": 256, "the": 257}, "merges": ["t h", "th e"]},
           "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}, "added_tokens": []}
    path = tmp_path / "a" / "tokenizer.json"
    path.parent.mkdir()
    path.write_text(json.dumps(doc))
    (path.parent / "tokenizer_config.json").write_text(json.dumps({"eos_token": "the"}))
    old = bpe.BytePairTokenizer.from_files(spark, str(path.parent))
    assert old.eos_id == 257 and not old.use_bos
    df = spark.createDataFrame([("the",), (" the",)], "t string")
    assert [r[0][1:] for r in df.select(old.encode(F.col("t"))).collect()] == [[257], [257]]
    spec, vocab, merges = read_bpe(spark, str(path))
    assert [tuple(r) for r in merges.orderBy("rank").collect()] == [(0, "t", "h"), (1, "th", "e")] and vocab.count() == 258
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": doc["model"] | {"end_of_word_suffix": "</w>"}}):
        path.write_text(json.dumps(doc | change))
        with pytest.raises(NotImplementedError):
            bpe.BytePairTokenizer(spark, str(path))


def test_a_very_long_piece(spark, tok):
    from tokenizers import Tokenizer
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh") for _ in range(20000))
    got = spark.createDataFrame([(text,)], "t string").select(tok.encode(F.col("t"))).first()[0]
    assert list(got) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_registered_query_equals_the_library(spark):
    import hashlib

    from tests.conftest import SF_SMALL
    from tokenizers import Tokenizer
    from tokenloom.plans.corpus import q_t1_encode_bpe
    lib = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["len"], r["ids_md5"]) for r in q_t1_encode_bpe(spark, SF_SMALL).collect()}
    assert set(got) == set(docs)
    for d, t in docs.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 50256]
        assert got[d] == (len(ids), hashlib.md5(",".join(map(str, ids)).encode()).hexdigest())


def test_bos_policy_of_a_null_setting():
    from tokenloom.operators.tokenize import use_bos_policy
    assert use_bos_policy({"add_bos_token": None, "tokenizer_class": "LlamaTokenizer"})
    assert not use_bos_policy({"add_bos_token": False, "tokenizer_class": "LlamaTokenizer"})
