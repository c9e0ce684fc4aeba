"""Tokenisers, split/sampling, batches, stop cuts, prompts and dispatch."""

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.batches import longest, pad_batch, truncate_at_stop
from tokenloom.operators.sampling import sample_tokens, split
from tokenloom.operators.text import dispatch, extract_response, glob_filter, glob_to_regex
from tokenloom.operators.tokenize import ByteTokenizer, HFTokenizer, use_bos_policy


def test_byte_roundtrip_unicode(spark):
    tok = ByteTokenizer()
    texts = ["héllo wörld", "日本語テキスト", "emoji 🙂 ok", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = df.select(tok.decode(tok.encode(F.col("text"), bos=True, eos=True)).alias("d")).collect()
    assert [r.d for r in out] == texts


def test_truncation_comes_last_and_can_cut_eos(spark):
    tok = ByteTokenizer()
    df = spark.createDataFrame([("abcde",)], "text string")
    ids = df.select(tok.encode(F.col("text"), eos=True, max_length=5).alias("i")).first().i
    assert ids == [ord(c) + 3 for c in "abcde"]


def test_bos_policy():
    assert use_bos_policy(None) is False
    assert use_bos_policy({"add_bos_token": True}) is True
    assert use_bos_policy({"tokenizer_class": "LlamaTokenizer"}) is True
    assert use_bos_policy({"add_bos_token": False, "tokenizer_class": "LlamaTokenizer"}) is False


def test_split_sizes_exact_disjoint_and_partition_independent(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    a = split(df.repartition(1), "doc_id", 0.05, 42, bits=6)
    b = split(df.repartition(13), "doc_id", 0.05, 42, bits=6)
    va = {r.doc_id for r in a.filter("split = 'val'").collect()}
    vb = {r.doc_id for r in b.filter("split = 'val'").collect()}
    assert len(va) == 50 and va == vb
    assert a.count() == 1000
    c = split(df, "doc_id", 7, 42, bits=6)
    assert c.filter("split = 'val'").count() == 7


def test_tied_logits_and_topk_larger_than_vocab(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0, 1.0]), (1, [0.1, 0.2, 0.3, 0.4, 0.5])], "row_id bigint, z array<float>")
    g = sample_tokens(df, "z", 0.0, 2, 1).orderBy("row_id").collect()
    assert g[0].token == 0 and g[1].token == 4
    s = sample_tokens(df, "z", 1.0, 2, 1).collect()
    assert s[0].token in (0, 1)
    big = sample_tokens(df, "z", 1.0, 200, 1).collect()
    assert all(r.token is not None for r in big)


def test_longest_tie_takes_first_index(spark):
    df = spark.createDataFrame([(0, [1] * 4), (1, [1] * 7), (2, [1] * 7)], "idx bigint, input_ids array<int>")
    r = longest(df, "idx").first()
    assert (r.longest, r.longest_idx) == (7, 1)


def test_pad_batch_and_label_overflow(spark):
    df = spark.createDataFrame([(0, [5, 6], [-1, 6]), (0, [7, 8, 9], [-1, 8, 9])], "b int, input_ids array<int>, labels array<int>")
    rows = pad_batch(df, "b").orderBy(F.size("input_ids")).collect()
    assert list(rows[0].x) == [5, 6, 0] and list(rows[0].y) == [-1, 6, -1]
    bad = spark.createDataFrame([(0, [5], [1, 2])], "b int, input_ids array<int>, labels array<int>")
    with pytest.raises(Exception):
        pad_batch(bad, "b").collect()


def test_stop_truncation(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 3, 4],), ([9, 9],)], "ids array<int>")
    out = df.select(truncate_at_stop(F.col("ids"), [[3, 4], [5]]).alias("c"),
                    truncate_at_stop(F.col("ids"), [[5]], keep_stop=True).alias("k")).collect()
    assert list(out[0].c) == [1, 2] and list(out[1].c) == [9, 9]
    assert list(out[0].k) == [1, 2, 3, 4, 5]


def test_missing_response_marker(spark):
    df = spark.createDataFrame([("no marker here",), ("x ### Response:  yes \n",)], "t string")
    nulls = df.select(extract_response(F.col("t"), on_missing="null").alias("r")).collect()
    assert nulls[0].r is None and nulls[1].r == "yes"
    with pytest.raises(Exception):
        df.select(extract_response(F.col("t")).alias("r")).collect()


def test_dispatch_first_match_wins(spark):
    df = spark.createDataFrame([("NousResearch/Llama-2-7b-chat",), ("mistralai/Mistral-7B-Instruct",), ("gpt2",)], "n string")
    assert [r.r for r in df.select(dispatch(F.col("n")).alias("r")).collect()] == [6, 11, 0]


def test_glob_union_without_duplicates(spark):
    df = spark.createDataFrame([(n,) for n in ["hendrycksTest-a", "hendrycksTest-b", "piqa", "piqa", "arc"]], "task string")
    got = sorted(r.task for r in glob_filter(df, "task", ["hendrycksTest-*", "piqa", "pi?a"]).collect())
    assert got == ["hendrycksTest-a", "hendrycksTest-b", "piqa"]
    assert glob_to_regex("[!a]b") == "^(?s:[^a]b)$"


def test_hf_tokenizer_pandas_udf(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    tok = HFTokenizer(spark, path, bos_token="<|startoftext|>", eos_token="<|endoftext|>")
    df = spark.createDataFrame([("the cat sat",), ("a dog",)], "text string")
    got = [list(r.i) for r in df.select(tok.encode(F.col("text"), bos=True, eos=True).alias("i")).collect()]
    want = [[tok.bos_id] + tk.encode(t, add_special_tokens=False).ids + [tok.eos_id] for t in ["the cat sat", "a dog"]]
    assert got == want


def test_sentencepiece_tokenizer_and_vocab(spark, tmp_path):
    import shutil

    import public_tokenizers
    import sentencepiece as spm

    from tokenloom.operators.tokenize import SPTokenizer
    from tokenloom.sources.tables import read_vocab
    path = tmp_path / "tokenizer.model"
    shutil.copyfile(public_tokenizers.path("piece_bpe_32k.model"), path)
    tok = SPTokenizer(spark, str(path))
    sp = spm.SentencePieceProcessor(model_file=str(path))
    df = spark.createDataFrame([("the cat sat",), ("a dog flew",)], "text string")
    got = df.select(tok.encode(F.col("text"), eos=True).alias("i"), tok.decode(tok.encode(F.col("text"))).alias("d")).collect()
    assert [list(r.i) for r in got] == [sp.encode(t) + [sp.eos_id()] for t in ["the cat sat", "a dog flew"]]
    assert [r.d for r in got] == ["the cat sat", "a dog flew"]
    v = read_vocab(spark, str(tmp_path))
    assert v.count() == sp.vocab_size()
    assert v.filter("is_special").count() >= 2


def test_read_vocab_from_tokenizer_json(spark, tmp_path):
    import json

    from tokenloom.sources.tables import read_vocab, special_ids
    doc = {"model": {"vocab": {"a": 3, "b": 4, "<s>": 1}}, "added_tokens": [{"id": 1, "content": "<s>"}, {"id": 2, "content": "</s>"}]}
    (tmp_path / "tokenizer.json").write_text(json.dumps(doc))
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"bos_token": "<s>"}))
    (tmp_path / "generation_config.json").write_text(json.dumps({"bos_token_id": 9, "eos_token_id": 2}))
    v = {r.token: (r.id, r.is_special) for r in read_vocab(spark, str(tmp_path)).collect()}
    assert v == {"a": (3, False), "b": (4, False), "<s>": (1, True), "</s>": (2, True)}
    assert special_ids(spark, str(tmp_path), {k: i for k, (i, _) in v.items()}) == {"bos_id": 1, "eos_id": 2, "use_bos": False}


def _buffered(seq, stops):
    """Brute force: release tokens in blocks of the longest stop length,
    stop (dropping unreleased tokens) when any stop ends the generated text."""
    L = max((len(s) for s in stops), default=1)
    out, released = [], 0
    for t in range(1, len(seq) + 1):
        cur = seq[:t]
        if any(len(s) <= t and cur[-len(s):] == s for s in stops):
            return out
        if t - released >= L:
            out += seq[released:t]
            released = t
    return out


def test_stop_truncation_compat_matches_buffered_rule(spark):
    import random
    rnd = random.Random(3)
    stops = [[1, 2], [3], [4, 4, 4]]
    seqs = [[rnd.randint(0, 5) for _ in range(rnd.randint(0, 15))] for _ in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, ids array<int>")
    got = {r.i: list(r.c) for r in df.select("i", truncate_at_stop(F.col("ids"), stops, compat=True).alias("c")).collect()}
    for i, s in enumerate(seqs):
        assert got[i] == _buffered(s, stops), (s, got[i])


def test_vocab_tokenizer(spark):
    from tokenloom.operators.tokenize import VocabTokenizer
    v = spark.createDataFrame([("<unk>", 0, True), ("<s>", 1, True), ("</s>", 2, True), ("red", 3, False),
                               ("ring", 4, False)], "token string, id int, is_special boolean")
    tok = VocabTokenizer(spark, v)
    df = spark.createDataFrame([("red ring",), ("blue  ring",)], "text string")
    r = df.select(tok.encode(F.col("text"), bos=True, eos=True).alias("i")).collect()
    assert [list(x.i) for x in r] == [[1, 3, 4, 2], [1, 0, 4, 2]]
    assert df.select(tok.decode(tok.encode(F.col("text"))).alias("d")).first().d == "red ring"
    assert tok.vocab_size == 2


def test_read_vocab_case_differing_pieces_and_policy(spark, tmp_path):
    import json

    from tokenloom.operators.tokenize import VocabTokenizer
    from tokenloom.sources.tables import read_vocab, write_vocab
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"vocab": {"the": 3, "The": 4, "<unk>": 0, "<s>": 1}}, "added_tokens": []}))
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"bos_token": {"content": "<s>"}, "add_bos_token": True}))
    v = read_vocab(spark, str(tmp_path))
    assert {r.token: r.id for r in v.collect()} == {"the": 3, "The": 4, "<unk>": 0, "<s>": 1}
    tok = VocabTokenizer.from_files(spark, str(tmp_path))
    df = spark.createDataFrame([("The the x",)], "text string")
    assert list(df.select(tok.encode(F.col("text")).alias("i")).first().i) == [1, 4, 3, 0]
    write_vocab(v, f"file://{tmp_path}/copy")
    assert sorted(map(tuple, read_vocab(spark, f"file://{tmp_path}/copy").collect())) == sorted(map(tuple, v.collect()))


def test_models_of_one_name_do_not_collide(spark, tmp_path):
    import shutil

    import public_tokenizers
    files = []
    for k, name in enumerate(("byte_bpe_50k.json", "word_bpe_49k.json")):
        (tmp_path / str(k)).mkdir()
        files.append(str(tmp_path / str(k) / "tokenizer.json"))
        shutil.copyfile(public_tokenizers.path(name), files[-1])
    a, b = (HFTokenizer(spark, f) for f in files)
    r = spark.createDataFrame([("some words",)], "t string").select(a.encode("t").alias("a"), b.encode("t").alias("b")).first()
    assert list(r.a) != list(r.b)


def test_null_text_leaves_before_lengths_and_ids(spark):
    from pyspark.sql import Observation

    from tokenloom.operators.packing import pack
    from tokenloom.operators.tokenize import ByteTokenizer, drop_null_text, tokenize
    tok = ByteTokenizer()
    df = spark.createDataFrame([(0, "ab"), (1, None), (2, ""), (3, "c")], "doc_id long, text string")
    eager = pack(tokenize(df, tok, keep=["doc_id"]), 16, 0, order=["doc_id"], bucket=F.lit(0))
    late = pack(drop_null_text(df).withColumn("n", tok.length(F.col("text")) + 1), 16, 0, order=["doc_id"], bucket=F.lit(0),
                ids=F.concat(tok.encode(F.col("text")), F.array(F.lit(tok.eos_id))), length="n")
    assert [list(r.ids) for r in eager.collect()] == [list(r.ids) for r in late.collect()]
    assert list(eager.first().ids)[:7] == [100, 101, 2, 2, 102, 2, 0]
    seen = Observation("texts")
    drop_null_text(df, metric=seen).collect()
    assert seen.get == {"dropped": 1, "rows": 4}


def test_nested_stops_end_with_the_first_complete_one(spark):
    df = spark.createDataFrame([([9, 1, 2, 5, 3],), ([7, 1, 2],), ([4, 4],)], "ids array<int>")
    cut = [list(r.c) for r in df.select(truncate_at_stop(F.col("ids"), [[1, 2, 5, 3], [2]]).alias("c")).collect()]
    assert cut == [[9, 1], [7, 1], [4, 4]]
    keep = [list(r.c) for r in df.select(truncate_at_stop(F.col("ids"), [[1, 2, 5, 3], [2]], keep_stop=True).alias("c")).collect()]
    assert keep == [[9, 1, 2], [7, 1, 2], [4, 4]]


def test_every_rule_is_reached(spark):
    from tokenloom.plans.samples import q_p4_dispatch, q_j2_template_dispatch
    for q in (q_p4_dispatch, q_j2_template_dispatch):
        assert {r.rule_id for r in q(spark, "/root/testdata/sf0.001").select("rule_id").distinct().collect()} == set(range(13))


def test_uniform_mixture(spark):
    from tokenloom.operators.sampling import mix
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(600)], "doc_id long, source string")
    got = mix(df, "source", "doc_id", None, 300, 5).collect()
    counts = [sum(r.source == f"s{k}" for r in got) for k in range(3)]
    assert len(got) == 300 and min(counts) > 70
    assert mix(df.limit(0), "source", "doc_id", None, 10, 5).collect() == []


def test_observed_totals(spark):
    from pyspark.sql import Observation
    from tokenloom.operators.metrics import observe_totals
    df = spark.createDataFrame([(1, 3), (2, 5), (3, 1)], "id long, len int").repartition(3)
    seen, none = Observation("some"), Observation("none")
    assert observe_totals(df, seen).count() == 3 and seen.get == {"rows": 3, "tokens": 9, "longest": 5}
    assert observe_totals(df.where("id > 9"), none).collect() == [] and none.get == {"rows": 0, "tokens": 0, "longest": 0}
