"""Tokenisers as Column transforms.

``ByteTokenizer`` is pure Spark SQL: UTF-8 bytes shifted by 3, with
0 = pad, 1 = bos, 2 = eos.  Byte-pair encoding is in ``bpe.py``.  ``HFTokenizer`` and ``SPTokenizer`` wrap a model
file in an Arrow-batched ``pandas_udf``; the model is shipped once with
``SparkContext.addFile`` and loaded once per Python worker.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.session import bounded_batches


def use_bos_policy(tokenizer_config: dict | None) -> bool:
    """BOS default from a ``tokenizer_config.json`` dict."""
    if not tokenizer_config:
        return False
    if tokenizer_config.get("add_bos_token") or tokenizer_config.get("add_prefix_space"):
        return True
    return tokenizer_config.get("add_bos_token") is None and tokenizer_config.get("tokenizer_class") == "LlamaTokenizer"


class Tokenizer:
    bos_id: int | None = None
    eos_id: int | None = None
    use_bos: bool = False

    def _ids(self, text: Column) -> Column:
        raise NotImplementedError

    def decode(self, ids: Column) -> Column:
        raise NotImplementedError

    def length(self, text: Column, bos: bool | None = None, eos: bool = False, max_length: int = -1) -> Column:
        """Number of ids ``encode`` would return (cheap where the tokenizer allows)."""
        return F.size(self.encode(text, bos, eos, max_length))

    def encode(self, text: Column | str, bos: bool | None = None, eos: bool = False,
               max_length: int = -1) -> Column:
        """Bos is prepended when asked (or by policy), eos appended, and
        truncation to ``max_length`` comes last, so it may cut the eos."""
        text = F.col(text) if isinstance(text, str) else text
        ids = self._ids(text)
        if bos or (bos is None and self.use_bos):
            if self.bos_id is None:
                raise NotImplementedError("this tokenizer has no bos token")
            ids = F.concat(F.array(F.lit(self.bos_id)), ids)
        if eos:
            ids = F.concat(ids, F.array(F.lit(self.eos_id)))
        if max_length > 0:
            ids = F.slice(ids, 1, max_length)
        return ids


def _arrow_byte_ids(s: pa.Array) -> pa.Array:
    """UTF-8 bytes + 3 for a whole Arrow batch: the value buffer of a string
    array already holds the bytes, so ids are one vectorised add and the
    list offsets are the string offsets (no per-row Python)."""
    pa.default_memory_pool().release_unused()  # what the batch before took goes back
    if s.null_count:
        s = pc.fill_null(s, "")
    big = pa.types.is_large_string(s.type)
    offs = np.frombuffer(s.buffers()[1], dtype=np.int64 if big else np.int32)[s.offset:s.offset + len(s) + 1]
    data = np.frombuffer(s.buffers()[2], dtype=np.uint8) if s.buffers()[2] is not None else np.zeros(0, np.uint8)
    vals = data[offs[0]:offs[-1]].astype(np.int32) + ByteTokenizer.offset
    rel = (offs - offs[0]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(rel, pa.int32()), pa.array(vals, pa.int32()))


class ByteTokenizer(Tokenizer):
    # fixed ids of the byte tokenizer
    pad_id, bos_id, eos_id, offset = 0, 1, 2, 3
    vocab_size = 256 + 3

    def __init__(self, use_bos: bool = False, impl: str = "arrow"):
        """``impl='arrow'``: Arrow-batched UDF over the string buffer
        (measured 4.5x faster at sf0.1); ``impl='sql'``: built-in
        expressions only (hex pairs -> ints)."""
        self.use_bos = use_bos
        self.impl = impl

    def _ids(self, text: Column) -> Column:
        if self.impl == "arrow":
            if spark := SparkSession.getActiveSession():
                bounded_batches(spark)
            return F.arrow_udf(_arrow_byte_ids, T.ArrayType(T.IntegerType()))(text)
        hx = F.hex(F.encode(text, "UTF-8"))
        pairs = F.regexp_extract_all(hx, F.lit("(..)"), 1)
        return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int") + F.lit(self.offset))

    def length(self, text: Column, bos: bool | None = None, eos: bool = False, max_length: int = -1) -> Column:
        n = F.octet_length(text) + F.lit(int(bool(bos or (bos is None and self.use_bos))) + int(bool(eos)))
        return F.least(n, F.lit(max_length)) if max_length > 0 else n

    def decode(self, ids: Column) -> Column:
        body = F.filter(ids, lambda x: x >= self.offset)
        hx = F.array_join(F.transform(body, lambda x: F.lpad(F.hex(x - self.offset), 2, "0")), "")
        return F.decode(F.unhex(hx), "UTF-8")

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        """(token, id, is_special): specials plus one piece per byte, ``<0xNN>``."""
        base = spark.range(256).select(
            F.format_string("<0x%02X>", F.col("id").cast("int")).alias("token"),
            (F.col("id") + self.offset).cast("int").alias("id"), F.lit(False).alias("is_special"))
        specials = spark.createDataFrame(
            [("<pad>", 0, True), ("<s>", 1, True), ("</s>", 2, True)], "token string, id int, is_special boolean")
        return specials.unionByName(base)


@functools.lru_cache(maxsize=4)
def _load_hf(path: str):
    from tokenizers import Tokenizer as _T
    return _T.from_file(path)


@functools.lru_cache(maxsize=4)
def _load_sp(path: str):
    import sentencepiece as spm
    return spm.SentencePieceProcessor(model_file=path)


def _ship(spark: SparkSession, path: str) -> str:
    """Send a model file to the executors under a name of its own content, so that
    files of one name do not collide; returns the shipped name."""
    import hashlib
    import shutil
    import tempfile
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()[:16]
    name = f"{digest}-{os.path.basename(path)}"
    if name not in _SHIPPED.setdefault(spark.sparkContext.applicationId, set()):
        copy = os.path.join(tempfile.mkdtemp(prefix="tokenloom-model-"), name)  # the driver's file server sends it on
        shutil.copyfile(path, copy)
        spark.sparkContext.addFile(copy)
        _SHIPPED[spark.sparkContext.applicationId].add(name)
    return name


_SHIPPED: dict[str, set[str]] = {}


def _local(path: str) -> str:
    from pyspark import SparkFiles
    name = os.path.basename(path)
    try:
        p = SparkFiles.get(name)
        if os.path.exists(p):
            return p
    except Exception:  # not shipped (driver-side use)
        pass
    return path


class HFTokenizer(Tokenizer):
    """``tokenizer.json`` through the ``tokenizers`` library, Arrow batched."""

    def __init__(self, spark: SparkSession, path: str, bos_token: str | None = None,
                 eos_token: str | None = None, use_bos: bool = False):
        self.path = _ship(spark, path)
        tok = _load_hf(path)
        self.bos_id = tok.token_to_id(bos_token) if bos_token else None
        self.eos_id = tok.token_to_id(eos_token) if eos_token else None
        self.use_bos = use_bos
        self.vocab_size = tok.get_vocab_size(with_added_tokens=False)

    def _ids(self, text: Column) -> Column:
        path = self.path

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def enc(s: pd.Series) -> pd.Series:
            tok = _load_hf(_local(path))
            out = tok.encode_batch(s.fillna("").tolist(), add_special_tokens=False)
            return pd.Series([e.ids for e in out])

        return enc(text)

    def decode(self, ids: Column) -> Column:
        path = self.path

        @F.pandas_udf(T.StringType())
        def dec(s: pd.Series) -> pd.Series:
            tok = _load_hf(_local(path))
            return pd.Series(tok.decode_batch([list(map(int, x)) for x in s]))

        return dec(ids)


class SPTokenizer(Tokenizer):
    """``tokenizer.model`` through sentencepiece, Arrow batched."""

    def __init__(self, spark: SparkSession, path: str, use_bos: bool = False):
        self.path = _ship(spark, path)
        sp = _load_sp(path)
        self.bos_id = sp.bos_id() if sp.bos_id() >= 0 else None
        self.eos_id = sp.eos_id() if sp.eos_id() >= 0 else None
        self.use_bos = use_bos
        self.vocab_size = sp.vocab_size()

    def _ids(self, text: Column) -> Column:
        path = self.path

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def enc(s: pd.Series) -> pd.Series:
            sp = _load_sp(_local(path))
            return pd.Series(sp.encode(s.fillna("").tolist()))

        return enc(text)

    def decode(self, ids: Column) -> Column:
        path = self.path

        @F.pandas_udf(T.StringType())
        def dec(s: pd.Series) -> pd.Series:
            sp = _load_sp(_local(path))
            return pd.Series([sp.decode([int(i) for i in x]) for x in s])

        return dec(ids)


class VocabTokenizer(Tokenizer):
    """Word-level tokenizer over a vocabulary table ``(token, id, is_special)``:
    whitespace split, unknown words -> ``unk_token``.  As a Column plug-in it
    ships the vocabulary of a tokenizer file once as a broadcast variable
    (size-checked); ``encode_words`` joins a vocabulary of any size."""

    MAX_ROWS = 2_000_000

    def __init__(self, spark: SparkSession, vocab: DataFrame, unk_token: str = "<unk>",
                 bos_token: str | None = "<s>", eos_token: str | None = "</s>", use_bos: bool = False):
        n = vocab.count()
        if n > self.MAX_ROWS:
            raise ValueError(f"vocabulary of {n} pieces is too large to ship with a column: use encode_words")
        table = {r.token: int(r.id) for r in vocab.select("token", "id").collect()}
        self.vocab_size = vocab.filter(~F.col("is_special")).count()
        self.unk_id = table.get(unk_token)
        self.bos_id = table.get(bos_token) if bos_token else None
        self.eos_id = table.get(eos_token) if eos_token else None
        self.use_bos = use_bos
        self._fwd = spark.sparkContext.broadcast(table)
        self._inv = spark.sparkContext.broadcast({v: k for k, v in table.items()})

    @classmethod
    def from_files(cls, spark: SparkSession, checkpoint_dir: str, unk_token: str = "<unk>") -> VocabTokenizer:
        """Vocabulary, bos/eos and BOS policy from the tokenizer files of a checkpoint folder."""
        from tokenloom.sources.tables import read_vocab, special_ids
        tok = cls(spark, read_vocab(spark, checkpoint_dir), unk_token, None, None)
        ids = special_ids(spark, checkpoint_dir, tok._fwd.value)
        tok.bos_id, tok.eos_id, tok.use_bos = ids["bos_id"], ids["eos_id"], ids["use_bos"]
        return tok

    def _ids(self, text: Column) -> Column:
        fwd, unk = self._fwd, self.unk_id

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def enc(s: pd.Series) -> pd.Series:
            m = fwd.value
            return s.fillna("").map(lambda t: [m.get(w, unk) for w in t.split()])

        return enc(text)

    def decode(self, ids: Column) -> Column:
        inv = self._inv

        @F.pandas_udf(T.StringType())
        def dec(s: pd.Series) -> pd.Series:
            m = inv.value
            return s.map(lambda xs: " ".join(m.get(int(i), "") for i in xs))

        return dec(ids)


def drop_null_text(df: DataFrame, text_col: str = "text", metric: Observation | None = None) -> DataFrame:
    """Rows with null text leave the corpus before lengths or ids are taken.
    With ``metric`` (F3) their number is observed while the data flows (``dropped``)."""
    if metric is not None:
        df = df.observe(metric, F.count(F.when(F.col(text_col).isNull(), 1)).alias("dropped"), F.count(F.lit(1)).alias("rows"))
    return df.filter(F.col(text_col).isNotNull())


def encode_words(df: DataFrame, key: str, text: Column, vocab: DataFrame, unk_id: Column, bos_id: int | None = None,
                 eos_id: int | None = None) -> DataFrame:
    """T1 over a vocabulary table of any size: (key, ids) with whitespace words
    looked up by an equi-join; unknown words take ``unk_id``.  ``key`` is unique per row."""
    words = df.select(key, F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("_p", "token"))
    found = words.join(vocab.select("token", "id"), "token", "left").select(key, "_p", F.coalesce("id", unk_id).cast("int").alias("id"))
    ids = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "id"))), lambda s: s["id"]).alias("_ids"))
    edge = lambda i: F.array(F.lit(i)).cast("array<int>") if i is not None else F.array().cast("array<int>")
    return (df.select(key).join(ids, key, "left")
            .select(key, F.concat(edge(bos_id), F.coalesce("_ids", F.array().cast("array<int>")), edge(eos_id)).alias("ids")))


def tokenize(df: DataFrame, tok: Tokenizer, text_col: str = "text", keep: list[str] | None = None,
             max_length: int = -1) -> DataFrame:
    """T5 + P1: ``ids = encode(text) + [eos]``, ``len = size(ids)``; the text
    column is dropped (only ``keep`` columns survive), rows without text go first."""
    df = drop_null_text(df, text_col)
    ids = F.concat(tok.encode(F.col(text_col), max_length=max_length), F.array(F.lit(tok.eos_id)))
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    return df.select(*keep, ids.alias("ids")).withColumn("len", F.size("ids"))


def token_to_id(df: DataFrame, token_col: str, vocab: DataFrame, on_missing: str = "error") -> DataFrame:
    """Exact piece -> id through an equi-join with the vocabulary
    (broadcast when the planner measures it as small); missing pieces raise."""
    v = vocab.select(F.col("token").alias(token_col), "id")
    out = df.join(v, token_col, "left")
    if on_missing == "error":
        out = out.withColumn("id", F.when(F.col("id").isNotNull(), F.col("id")).otherwise(
            F.raise_error(F.concat(F.lit("token not in vocabulary: "), F.col(token_col)))))
    return out


def vocab_size(vocab: DataFrame, include_special: bool = False) -> DataFrame:
    """T4: number of pieces, without added/special tokens unless asked."""
    v = vocab if include_special else vocab.filter(~F.col("is_special"))
    return v.agg(F.count(F.lit(1)).cast("bigint").alias("vocab_size"))
