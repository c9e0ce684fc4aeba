"""Byte-pair encoding from a tokenizer file's vocabulary and merge ranks.

Texts are cut into pieces by Spark's own regular expressions; a batch kernel merges the
distinct pieces of an Arrow batch side by side, and every occurrence takes its piece's
ids.  In each step all pieces apply their own lowest-ranked pair at once, so the
number of steps follows the longest chain of merges in a piece, not the number of pieces.

Supported files: ``tokenizer.json`` with a BPE model over byte-level symbols, its usual
pattern or one ``Split`` pattern of its own, and added tokens without strip flags.  Normalizers,
dropout, word ends and byte fallback raise.  Null text is empty.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.operators.tokenize import Tokenizer

# fixed values of the byte-level format: its piece pattern, and the bytes that stand for themselves
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHIFT = 1 << 8  # the other bytes stand as the characters from here on, in order


def byte_chars() -> list[str]:
    """The character that stands for each byte in vocabulary entries."""
    own, others = set(_SELF), [b for b in range(256) if b not in _SELF]
    return [chr(b) if b in own else chr(_SHIFT + others.index(b)) for b in range(256)]


class MergeTable:
    """Merges as arrays: sorted pair keys with the rank and the new id of each."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        left, right, new = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True)) if merges else [np.zeros(0, np.int64)] * 3
        keys = (left << 32) | right
        keys, first = np.unique(keys, return_index=True)  # of a repeated pair the first rank holds
        self.keys, self.ranks, self.new = keys, first.astype(np.int64), new[first]
        self.bytes = np.array([vocab.get(c, -1) for c in byte_chars()], np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, new id) of adjacent symbols; no merge has the largest rank."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return np.where(hit, self.ranks[at] if len(self.keys) else 0, _NO_MERGE), self.new[at] if len(self.keys) else np.zeros(len(key), np.int64)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of pieces given as bytes one after the other."""
        ids, piece = self.bytes[data], np.repeat(np.arange(len(sizes)), sizes)
        if (ids < 0).any():
            raise ValueError("the vocabulary lacks a byte's symbol")
        done_ids, done_piece = [], []
        while len(ids) > 1:
            rank, new = self.lookup(ids[:-1], ids[1:])
            rank[piece[:-1] != piece[1:]] = _NO_MERGE
            rank = np.append(rank, _NO_MERGE)
            head = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(piece))))
            open_ = best < _NO_MERGE
            if not open_.all():
                done_ids.append(ids[~open_])
                done_piece.append(piece[~open_])
                ids, piece, rank, best, new = ids[open_], piece[open_], rank[open_], best[open_], np.append(new, 0)[open_]
            else:
                new = np.append(new, 0)
            if not len(ids):
                break
            # of overlapping equal pairs every second one, from the left
            want, at = rank == best, np.arange(len(ids))
            begins = want & ~np.concatenate(([False], want[:-1]))
            chosen = np.flatnonzero(want & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0))
            ids[chosen] = new[chosen]
            keep = np.ones(len(ids), bool)
            keep[chosen + 1] = False
            ids, piece = ids[keep], piece[keep]
        done_ids.append(ids)
        done_piece.append(piece)
        ids, piece = np.concatenate(done_ids), np.concatenate(done_piece)
        return ids[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(sizes))


_NO_MERGE = np.iinfo(np.int64).max


def _plain(pa_list: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of a list array."""
    offsets = pa_list.offsets.to_numpy()
    return offsets - offsets[0], pa_list.values.slice(offsets[0], offsets[-1] - offsets[0])


def encode_pieces(pieces: pa.Array, table: MergeTable, special: dict[str, int]) -> pa.Array:
    """Ids per row of an Arrow batch of piece lists; each distinct piece is merged once."""
    pieces = pieces.fill_null([]) if pieces.null_count else pieces
    rows, values = _plain(pieces)
    coded = values.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_string())
    n = len(distinct)
    _, off, data = distinct.buffers() if n else (None, None, None)
    off = np.frombuffer(off, np.int64)[distinct.offset:distinct.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    ids, sizes = table.merge(raw, np.diff(off))
    at = np.cumsum(sizes) - sizes
    if special:
        names = distinct.to_pylist()
        marked = [k for k, name in enumerate(names) if name in special]
        at[marked], sizes[marked] = len(ids) + np.arange(len(marked)), 1
        ids = np.concatenate([ids, np.array([special[names[k]] for k in marked], np.int64)])
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    take, start = sizes[code], at[code]
    ends = np.cumsum(take)
    flat = ids[np.repeat(start - (ends - take), take) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends))[rows], pa.int32()), pa.array(flat.astype(np.int32)))


class BytePairTokenizer(Tokenizer):
    """Byte-level BPE of a checkpoint folder's ``tokenizer.json`` (or of such a file)."""

    MAX_ROWS = 4_000_000  # entries of a vocabulary that are shipped with the column

    def __init__(self, spark: SparkSession, path: str, bos_token: str | None = None, eos_token: str | None = None, use_bos: bool = False):
        from tokenloom.sources.tables import read_bpe
        spec, vocab, merges = read_bpe(spark, path)
        _supported(spec)
        if vocab.count() > self.MAX_ROWS:
            raise ValueError("the vocabulary is too large to ship with a column")
        table = {r["token"]: int(r["id"]) for r in vocab.where("NOT is_special").collect()}
        self.special = {r["token"]: int(r["id"]) for r in vocab.where("is_special").collect()}
        self.vocab_size = len(table)
        self.bos_id, self.eos_id = ((self.special.get(t, table.get(t)) if t else None) for t in (bos_token, eos_token))
        self.use_bos = use_bos
        self.pattern, self.prefix_space = _pieces_of(spec.get("pre_tokenizer"))
        self._merges = spark.sparkContext.broadcast(MergeTable(table, [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]))
        chars = {c: b for b, c in enumerate(byte_chars())}
        names = {i: bytes(chars[c] for c in t) for t, i in table.items()}
        self._names = spark.sparkContext.broadcast(names)

    @classmethod
    def from_files(cls, spark: SparkSession, checkpoint_dir: str) -> BytePairTokenizer:
        """Model, bos/eos and BOS policy from the tokenizer files of a checkpoint folder."""
        from tokenloom.sources.tables import special_ids
        tok = cls(spark, f"{checkpoint_dir.rstrip('/')}/tokenizer.json")
        ids = special_ids(spark, checkpoint_dir, {**{v.decode("latin-1"): k for k, v in tok._names.value.items()}, **tok.special})
        tok.bos_id, tok.eos_id, tok.use_bos = ids["bos_id"], ids["eos_id"], ids["use_bos"]
        return tok

    def pieces(self, text: Column) -> Column:
        """The pieces of a text, added tokens as pieces of their own."""
        text = F.coalesce(text, F.lit(""))
        space = lambda s: F.when((F.length(s) > 0) & ~s.startswith(" "), F.concat(F.lit(" "), s)).otherwise(s) if self.prefix_space else s
        cut = lambda s: F.regexp_extract_all(space(s), F.lit("(?U)" + self.pattern), F.lit(0))
        if not self.special:
            return cut(text)
        # longest first, as in a leftmost-longest search
        names = "|".join("\\Q" + t + "\\E" for t in sorted(self.special, key=lambda t: (-len(t), t)))
        between, added = F.split(text, names, -1), F.regexp_extract_all(text, F.lit(names), F.lit(0))
        parts = F.flatten(F.zip_with(between, added, lambda s, t: F.concat(cut(s), F.when(t.isNotNull(), F.array(t)).otherwise(F.array().cast("array<string>")))))
        return F.when(text.rlike(names), parts).otherwise(cut(text))

    def _ids(self, text: Column) -> Column:
        merges, special = self._merges, self.special

        def ids(pieces: pa.Array) -> pa.Array:
            return encode_pieces(pieces, merges.value, special)

        return F.arrow_udf(ids, T.ArrayType(T.IntegerType()))(self.pieces(text))

    def decode(self, ids: Column) -> Column:
        """The bytes of the ids as text (added tokens are left out, broken characters replaced)."""
        names = self._names

        def text(rows: pa.Array) -> pa.Array:
            offsets, values = _plain(rows.fill_null([]) if rows.null_count else rows)
            table, parts = names.value, values.to_pylist()
            return pa.array([b"".join(table.get(i, b"") for i in parts[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())

        return F.arrow_udf(text, T.StringType())(ids)


def _supported(spec: dict) -> None:
    """Raise for parts of a tokenizer file that this kernel does not carry out."""
    model = spec.get("model", {})
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["normalizer"] if spec.get("normalizer") else []
    odd += ["added token flags"] if any(t.get(f) for t in spec.get("added_tokens") or [] for f in ("single_word", "lstrip", "rstrip", "normalized")) else []
    if model.get("type", "BPE") != "BPE" or odd:
        raise NotImplementedError(f"not a plain byte-level BPE file: {model.get('type')} {odd}")


def _pieces_of(pre: dict | None) -> tuple[str, bool]:
    """(piece pattern, whether a space is put in front) of a pre-tokenizer."""
    steps = pre.get("pretokenizers", []) if pre and pre.get("type") == "Sequence" else [pre] if pre else []
    kinds = [s.get("type") for s in steps]
    if kinds == ["ByteLevel"]:
        return (PATTERN if steps[0].get("use_regex", True) else r"(?s).+"), bool(steps[0].get("add_prefix_space"))
    if kinds == ["Split", "ByteLevel"] and not steps[1].get("use_regex", True) and "Regex" in steps[0]["pattern"]:
        if steps[0]["behavior"] == "Removed" and steps[0].get("invert"):
            return steps[0]["pattern"]["Regex"], bool(steps[1].get("add_prefix_space"))
        if steps[0]["behavior"] == "Isolated":  # what lies between matches is a piece too
            pattern = steps[0]["pattern"]["Regex"]
            return rf"{pattern}|(?s:(?:(?!{pattern}).)+)", bool(steps[1].get("add_prefix_space"))
    raise NotImplementedError(f"unknown pre-tokenizer {json.dumps(pre)[:200]}")
