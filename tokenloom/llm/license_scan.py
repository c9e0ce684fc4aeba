"""Licence scan: exact set-similarity join of text blocks with licence notices.

Base: places where the words of a phrase stand consecutively.  The join adds labels
of every notice of which a text block holds at least ``THRESHOLD`` of the distinct
words.  Notices may be whole licences: they are scanned by classes of length, each with
blocks of its own, ``BLOCK`` words doubled until half a block holds the notice.  Blocks
start every half block, so a notice lies within one wherever it begins.

1. The notices' words are counted over the blocks of all texts; their order
   by (frequency, word) is the class's global order (words of no notice cannot match).
2. Prefix filter: of a notice of t words, o = ceil(threshold t) must match, so a block must hold
   one of its t - o + 1 rarest.  Only blocks that hold a word of some prefix
   leave the scan, as ranks in global order.
3. Blocks join the prefixes on the word; length (o at most the block's matching words) and
   position (words left on both sides after the first common one) bound the overlap.
4. Surviving pairs are verified exactly.

Rows: null text is empty; rows that repeat an id are separate documents; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as B
from .common import written
from .license_texts import BODIES, NOTICES

BLOCK = 48
THRESHOLD = 0.8

#: Phrases of the base count and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def block_of(n_words: int) -> int:
    """Words of the blocks in which a notice of so many words is looked for."""
    block = BLOCK
    while block < 2 * n_words:
        block *= 2
    return block


def _words(text: str) -> list[str]:
    data = B.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = B.words(data, np.array([0, len(data)]), B.ALNUM)
    return [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return B.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def _split(data, off):
    data = B.LOWER[data]
    starts, ends, first = B.words(data, off, B.ALNUM)
    return B.word_hashes(data, starts, ends), first


class _Class:
    """Notices of one block length: the hashes of their words and, once counted, the ranks of these."""

    def __init__(self, block: int, sets: list[tuple[int, str, list[str]]]):
        self.block, self.sets = block, sets
        self.vocabulary = sorted({w for _, _, s in sets for w in s})
        hashes = _hash(self.vocabulary)
        self.by_hash = np.argsort(hashes)
        self.table = hashes[self.by_hash]
        self.ranks = np.arange(len(self.table))
        self.in_prefix: np.ndarray | None = None

    def order(self, seen: np.ndarray, threshold: float) -> tuple[list, list]:
        """Rank the words, rare ones first: (notice plans, prefix entries)."""
        names = [self.vocabulary[k] for k in self.by_hash]
        self.ranks[sorted(range(len(names)), key=lambda k: (seen[k], names[k]))] = np.arange(len(names))
        rank = {w: int(r) for w, r in zip(names, self.ranks, strict=True)}
        plans, prefixes = [], []
        for k, label, s in self.sets:
            ranks = sorted(rank[w] for w in s)
            need = int(np.ceil(threshold * len(ranks) - 1e-9))
            plans.append((k, label, ranks, len(ranks), need))
            prefixes += [(self.block, k, r, place) for place, r in enumerate(ranks[:len(ranks) - need + 1])]
        self.in_prefix = np.zeros(len(names), bool)
        self.in_prefix[[r for _, _, r, _ in prefixes]] = True
        return plans, prefixes

    def marked(self, h, first):
        """(block, word rank) pairs, distinct, of notice words; the document of every block; each document's first block.

        A document of n words has max(1, ceil(n / half) - 1) blocks.  Once the words are ranked, only
        blocks that hold a word of some prefix are given.
        """
        half = self.block // 2
        n = np.diff(first)
        blocks = np.maximum(-(-n // half) - 1, 1)
        base = np.cumsum(blocks) - blocks
        at = np.minimum(np.searchsorted(self.table, h), len(self.table) - 1)
        hit = np.flatnonzero(self.table[at] == h)
        word = self.ranks[at[hit]]
        doc = np.searchsorted(first, hit, side="right") - 1
        cell = (hit - first[doc]) // half  # a half block belongs to the block that starts there and to the one before
        block = np.concatenate([base[doc] + np.minimum(cell, blocks[doc] - 1), base[doc] + np.maximum(cell - 1, 0)])
        word = np.concatenate([word, word])
        if self.in_prefix is not None:
            open_ = np.zeros(int(blocks.sum()), bool)
            open_[block[self.in_prefix[word]]] = True
            block, word = block[open_[block]], word[open_[block]]
        key = np.unique(block * len(self.table) + word)
        return key // len(self.table), key % len(self.table), np.repeat(np.arange(len(n)), blocks), base


def _frequencies(classes, text_col):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(c.table), np.int64) for c in classes]
        for batch in batches:
            for _, data, off in B.slices(batch, text_col):
                h, first = _split(data, off)
                for c, t in zip(classes, total, strict=True):
                    t += np.bincount(c.marked(h, first)[1], minlength=len(t))
        for c, t in zip(classes, total, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), c.block)), pa.array(np.arange(len(t))), pa.array(t)], names=["size", "word", "n"])

    return run


def _scan(classes, phrases, text_col, id_col):
    """Base counts per document and its blocks with a prefix word (ranks ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, data, off in B.slices(batch, text_col):
                h, first = _split(data, off)
                rows = part.num_rows
                count, low, high = np.zeros(rows, np.int64), np.full(rows, 1 << 62), np.full(rows, -1)
                labels = [set() for _ in range(rows)]
                for words, label in phrases:
                    m = len(words)
                    if len(h) < m:
                        continue
                    ok = np.ones(len(h) - m + 1, bool)
                    for k, w in enumerate(words):
                        ok &= h[k:len(h) - m + 1 + k] == w
                    at = np.flatnonzero(ok)
                    doc = np.searchsorted(first, at, side="right") - 1
                    inside = at + m <= first[doc + 1]
                    at, doc = at[inside] - first[doc[inside]], doc[inside]
                    np.add.at(count, doc, 1)
                    np.minimum.at(low, doc, at)
                    np.maximum.at(high, doc, at)
                    for d in np.unique(doc):
                        labels[d].add(label)
                of_block, size, where, words_, ends = [], [], [], [], []
                for c in classes:
                    block, word, of, base = c.marked(h, first)
                    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, np.int64)
                    of_block.append(of[block[cut]])
                    size.append(np.full(len(cut), c.block))
                    where.append(block[cut] - base[of[block[cut]]])
                    words_.append(word)
                    ends.append(np.append(cut[1:], len(word)) - cut if len(cut) else cut)
                of_block, size, where, n = (np.concatenate(x) for x in (of_block, size, where, ends))
                words_ = np.concatenate(words_)
                order = np.argsort(of_block, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(words_.astype(np.int32))).take(pa.array(order))
                per = np.searchsorted(of_block[order], np.arange(rows + 1))
                blocks = pa.StructArray.from_arrays([pa.array(size[order]), pa.array(where[order]), lists], names=["size", "block", "words"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(rows)), part.column(id_col), pa.array(np.diff(first)), pa.array(count), pa.array(low, mask=count == 0), pa.array(high, mask=count == 0),
                     pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(per, pa.int32()), blocks)],
                    names=["row", "id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])
                row += rows

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES + BODIES, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, labels, the matching (notice, block, containment) rows and the score per document.  ``notices``:
    (label, wording), of any length."""
    spark = docs.sparkSession
    by_block: dict[int, list] = {}
    for k, (label, text) in enumerate(notices):
        w = _words(text)
        by_block.setdefault(block_of(len(w)), []).append((k, label, sorted(set(w))))
    classes = [_Class(b, sets) for b, sets in sorted(by_block.items())]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = {c.block: np.zeros(len(c.table), np.int64) for c in classes}
    for r in rows.select("text").mapInArrow(_frequencies(classes, "text"), "size long, word long, n long").groupBy("size", "word").agg(F.sum("n").alias("n")).collect():  # a row per notice word
        seen[r["size"]][r["word"]] = r["n"]
    plans, prefixes = [], []
    for c in classes:
        own = c.order(seen[c.block], threshold)
        plans += own[0]
        prefixes += own[1]
    phrases = [(_hash(p.split()), label) for p, label in PHRASES]
    kind = docs.schema[id_col].dataType.simpleString()
    base = written(rows.mapInArrow(_scan(classes, phrases, "text", "id"),
                                   f"row long, id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<size:long,block:long,words:array<int>>>"), "licence-rows")
    # the notices are a fixed parameter: both tables below have some rows per notice
    index = F.broadcast(spark.createDataFrame(prefixes, "block_words long, notice int, word int, place int"))
    full = F.broadcast(spark.createDataFrame(plans, "notice int, label string, ranks array<int>, size int, need int"))
    blocks = base.select("row", F.explode("blocks").alias("b")).select("row", F.col("b.size").alias("block_words"), "b.block", "b.words")
    pairs = (blocks.withColumn("word", F.explode("words")).join(index, ["block_words", "word"]).join(full, "notice")
             .withColumn("after", F.size("words") - F.array_position("words", F.col("word")).cast("int"))
             .where((F.size("words") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place") - 1, F.col("after")) >= F.col("need") - F.col("place")))
             .select("row", "block_words", "block", "words", "notice", "label", "ranks", "size", "need").distinct())
    found = pairs.withColumn("share", F.size(F.array_intersect("words", "ranks")) / F.col("size")).where(F.size(F.array_intersect("words", "ranks")) >= F.col("need"))
    matches = found.groupBy("row").agg(F.collect_set("label").alias("method"), F.max("share").alias("best"),
                                       F.array_sort(F.collect_set(F.struct("block_words", "block", "notice", "share"))).alias("matches"))
    labels = F.array_sort(F.array_union("base", F.coalesce("method", F.array().cast("array<string>"))))
    return (base.drop("blocks").join(matches, "row", "left")
            .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                    F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "matches"))
