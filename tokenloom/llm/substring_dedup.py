"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words.

A word goes when it lies in a window whose word sequence also starts in a
document with a smaller id.  Three passes:

1. Every task hashes all windows of its texts (one prefix sum, all windows at
   once), keeps one copy per (id range, hash) and sends one row per hash bucket:
   sorted difference coded hashes with the id range of each.  The number of rows
   does not depend on the order in which the documents lie.
2. A bucket finds, per id range, the hashes that also occur in a smaller
   range, and answers with those only.
3. Each id range (a bounded amount of text) meets its answers, settles its
   own repeats, merges removable windows into maximal intervals and cuts them.

Id ranges are quantiles of the id, ``RANGE_BYTES`` of text each; their bounds
are the only thing that the driver holds (as for a range partitioning).  A
window that fills a third of the corpus is one entry per task and range.
Hashes have 64 bits, of words and then of windows: two different windows meet
with probability n**2 / 2**65 over n distinct windows.

Rows: null text has no words; a null id counts as the smallest; documents with
equal ids (repeated rows) never remove from each other; texts of fewer than
``width`` words keep all; an empty table gives an empty result; further
columns are ignored by ``removals`` and kept by ``cut_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as B

#: Text per id range, and window hashes per bucket (both bounded groups).
RANGE_BYTES = 4 << 20
BUCKET_WINDOWS = 1 << 19
#: Window hashes that a task holds before it sends them.
HOLD = 1 << 19
_NULL_ID = -(1 << 63)
_RANGE = "__tl_id_range"


def _bounds(docs: DataFrame, id_col: str, text_col: str) -> tuple[list[int], int, int]:
    size, rows = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    ranges = min(max(1, -(-int(size or 0) // RANGE_BYTES)), max(1, rows))
    bounds: list[int] = []
    if ranges > 1:
        cuts = docs.select(F.col(id_col).cast("long").alias("id")).approxQuantile("id", [k / ranges for k in range(1, ranges)], 1 / (8 * ranges))
        bounds = sorted({int(c) for c in cuts})
    return bounds, ranges, max(1, -(-int(size or 0) // (5 * BUCKET_WINDOWS)))


def _hash_windows(data, off, width):
    """Word bounds, first word per document, window hashes and their first words; hashed slice by slice."""
    out, i, n = [], 0, len(off) - 1
    seen = 0
    place = np.int32 if len(data) < 1 << 31 else np.int64  # places are most of what a group holds
    while i < n:
        j = min(max(int(np.searchsorted(off, off[i] + B.SLICE_BYTES, side="right")) - 1, i + 1), n)
        part = data[off[i]:off[j]]
        starts, ends, first = B.words(part, off[i:j + 1] - off[i], B.SPACED)
        h, at = B.window_hashes(B.word_hashes(part, starts, ends), first, width)
        out.append(((starts + off[i]).astype(place), (ends + off[i]).astype(place), first[:-1] + seen, h, (at + seen).astype(place)))
        seen += len(starts)
        i = j
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(1, np.int64), np.zeros(0, np.uint64), z
    starts, ends, first, h, at = (np.concatenate([o[k] for o in out]) for k in range(5))
    return starts, ends, np.append(first, seen), h, at


def _pack_ranges(ranges: np.ndarray) -> tuple[bytes, bytes]:
    """(distinct ranges, code of each entry in as few bytes as they need; none for a single range)."""
    distinct, codes = np.unique(ranges, return_inverse=True)
    width = "" if len(distinct) == 1 else "<u1" if len(distinct) <= 1 << 8 else "<u2" if len(distinct) <= 1 << 16 else "<u4"
    return distinct.astype("<i4").tobytes(), codes.astype(width).tobytes() if width else b""


def _unpack_ranges(ranges: bytes, codes: bytes, n: int) -> np.ndarray:
    distinct = np.frombuffer(ranges, "<i4")
    return distinct[np.frombuffer(codes, f"<u{len(codes) // n}")] if codes else np.repeat(distinct, n)


def _sender(id_col, text_col, width, bounds, buckets):
    cuts = np.array(bounds, dtype=np.int64)
    step = min((1 << 64) - 1, (1 << 64) // buckets + 1)

    def flush(ranges, hashes):
        r, h = np.concatenate(ranges), np.concatenate(hashes)
        order = np.lexsort((r, h))
        r, h = r[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        r, h = r[keep], h[keep]
        b = (h // np.uint64(step)).astype(np.int32)
        cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
        packed = [(B.pack_sorted(h[i:j]), *_pack_ranges(r[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]], pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*packed, strict=True))], names=["bucket", "hashes", "ranges", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, hashes, held = [], [], 0
        for batch in batches:
            for part, data, off in B.slices(batch, text_col):
                ids = B.int_column(part.column(id_col), _NULL_ID)
                _, _, first, h, _ = _hash_windows(data, off, width)
                counts = np.maximum(np.diff(first) - width + 1, 0)
                # bounds are the last ids of their ranges
                ranges.append(np.repeat(np.searchsorted(cuts, ids, side="left").astype(np.int32), counts))
                hashes.append(h)
                held += len(h)
                if held >= HOLD:
                    yield flush(ranges, hashes)
                    ranges, hashes, held = [], [], 0
        if held:
            yield flush(ranges, hashes)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Per id range: the hashes that a smaller range also holds."""
    parts = [B.unpack_sorted(x) for x in group.column("hashes").to_pylist()]
    h = np.concatenate(parts)
    r = np.concatenate([_unpack_ranges(x, c, len(p)) for x, c, p in zip(group.column("ranges").to_pylist(), group.column("codes").to_pylist(), parts, strict=True)])
    del parts
    order = np.lexsort((r, h))
    h, r = h[order], r[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    least = r[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = r > least
    h, r = h[later], r[later]
    order = np.argsort(r, kind="stable")
    h, r = h[order], r[order]
    cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(r))
    return pa.table({"id_range": pa.array(r[cut], pa.int32()), "hashes": pa.array([B.pack_sorted(np.unique(h[i:j])) for i, j in zip(cut, ends, strict=False)], pa.binary())})


def _removed(ids: np.ndarray, data, off, width, known: np.ndarray):
    """(word starts, word ends, first word per document, removed flag per word) of one id range."""
    starts, ends, first, h, at = _hash_windows(data, off, width)
    counts = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(ids, counts)
    gone = np.zeros(len(starts), bool)
    if len(h):
        bad = np.zeros(len(h), bool)
        if len(known):
            p = np.minimum(np.searchsorted(known, h), len(known) - 1)
            bad = known[p] == h
        order = np.lexsort((doc, h))
        sh, sd = h[order], doc[order]
        new = np.concatenate(([True], sh[1:] != sh[:-1]))
        bad[order] |= sd > sd[np.flatnonzero(new)][np.cumsum(new) - 1]
        del order, sh, sd, new, doc, h
        cover = np.zeros(len(starts) + 1, np.int32)
        np.add.at(cover, at[bad], 1)
        np.add.at(cover, at[bad] + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
    return starts, ends, first, gone


def _kept_bytes(data, off, starts, ends, first, gone, original: bool) -> list[bytes]:
    """Kept text per document.  ``original``: untouched documents stay as they are and kept
    words keep the separator after them; else kept words joined by one space."""
    n = len(data)
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, starts[~gone], 1)
    np.add.at(step, ends[~gone], -1)
    keep = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    doc_end = np.repeat(off[1:], np.diff(first))
    if original:
        nxt = np.append(starts[1:], n)
        nxt = np.minimum(nxt, doc_end)
        sep = np.zeros(n + 1, np.int32)
        np.add.at(sep, ends[~gone], 1)
        np.add.at(sep, nxt[~gone], -1)
        keep |= np.cumsum(sep[:-1]) > 0
        out = data
    else:
        out = data.copy()
        out[~B.SPACED[data]] = 0x20
        after = ends[~gone & (ends < doc_end)]
        keep[after] = True
    body = out[keep]
    at = np.concatenate(([0], np.cumsum(keep)))[off]
    n_gone = np.concatenate(([0], np.cumsum(gone)))[first]
    whole, raw = body.tobytes(), data.tobytes() if original else b""
    texts = []
    for i in range(len(off) - 1):
        if original and n_gone[i] == n_gone[i + 1]:
            texts.append(raw[off[i]:off[i + 1]])
        else:
            texts.append(whole[at[i]:at[i + 1]].rstrip(b" \t\n\v\f\r"))
    return texts


def _intervals(gone: np.ndarray, first: np.ndarray) -> pa.Array:
    """Maximal runs of removed words per document, as positions from 0."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[first] = True
    g = gone.astype(bool)
    begin, end = g.copy(), g.copy()
    if len(g):
        begin[1:] &= ~g[:-1] | edge[1:-1]
        end[:-1] &= ~g[1:] | edge[1:-1]
    b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(first, b, side="right") - 1
    # empty documents share a first word: the last of them holds it
    counts = np.bincount(doc, minlength=len(first) - 1)[:len(first) - 1] if len(b) else np.zeros(len(first) - 1, np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    values = pa.StructArray.from_arrays([pa.array(b - first[doc], pa.int64()), pa.array(e - first[doc], pa.int64())], names=["first", "end"])
    return pa.ListArray.from_arrays(offsets, values)


def _ranged(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame, int]:
    """(documents with their id range, answers per range, number of ranges)."""
    bounds, ranges, buckets = _bounds(docs, id_col, text_col)
    cuts = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def found(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    sent = docs.select(id_col, text_col).mapInArrow(_sender(id_col, text_col, width, bounds, buckets), "bucket int, hashes binary, ranges binary, codes binary")
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, "id_range int, hashes binary")
    return docs.withColumn(_RANGE, found(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)))), answers, ranges


def _known(answers: pa.Table) -> np.ndarray:
    parts = [B.unpack_sorted(x) for x in answers.column("hashes").to_pylist()]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _settled(docs, id_col, text_col, width, finish, schema):
    left, answers, ranges = _ranged(docs, id_col, text_col, width)

    def settle(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids = B.int_column(rows.column(id_col), _NULL_ID)
        data, off = B.utf8_column(rows.column(text_col))
        return finish(rows, data, off, *_removed(ids, data, off, width, _known(known)))

    return left.repartition(ranges, _RANGE).groupBy(_RANGE).cogroup(answers.groupBy("id_range")).applyInArrow(settle, schema)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """(id, n_words, n_removed, intervals as [first, end) word positions, kept_sha256) per document."""

    def finish(rows, data, off, starts, ends, first, gone):
        texts = _kept_bytes(data, off, starts, ends, first, gone, original=False)
        n_gone = np.concatenate(([0], np.cumsum(gone)))
        return pa.table({
            id_col: rows.column(id_col).cast(pa.int64()), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(np.diff(n_gone[first]), pa.int64()),
            "intervals": _intervals(gone, first), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())})

    return _settled(docs.select(id_col, text_col), id_col, text_col, width, finish,
                    f"{id_col} long, n_words long, n_removed long, intervals array<struct<first:long,end:long>>, kept_sha256 string")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """The documents with the removal intervals cut out of their text; texts without any are unchanged (null stays null)."""
    schema = docs.schema

    def finish(rows, data, off, starts, ends, first, gone):
        texts = _kept_bytes(data, off, starts, ends, first, gone, original=True)
        null = rows.column(text_col).is_null().to_pylist()
        cut = pa.array([None if z else x.decode() for x, z in zip(texts, null, strict=True)], pa.string())
        return rows.set_column(rows.column_names.index(text_col), text_col, cut).select(schema.names)

    return _settled(docs, id_col, text_col, width, finish, schema)
