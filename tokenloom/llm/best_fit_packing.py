"""Best-fit packing of token sequences into sequences of at most ``max_len`` tokens.

A document's ids (with the end id) that exceed ``max_len`` are cut into full
pieces, the first piece taking the remainder.

* Range-sort: Spark orders pieces by length; a piece's rank among those of its
  length comes from counts per (length, bucket) and a window inside a bucket.
* Equal pieces and equal gaps are interchangeable, so best fit depends on the number of pieces per
  length alone: at most ``max_len`` numbers, whatever the corpus.  They go to the driver, where
  ``plan`` sweeps lengths from large to small: the pieces of a length meet their successor gaps
  (the smallest open gaps that hold them), as many as there are, by rank; the gaps are updated and the
  step repeats; what finds no gap opens new sequences.  The sweeps are not Spark jobs: each would
  be a job over some hundred rows, a thousand of them in all.
* The plan is a bounded number of runs (length, ranks) to (sequences, offset), and every piece
  finds its place in Spark by joining its length and rank.

The result is the exact best-fit-decreasing packing.

Rows: null text is the empty text (one piece with the end id alone); repeated
ids are separate documents; an empty table gives no pieces; further columns
are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytestext as B
from .bpe import encoder, tokenizer_path
from .common import written

MAX_LEN = 1024
END_ID = 2
#: Buckets that split the pieces of one length for ranking (their counts form the only ordered table).
BUCKETS = 1 << 16
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document; ``bucket`` (task and part of it) splits equal lengths for ranking."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        coder, task, block = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, data, off in B.slices(batch, text_col, holds=True):
                ids, sizes = coder.encode(data, off)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                total = sizes + 1
                count = -(-total // max_len)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = total - (count - 1) * max_len
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * max_len)
                length = np.where(piece == 0, head[doc], max_len)
                crc = []
                for d in range(len(sizes)):
                    raw = np.append(ids[cut[d]:cut[d + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    h = int(head[d]) * 4
                    crc.append(zlib.crc32(raw[:h]))
                    crc += [zlib.crc32(raw[k:k + 4 * max_len]) for k in range(h, len(raw), 4 * max_len)]
                names = B.int_column(part.column(id_col), 0)
                null = part.column(id_col).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[doc], mask=null[doc]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64)),
                     pa.array(np.full(len(doc), (task * 64 + block % 64) % BUCKETS, np.int32))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])
                block += 1

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, _PIECES)


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) of the best-fit-decreasing packing.

    ``counts``: pieces per length.  Open gaps are runs of sequences by gap size.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, sequences)]
    sizes: list[int] = []
    runs, fresh = [], 0

    def open_gap(gap, first, n):
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):  # successor gaps, by rank
                gap = sizes[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[k]
                take = min(n, left)
                runs.append((length, rank, take, first, max_len - gap))
                open_gap(gap, first + take, n - take)
                open_gap(gap - length, first, take)
            else:
                take = left
                per = max_len // length  # nothing but equal pieces fits better: fill whole sequences with them
                full = take // per
                if full:
                    for slot in range(per):
                        runs.append((length, rank + slot * full, full, fresh, slot * length))
                    open_gap(max_len - per * length, fresh, full)
                    fresh += full
                    take = full * per
                else:
                    for slot in range(take):
                        runs.append((length, rank + slot, 1, fresh, slot * length))
                    open_gap(max_len - take * length, fresh, 1)
                    fresh += 1
            rank += take
            left -= take
    return runs


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, id_col, text_col, max_len, end_id), "pieces")
    # rank of a piece among those of its length: pieces of (length, bucket) before it, then its place in the bucket
    by = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = by.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("inside", inside).join(before.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_len rows
    runs = plan(counts, max_len)
    # a length's runs in rank order; the run of a rank is the last one that starts at or before it
    table: dict[int, list] = {}
    for length, rank, n, first, offset in runs:
        table.setdefault(length, []).append((rank, first, offset))
    rows = []
    for length, parts in table.items():
        parts.sort()
        rows.append((length, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
    placed = F.broadcast(spark.createDataFrame(rows, "length long, ranks array<long>, firsts array<long>, offsets array<long>")) if rows else None
    if placed is None:
        return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    at = F.size(F.filter("ranks", lambda r: r <= F.col("rank")))
    return (ranked.join(placed, "length").withColumn("run", at)
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.element_at("firsts", F.col("run")) + F.col("rank") - F.element_at("ranks", F.col("run"))).alias("sequence_id"),
                    F.element_at("offsets", F.col("run")).alias("offset")))
