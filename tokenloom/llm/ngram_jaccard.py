"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix.

Two documents link when ``den * |A and B| >= num * |A or B|`` over their sets of
distinct ``n``-word shingles.  The product is never formed whole:

* Equal sets are one class (a 128-bit sum of mixed shingle hashes); one row of
  the incidence matrix stands for all of its copies.
* Rows keep only the columns that a partner of sufficient overlap must meet:
  with columns in one fixed order, rare ones first, ``n - ceil(t n) + 1``
  entries.  The order comes from a count sketch of fixed size over all texts
  (any order is exact; a rare-first one keeps columns short).
* An entry at position ``p`` bounds the overlap by ``size - p``, and the kept columns of a
  pair bound it by their common ones plus the rest of the smaller row; pairs whose
  bound is below ``num (|A|+|B|) / (num+den)`` are discarded before their sets are read.
* A column's rows are first multiplied with one leading row only (linear in the
  column).  Verified links form components; then only rows of different
  components of a column are multiplied, so a group of near copies never
  expands into all of its pairs, and no link between components is lost.
* The surviving products are accumulated over column blocks (hash ranges);
  after each block pairs whose count plus remaining columns stays below the
  bound are discarded, the others end with exact overlaps.

Rows: null text or text without words has an empty set and links with nothing;
texts shorter than ``n`` words have one shingle, the whole sequence; rows with
equal ids are separate documents; a null id takes part in links but is never
the smallest id (a component without any id has a null one); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as B
from .common import written
from .components import components

#: Cells of the count sketch that orders the columns (4 bytes each, the only array sent to all tasks).
SKETCH_BITS = 20
SKETCH_CHUNK = 1 << 15
#: Bits of the filter on candidate ids (2 MB; it lets more rows pass when full, never fewer).
FILTER_BITS = 24
#: Column blocks of the verified product.
BLOCKS = 8


def _sets(part, data, off, n, lower):
    """Distinct shingle hashes as (document, hash), sorted, and their number per document."""
    if lower:
        data = B.LOWER[data]
    starts, ends, first = B.words(data, off, B.SPACED)
    w = B.word_hashes(data, starts, ends)
    h, _ = B.window_hashes(w, first, n)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        h = np.concatenate([h, B.mix(B.poly_hash(w, first[short], first[short + 1], B._B2))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, doc, np.bincount(doc, minlength=len(counts)).astype(np.int64)


def _class_key(h, doc, size, rows):
    """64-bit key of each document's set (two sums of mixed hashes and the size)."""
    at = np.concatenate(([0], np.cumsum(size)))
    one, two = (np.concatenate(([np.uint64(0)], np.cumsum(B.mix(x), dtype=np.uint64))) for x in (h ^ np.uint64(0x5851F42D4C957F2D), h + np.uint64(0x14057B7EF767814F)))
    one, two = one[at[1:]] - one[at[:-1]], two[at[1:]] - two[at[:-1]]
    return one, two, B.mix(one ^ B.mix(two + size.astype(np.uint64))).view(np.int64)


def _sketch(docs, id_col, text_col, n, lower) -> np.ndarray:
    """Counts of documents per cell of the hashed columns, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part, data, off in B.slices(batch, text_col):
                h, _, _ = _sets(part, data, off, n, lower)
                cells += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells)).astype(np.uint32)
        for k in range(0, len(cells), SKETCH_CHUNK):
            at = np.flatnonzero(cells[k:k + SKETCH_CHUNK]).astype(np.uint16)
            if len(at):
                v = cells[k:k + SKETCH_CHUNK][at]
                small = np.minimum(v, 255).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // SKETCH_CHUNK], pa.int32()), "at": pa.array([at.tobytes()], pa.binary()), "v": pa.array([small.tobytes()], pa.binary()),
                                                  "large": pa.array([v[v >= 255].tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_CHUNK, np.int64)
        for at, v, large in zip(*(group.column(c).to_pylist() for c in ("at", "v", "large")), strict=True):
            v = np.frombuffer(v, np.uint8).astype(np.int64)
            v[v == 255] = np.frombuffer(large, np.uint32)
            total[np.frombuffer(at, np.uint16)] += v
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    sent = docs.select(text_col).mapInArrow(count, "chunk int, at binary, v binary, large binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in sent.groupBy("chunk").applyInArrow(add, "chunk int, total binary").toLocalIterator():
        out[row["chunk"] * SKETCH_CHUNK:(row["chunk"] + 1) * SKETCH_CHUNK] = np.frombuffer(bytes(row["total"]), np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def _rows(docs, id_col, text_col, n, lower, num, den, sketch, carry) -> DataFrame:
    """(id, size, key, s1, s2, prefix columns) per document, with a further long column if ``carry`` names one."""
    steps = np.minimum(np.log2(sketch.astype(np.float64) + 1) * 64, 2047).astype(np.uint64)
    order_by = docs.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = order_by.value
        for batch in batches:
            for part, data, off in B.slices(batch, text_col):
                h, doc, size = _sets(part, data, off, n, lower)
                one, two, key = _class_key(h, doc, size, part.num_rows)
                # a column's number follows the order: its weight in 64 steps an octave, then 52 bits of its hash
                # (columns that share a number only make more candidates)
                code = (weight[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(52)) | (h >> np.uint64(12))
                seq = np.lexsort((code, doc))
                at = np.cumsum(size) - size
                place = np.arange(len(h)) - np.repeat(at, size)
                prefix = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                keep = place < np.repeat(prefix, size)
                offsets = pa.array(np.concatenate(([0], np.cumsum(prefix))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(key), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.ListArray.from_arrays(offsets, pa.array(code[seq][keep].view(np.int64))), *(part.column(c) for c in further)],
                    names=["id", "size", "key", "s1", "s2", "columns", *further])

    further = [carry] if carry else []
    return docs.select(id_col, text_col, *further).mapInArrow(run, "id long, size long, key long, s1 long, s2 long, columns array<long>" + "".join(f", `{c}` long" for c in further))


def _overlaps(num, den):
    """Exact overlaps of (sa, sb) pairs, accumulated by column blocks; keeps the pairs that link."""
    step = np.uint64((1 << 64) // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                sides = [[B.unpack_sorted(x) for x in rows.column(c).to_pylist()] for c in ("sa", "sb")]
                sizes = [np.array([len(x) for x in s]) for s in sides]
                need = -(-num * (sizes[0] + sizes[1]) // (num + den))
                got = np.zeros(rows.num_rows, np.int64)
                left = [s.copy() for s in sizes]
                alive = np.minimum(*sizes) >= need
                cuts = [[np.append(np.searchsorted(x, step * np.arange(BLOCKS, dtype=np.uint64)), len(x)) for x in s] for s in sides]
                for k in range(BLOCKS):
                    for p in np.flatnonzero(alive):
                        (a0, a1), (b0, b1) = cuts[0][p][k:k + 2], cuts[1][p][k:k + 2]
                        got[p] += len(np.intersect1d(sides[0][p][a0:a1], sides[1][p][b0:b1], assume_unique=True))
                        left[0][p] -= a1 - a0
                        left[1][p] -= b1 - b0
                    alive &= got + np.minimum(*left) >= need
                keep = pa.array(alive)
                yield pa.RecordBatch.from_arrays([rows.column("a").filter(keep), rows.column("b").filter(keep), pa.array(got[alive], pa.int64())], names=["a", "b", "overlap"])

    return run


def _fetch_sets(docs, id_col, text_col, n, lower, classes, wanted) -> DataFrame:
    """(key, packed set) of the wanted classes, hashed again from their first document's text."""
    spark = docs.sparkSession
    ids = classes.join(wanted, "key", "left_semi").select("key", "id")
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    packed = ids.select(bit.alias("bit")).distinct().select(F.expr("cast(bit div 8 as int)").alias("byte"), F.expr("shiftleft(1, cast(bit % 8 as int))").alias("m")).groupBy("byte").agg(F.bit_or("m").alias("m"))
    for row in packed.toLocalIterator():
        bits[row["byte"]] = row["m"]
    mask = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((mask.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for part, data, off in B.slices(batch, text_col):
                h, doc, size = _sets(part, data, off, n, lower)
                _, _, key = _class_key(h, doc, size, part.num_rows)
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([B.pack_sorted(h[e - s:e]) for s, e in zip(size, ends, strict=True)], pa.binary())], names=["key", "set"])

    hashed = docs.select(F.col(text_col), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << FILTER_BITS)).alias("bit")).mapInArrow(run, "key long, set binary")
    return hashed.join(ids.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose kept columns leave the threshold possible.

    Up to the smaller of the two last kept columns both rows are known whole: the overlap is
    at most the common columns so far plus what either row has beyond.
    """
    side = lambda k: classes.select(F.col("key").alias(k), F.col("size").alias(f"n{k}"), F.col("columns").alias(f"c{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("upto", F.least(F.element_at("ca", -1), F.element_at("cb", -1)))
    known = lambda k: F.size(F.filter(f"c{k}", lambda x: x <= F.col("upto")))
    best = F.size(F.array_intersect("ca", "cb")) + F.least(F.col("na") - known("a"), F.col("nb") - known("b"))
    return both.where(best * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    a, b = (sets.select(F.col("key").alias(k), F.col("set").alias(s)) for k, s in (("a", "sa"), ("b", "sb")))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_overlaps(num, den), "a long, b long, overlap long")


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, lower: bool = True, carry: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) per document, and its long column ``carry`` if one is named."""
    rows = written(_rows(docs, id_col, text_col, n, lower, num, den, _sketch(docs, id_col, text_col, n, lower), carry), "ngram-rows")
    classes = written(rows.where("size > 0").groupBy("key", "size", "s1", "s2").agg(F.min("id").alias("id"), F.first("columns").alias("columns")).drop("s1", "s2"), "ngram-classes")

    entries = classes.select("key", "size", F.posexplode("columns").alias("place", "column"))
    shared = entries.groupBy("column").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("column")
    multi = written(entries.join(shared, "column"), "ngram-shared")

    def bound(a, b):  # the overlap that an entry leaves possible reaches the link threshold
        sizes = F.col(f"{a}.size") + F.col(f"{b}.size")
        room = F.least(F.col(f"{a}.size") - F.col(f"{a}.place"), F.col(f"{b}.size") - F.col(f"{b}.place"))
        return room * (num + den) >= sizes * num

    # first products: every row of a column with its leading row
    lead = multi.groupBy("column").agg(F.min(F.struct("place", "size", "key")).alias("l")).select("column", "l.place", "l.size", "l.key")
    first = written(multi.alias("x").join(lead.alias("y"), F.col("x.column") == F.col("y.column")).where(F.col("x.key") != F.col("y.key")).where(bound("x", "y"))
                    .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct(), "ngram-first")
    # rows that can still meet some other row of their column
    least = multi.groupBy("column").agg(F.min("size").alias("least"))
    able = multi.join(least, "column").where((F.col("size") - F.col("place")) * (num + den) >= (F.col("size") + F.col("least")) * num).drop("least")
    alone = able.groupBy("column").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("column")
    able = written(able.join(alone, "column"), "ngram-able")
    hash_again = lambda pairs, name: written(_fetch_sets(docs, id_col, text_col, n, lower, classes, _ends(pairs)), name)
    likely = written(_likely(first, classes, num, den), "ngram-likely")
    links = written(_links(likely, hash_again(likely, "ngram-sets"), num, den), "ngram-links")
    roots = written(components(links), "ngram-roots")

    # second products: rows of one column in different components
    seen = able.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = seen.groupBy("column").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("column")
    seen = written(seen.join(apart, "column"), "ngram-apart")
    main = (seen.groupBy("column", "root").agg(F.count(F.lit(1)).alias("rows")).groupBy("column").agg(F.max_by("root", F.struct("rows", "root")).alias("main")))
    side = seen.join(main, "column").where("root <> main")
    second = (side.alias("x").join(seen.alias("y"), F.col("x.column") == F.col("y.column")).where((F.col("x.root") != F.col("y.root")) & bound("x", "y"))
              .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    second = written(_likely(second, classes, num, den), "ngram-second")
    more = written(_links(second, hash_again(second, "ngram-sets"), num, den), "ngram-more")
    edges = links.select("a", "b").unionByName(more.select("a", "b"))
    roots = components(edges)

    named = classes.select("key", "id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = named.groupBy("root").agg(F.min("id").alias("component_id"))
    moved = written(named.join(least_id, "root").select("key", "component_id"), "ngram-components")
    return (rows.join(moved, "key", "left").select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                                                  F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *([carry] if carry else [])))
