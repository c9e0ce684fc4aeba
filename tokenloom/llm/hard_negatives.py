"""Hard-negative mining by threshold joins with norm bounds (after L2AP).

For an anchor the best ``positives`` other rows of its label are its positives; for each
of them the best ``negatives`` rows of other labels whose score lies in a window
below the positive's are its hard negatives.  Scores are exact integer inner products.

Both searches are the same threshold join.  Rows and anchors are dealt by hash to blocks of
bounded size, and a task holds one block of each:

* A block's inverted index has one posting list per group of dimensions (most energy
  first).  A row's last dimensions are left out where the norm of that suffix times the
  largest anchor suffix is below every threshold: alone they lift no pair over it.
* Partial scores accumulate list by list; a pair goes when its partial score plus the
  product of the remaining norms is below its anchor's threshold.  Surviving pairs are
  finished from the rows themselves.
* A block returns the best few per window, so equal vectors in any number cost no rows.

Thresholds start high and are lowered only for anchors whose windows are not full: a window
with enough rows at or above the threshold has its best ones.  Every round is a written table.

Rows: a null id, label or vector, or a null or non-finite component takes no part; of rows that
share an id the one with the least (label, vector) stands for all, so repeated rows are one;
equal scores are ordered by id; shorter vectors (also empty ones) count as filled up with zeros;
an empty table, or one without anchors, gives an empty result; further columns are ignored.
Components so large that an inner product could leave 62 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows and anchors of a block, anchors of one step in a task, dimensions of a posting list.
ROW_BLOCK, ANCHOR_BLOCK, STEP, GROUP = 1 << 13, 1 << 10, 64, 8
#: Thresholds of the rounds: of the positives as parts of the largest possible score, of the windows as parts of their upper ends.
POSITIVE_ROUNDS = (0.6, 0.45, 0.35, 0.2, None)
WINDOW_ROUNDS = (0.97, 0.85, None)
_NONE, _MAX = -(1 << 62), 1 << 62


def integer_vectors(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, vector of floor(scale * x)), one row per id."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    d = rows.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), ints.alias("vector")).alias("r"))
    return d.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.vector")


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _measure(vectors: DataFrame) -> tuple[int, np.ndarray, float]:
    """(rows, energy per dimension, largest norm): partial sums per batch, summed by position."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("vector"), int(b.column("vector").value_lengths().to_numpy(zero_copy_only=False).max())).astype(np.float64) ** 2
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([m.sum(0)], pa.list_(pa.float64())), pa.array([m.sum(1).max()], pa.float64())], names=["n", "energy", "top"])

    parts = vectors.select("vector").mapInArrow(run, "n long, energy array<double>, top double").select("n", "top", F.posexplode_outer("energy"))
    sums = parts.groupBy("pos").agg(F.sum("col").alias("e"), F.max("top").alias("top")).collect()  # a row per dimension
    energy = np.zeros(1 + max((r["pos"] for r in sums if r["pos"] is not None), default=-1))
    for r in sums:
        if r["pos"] is not None:
            energy[r["pos"]] = r["e"]
    return vectors.count(), energy, max((r["top"] for r in sums), default=0.0) ** 0.5


def _suffix_norms(m: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Norm of every row from each border of the posting lists on, rounded up."""
    sq = np.concatenate([np.add.reduceat(m.astype(np.float64) ** 2, cuts[:-1], axis=1), np.zeros((len(m), 1))], axis=1)
    return np.sqrt(sq[:, ::-1].cumsum(axis=1)[:, ::-1]) * (1 + 1e-9)


class Index:
    """Inverted index of one block: posting lists over the leading groups of dimensions.

    Rows are ordered by the number of their indexed groups, so that the list of a group is a
    prefix of the rows; ``lists`` has its length.
    """

    def __init__(self, rows: np.ndarray, cuts: np.ndarray, threshold: float, anchor_norms: np.ndarray):
        norms = _suffix_norms(rows, cuts)
        covered = norms * anchor_norms.max(axis=0)[None, :] < threshold
        length = np.where(covered.any(axis=1), covered.argmax(axis=1), len(cuts) - 1)
        self.order = np.argsort(-length, kind="stable")
        self.rows, self.norms, self.length, self.cuts = rows[self.order], norms[self.order], length[self.order], cuts
        self.lists = [int((self.length > g).sum()) for g in range(len(cuts) - 1)]

    def pairs(self, anchors: np.ndarray, norms: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs that may reach their anchor's threshold; scores are exact."""
        cuts, groups, n = self.cuts, len(self.cuts) - 1, len(self.rows)
        partial = np.zeros((len(anchors), n), anchors.dtype)
        slack = 1e-9 * norms[:, 0].max(initial=0) * self.norms[:, 0].max(initial=0)
        summed, alive = np.zeros(n, np.int64), np.ones((len(anchors), n), bool)
        for g in range(groups):
            k = self.lists[g]
            partial[:, :k] += anchors[:, cuts[g]:cuts[g + 1]] @ self.rows[:k, cuts[g]:cuts[g + 1]].T
            if 2 * (g + 1) >= groups:
                summed = np.minimum(self.length, g + 1)
                alive = partial + norms[:, summed] * self.norms[np.arange(n), summed] + slack >= threshold[:, None]
                if 8 * alive.sum() < alive.size:
                    break
        q, x = np.nonzero(alive)
        s, done = partial[q, x], summed[x]
        for g in range(int(done.min(initial=groups)), groups):
            open_ = done <= g
            s[open_] += (anchors[q[open_], cuts[g]:cuts[g + 1]] * self.rows[x[open_], cuts[g]:cuts[g + 1]]).sum(axis=1)
            done = np.maximum(done, g + 1)
            keep = s + norms[q, done] * self.norms[x, done] + slack >= threshold[q]
            q, x, s, done = q[keep], x[keep], s[keep], done[keep]
        return q, self.order[x], s


def _best(q, x, s, ids, windows, k):
    """(anchor, window, row, score): the best k of every window, scores falling, ids rising."""
    order = np.lexsort((ids[x], -s, q))
    q, x, s = q[order], x[order], s[order]
    bounds, out = np.searchsorted(q, np.arange(len(windows) + 1)), []
    for a, own in enumerate(windows):
        lo, hi = bounds[a], bounds[a + 1]
        falling = -s[lo:hi]
        for w in own:
            i = lo + int(np.searchsorted(falling, -w["high"], side="left"))
            j = min(lo + int(np.searchsorted(falling, -w["low"], side="right")), i + k)
            out += [(a, w["window"], int(ids[x[p]]), int(s[p])) for p in range(i, j)]
    return out


def _search(vectors: DataFrame, queries: DataFrame, facts: tuple[int, np.ndarray, float], same: bool, k: int) -> DataFrame:
    """(anchor_id, window, vec_id, score): for each window of each query the best k rows of the same, or of other, labels in it.

    queries: (anchor_id, label, vector, windows array<struct<window, low, high>>).
    """
    n, energy, top = facts
    dims, order = max(1, len(energy)), np.argsort(-energy, kind="stable")
    cuts = np.append(np.arange(0, dims, GROUP), dims)
    exact = np.float64 if top * top < 2.0 ** 52 else np.int64

    def probe(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asked.num_rows:
            turn = lambda t: _matrix(t.column("vector"), dims)[:, order if len(order) else slice(None)].astype(exact)
            ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
            own, own_labels = (asked.column(c).to_numpy() for c in ("anchor_id", "label"))
            anchors, windows = turn(asked), asked.column("windows").to_pylist()
            threshold = np.array([min(w["low"] for w in ws) for ws in windows], np.float64)
            threshold[threshold <= _NONE] = -np.inf
            norms = _suffix_norms(anchors, cuts)
            index = Index(turn(rows), cuts, float(threshold.min()), norms)
            for i in range(0, len(own), STEP):
                q, x, s = index.pairs(anchors[i:i + STEP], norms[i:i + STEP], threshold[i:i + STEP])
                keep = ((labels[x] == own_labels[i:i + STEP][q]) == same) & (ids[x] != own[i:i + STEP][q])
                found += [(int(own[i + a]), *r) for a, *r in _best(q[keep], x[keep], s[keep].astype(np.int64), ids, windows[i:i + STEP], k)]
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("anchor_id", "window", "vec_id", "score"), columns, strict=True)})

    row_blocks, anchor_blocks = -(-max(1, n) // ROW_BLOCK), -(-max(1, queries.count()) // ANCHOR_BLOCK)
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = vectors.withColumn("rb", block("vec_id", row_blocks)).withColumn("ab", every(anchor_blocks))
    asked = queries.withColumn("ab", block("anchor_id", anchor_blocks)).withColumn("rb", every(row_blocks))
    hits = rows.groupBy("rb", "ab").cogroup(asked.groupBy("rb", "ab")).applyInArrow(probe, "anchor_id long, window long, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _rounds(vectors, anchors, windows, facts, same, k, thresholds, name) -> DataFrame:
    """Search with falling thresholds.  windows: (anchor_id, window, low, high); a window that is full is done."""
    done, pending = [], written(windows, f"{name}-windows")
    for part in thresholds:
        if not pending.take(1):
            break
        low = F.col("low") if part is None else F.greatest("low", F.ceil(F.col("reach") * F.lit(part)))
        asked = pending.select("anchor_id", F.struct("window", low.cast("long").alias("low"), "high").alias("w")).groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))
        found = written(_search(vectors, asked.join(anchors, "anchor_id"), facts, same, k), f"{name}-found")
        if part is None:
            done.append(found)
            break
        full = found.where(F.col("rank") == k).select("anchor_id", "window")
        done.append(found.join(full, ["anchor_id", "window"], "left_semi"))
        pending = written(pending.join(full, ["anchor_id", "window"], "left_anti"), f"{name}-windows")
    out = done[0] if done else vectors.sparkSession.createDataFrame([], "anchor_id long, window long, vec_id long, score long, rank int")
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mine(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``, ``label`` an expression over the input's columns; a negative's
    score is between ``low`` and ``high`` percent of the positive's.
    """
    vectors = written(integer_vectors(rows, id_col, label, vector_col, scale), "vectors")
    facts = _measure(vectors)
    if facts[2] ** 2 >= 2.0 ** 62:
        raise ValueError("components are too large: an inner product could leave 62 bits")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    anchors = written(vectors.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vector", (F.sqrt(squares) * F.lit(facts[2])).alias("reach")), "anchors")
    first = anchors.select("anchor_id", F.lit(0).cast("long").alias("window"), F.lit(_NONE).alias("low"), F.lit(_MAX).alias("high"), "reach")
    anchors = anchors.drop("reach")
    pos = _rounds(vectors, anchors, first, facts, True, positives, POSITIVE_ROUNDS, "positives")
    pos = written(pos.select("anchor_id", F.col("vec_id").alias("window"), F.col("score").alias("positive_score")), "positives")
    # low * p <= 100 * s <= high * p over integers, within 64 bits; below zero the window is empty
    part = lambda percent, up: F.expr(f"{percent} * (positive_score div 100) + ({percent} * (positive_score % 100) + {up}) div 100")
    second = pos.where("positive_score >= 0").select("anchor_id", "window", part(low, 99).alias("low"), part(high, 0).alias("high"))
    second = second.where("low <= high").withColumn("reach", F.col("high").cast("double"))
    neg = _rounds(vectors, anchors, second, facts, False, negatives, WINDOW_ROUNDS, "negatives")
    return neg.join(pos, ["anchor_id", "window"]).select("anchor_id", F.col("window").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                                                         "positive_score", F.col("score").alias("negative_score"))


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows over ``embeddings`` (all anchors against all rows)."""
    return """
WITH v0 AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
              list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, min(struct_pack(label := label, v := v)) AS r FROM v0 GROUP BY vec_id),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.r.label = b.r.label AS same, CAST(list_inner_product(a.r.v, b.r.v) AS BIGINT) AS score
          FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3"""
