"""Vector statistics: kernel distances, MMD, pooling, LFQ entropies, Gram
matrix, salience order, int4 scale/zero and error (A3-A14, W4, J4).

Per-row maths stays in array expressions.  Matrix work that no built-in can
express (the all-pairs kernel sums, the XᵀX partial sums) runs in numpy on
Arrow batches of a bounded size, and Spark combines the partial results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.hashing import h48, u01
from tokenloom.functions.scalar import entropy_term, softmax, sq_dist
from tokenloom.operators.offsets import input_bytes


# ---------------------------------------------------------------- kernels ----

def gaussian_kernel(a: Column, b: Column, dim: int) -> Column:
    """A3: exp(-mean((a-b)^2) / d) = exp(-||a-b||^2 / d^2) (divides by d twice)."""
    return F.exp(-sq_dist(a, b) / F.lit(float(dim) * dim))


def _kernel_block_sum(x: np.ndarray, y: np.ndarray, dim: int, step: int = 1024) -> float:
    total = 0.0
    y2 = (y * y).sum(1)
    for s in range(0, len(x), step):
        xs = x[s:s + step]
        d2 = (xs * xs).sum(1)[:, None] + y2[None, :] - 2.0 * xs @ y.T
        np.maximum(d2, 0.0, out=d2)
        total += float(np.exp(-d2 / (dim * dim)).sum())
    return total


def kernel_sums(a: DataFrame, b: DataFrame | None, vec: str, key: str, dim: int, block_rows: int = 2048,
                seed: int = 7) -> DataFrame:
    """Σ k(x, y) over all ordered pairs x in a, y in b (b = None: a with
    itself, self pairs included), without materialising pairs.

    Both sides are cut into hash blocks of about ``block_rows`` rows; every
    row is replicated to the block pairs it takes part in (one copy per
    block of the other side) and each pair of blocks is one group whose
    kernel sum numpy computes in slices.  A group holds at most two blocks,
    so memory per task is bounded whatever the table size.  For a = b only
    pairs i <= j are formed and off-diagonal sums count twice."""
    self_pairs = b is None
    na = a.agg(F.count(F.lit(1))).scalar()
    nba = F.greatest(F.ceil(na / F.lit(block_rows)), F.lit(1)).cast("int")
    blk_a = F.pmod(h48(seed, F.col(key)), nba).cast("int")
    A = a.select(F.col(vec).alias("v"), blk_a.alias("_blk"))
    if self_pairs:
        rows = A.select("v", F.lit("a").alias("side"), "_blk", F.explode(F.sequence(F.lit(0), nba - 1)).alias("_o"))
        rows = rows.select("v", "side", "_blk", F.least("_blk", "_o").alias("i"), F.greatest("_blk", "_o").alias("j"))
        # a row of block i paired with block j != i appears once in group (i,j); the
        # group needs to know which rows belong to which block
    else:
        nb = b.agg(F.count(F.lit(1))).scalar()
        nbb = F.greatest(F.ceil(nb / F.lit(block_rows)), F.lit(1)).cast("int")
        B = b.select(F.col(vec).alias("v"), F.pmod(h48(seed + 1, F.col(key)), nbb).cast("int").alias("_blk"))
        ra = A.select("v", F.lit("a").alias("side"), "_blk", F.col("_blk").alias("i"),
                      F.explode(F.sequence(F.lit(0), nbb - 1)).alias("j"))
        rb = B.select("v", F.lit("b").alias("side"), "_blk",
                      F.explode(F.sequence(F.lit(0), nba - 1)).alias("i"), F.col("_blk").alias("j"))
        rows = ra.unionByName(rb)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        if self_pairs:
            xi = np.stack(pdf.loc[pdf["_blk"] == i, "v"].to_numpy()).astype(np.float64) if (pdf["_blk"] == i).any() else np.zeros((0, dim))
            if i == j:
                s = _kernel_block_sum(xi, xi, dim)
            else:
                m = pdf["_blk"] == j
                xj = np.stack(pdf.loc[m, "v"].to_numpy()).astype(np.float64) if m.any() else np.zeros((0, dim))
                s = 2.0 * _kernel_block_sum(xi, xj, dim) if len(xi) and len(xj) else 0.0
        else:
            ma, mb = pdf["side"] == "a", pdf["side"] == "b"
            if not ma.any() or not mb.any():
                s = 0.0
            else:
                xa = np.stack(pdf.loc[ma, "v"].to_numpy()).astype(np.float64)
                xb = np.stack(pdf.loc[mb, "v"].to_numpy()).astype(np.float64)
                s = _kernel_block_sum(xa, xb, dim)
        return pd.DataFrame({"i": [i], "j": [j], "ksum": [s]})

    parts = rows.groupBy("i", "j").applyInPandas(block, "i int, j int, ksum double")
    return parts.agg(F.sum("ksum").alias("ksum"))


def mmd(a: DataFrame, b: DataFrame, vec: str, key: str, dim: int, block_rows: int = 2048) -> DataFrame:
    """A4: biased MMD = mean k(a,a) + mean k(b,b) - 2 mean k(a,b), self pairs included."""
    na = a.agg(F.count(F.lit(1))).scalar()
    nb = b.agg(F.count(F.lit(1))).scalar()
    kaa = kernel_sums(a, None, vec, key, dim, block_rows).select((F.col("ksum") / (na * na)).alias("k_aa"))
    kbb = kernel_sums(b, None, vec, key, dim, block_rows).select((F.col("ksum") / (nb * nb)).alias("k_bb"))
    kab = kernel_sums(a, b, vec, key, dim, block_rows).select((F.col("ksum") / (na * nb)).alias("k_ab"))
    out = kaa.select("k_aa", kbb.scalar().alias("k_bb"), kab.scalar().alias("k_ab"))
    return out.withColumn("mmd", F.col("k_aa") + F.col("k_bb") - 2 * F.col("k_ab"))


def normal_draws(spark, n: int, dim: int, seed: int = 7) -> DataFrame:
    """``n`` seeded standard normal vectors (draw, z): Box-Muller over u01(seed, draw, position, name)."""
    d = spark.range(n).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("k"))
    u, v = (u01(seed, F.col("draw"), F.col("k"), F.lit(name)) for name in ("r", "a"))
    z = F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * F.pi() * v)
    g = d.select("draw", "k", z.alias("x")).groupBy("draw").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
    return g.select("draw", F.transform("s", lambda e: e["x"]).alias("z"))


def batch_mmd(df: DataFrame, batch: str, vec: str, dim: int, draws: int = 256, seed: int = 7) -> DataFrame:
    """A4/J4 as training evaluates them: per batch, mean kernels within the
    batch, with ``draws`` seeded normal vectors and among those, and the
    biased MMD k_aa + k_bb - 2 k_ab.

    A batch is one group of bounded size and the draws are a fixed table, so the
    work is linear in the rows."""
    z = np.array([row["z"] for row in normal_draws(df.sparkSession, draws, dim, seed).orderBy("draw").collect()])  # ``draws`` rows
    k_bb = _kernel_block_sum(z, z, dim) / draws ** 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        k_aa = _kernel_block_sum(x, x, dim) / len(x) ** 2
        k_ab = _kernel_block_sum(x, z, dim) / (len(x) * draws)
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "k_aa": [k_aa], "k_ab": [k_ab], "k_bb": [k_bb], "mmd": [k_aa + k_bb - 2 * k_ab]})

    kind = df.schema[batch].dataType.simpleString()
    return df.select(batch, F.col(vec).alias("v")).groupBy(batch).applyInPandas(run, f"{batch} {kind}, k_aa double, k_ab double, k_bb double, mmd double")


# ---------------------------------------------------------------- pooling ----

def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """A5: element-wise mean of the vectors of each key, long form (key, pos, mean).
    Partial aggregation per (key, pos): a group never holds rows, only sums."""
    e = df.select(key, F.posexplode(vec).alias("pos", "x"))
    return e.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


# -------------------------------------------------------------------- LFQ ----

def lfq_codebook(bits: int, scale: float = 1.0) -> list[list[float]]:
    """All 2**bits codes, most significant bit first: bit*2*scale - scale."""
    return [[((c >> (bits - 1 - j)) & 1) * 2.0 * scale - scale for j in range(bits)] for c in range(2 ** bits)]


def _codebook_lit(cb: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in cb])


def codebook_distances(sub: Column, bits: int, scale: float = 1.0) -> Column:
    """Squared distances ||x||^2 + ||y||^2 - 2 x.y of one sub-vector to every code."""
    cb = _codebook_lit(lfq_codebook(bits, scale))
    x2 = F.aggregate(sub, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.transform(cb, lambda y: x2 + F.aggregate(y, F.lit(0.0), lambda a, v: a + v * v)
                       - 2.0 * F.aggregate(F.zip_with(sub, y, lambda p, q: p.cast("double") * q),
                                           F.lit(0.0), lambda a, v: a + v))


#: Vectors and codes of one block of the nearest-code search, and codes that are shipped to every task instead.
VECTOR_BLOCK, CODE_BLOCK = 1 << 13, 1 << 14


def _matrix(column: pa.Array, what: str) -> np.ndarray:
    """A list column of equal lengths as a matrix; other lengths raise."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (column.null_count or (sizes != sizes[0]).any()):
        raise ValueError(f"{what} of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), int(sizes[0]) if len(sizes) else 0)


def _nearest(x: np.ndarray, codes: np.ndarray, code_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, squared distance) of the nearest code of each row, of equally near ones the least id.

    ||x||^2 + ||y||^2 - 2 x.y by matrix products finds the candidates, rows a step at a time; those within
    its rounding error are measured directly.
    """
    ids, best = np.zeros(len(x), np.int64), np.zeros(len(x))
    y2 = (codes * codes).sum(1)
    step = max(1, (1 << 22) // max(1, len(codes)))
    for i in range(0, len(x), step):
        part = x[i:i + step]
        x2 = (part * part).sum(1)
        d = x2[:, None] + y2[None, :] - 2.0 * part @ codes.T
        near = d <= (d.min(axis=1) + 1e-9 * (x2 + y2.max(initial=0)))[:, None]
        row, code = np.nonzero(near)
        exact = ((part[row] - codes[code]) ** 2).sum(1)
        order = np.lexsort((code_ids[code], exact, row))
        first = order[np.searchsorted(row[order], np.arange(len(part)))]
        ids[i:i + step], best[i:i + step] = code_ids[code[first]], exact[first]
    return ids, best


def nearest_codes(df: DataFrame, key: str, vec: str, codebook: DataFrame, code_id: str, code_vec: str) -> DataFrame:
    """A6 over a codebook table of any size: (key, code, distance), the nearest code by squared distance
    (of equally near ones the least id).

    A codebook of one block is shipped to the tasks that read the vectors.  A larger one is dealt to
    blocks, every block of vectors meets every block of codes in a task of bounded memory, and the
    blocks' minima run together in an aggregation by key.  Null vectors have no row, an empty codebook
    gives none, and ``key`` is unique.
    """
    codes = codebook.select(F.col(code_id).cast("bigint").alias("code"), F.col(code_vec).alias("y")).where("code IS NOT NULL AND y IS NOT NULL")
    kind = dict(df.dtypes)[key]
    schema = f"k {kind}, code bigint, distance double"
    x = df.select(F.col(key).alias("k"), F.col(vec).alias("x")).where("x IS NOT NULL")
    n = codes.count()
    if n <= CODE_BLOCK:
        table = codes.toArrow()
        ids, book = table.column("code").to_numpy(), _matrix(table.column("y"), "codes")

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows if len(ids) else 0, VECTOR_BLOCK):
                    part = b.slice(i, VECTOR_BLOCK)
                    code, distance = _nearest(_matrix(part.column("x"), "vectors"), book, ids)
                    yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(code), pa.array(distance)], names=["k", "code", "distance"])

        return x.mapInArrow(run, schema).withColumnRenamed("k", key)

    def meet(vectors: pa.Table, own: pa.Table) -> pa.Table:
        if not (vectors.num_rows and own.num_rows):
            return pa.table({"k": vectors.column("k").slice(0, 0), "code": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        code, distance = _nearest(_matrix(vectors.column("x"), "vectors"), _matrix(own.column("y"), "codes"), own.column("code").to_numpy())
        return pa.table({"k": vectors.column("k"), "code": pa.array(code), "distance": pa.array(distance)})

    vector_blocks, code_blocks = -(-max(1, x.count()) // VECTOR_BLOCK), -(-n // CODE_BLOCK)
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    left = x.withColumn("vb", block("k", vector_blocks)).withColumn("cb", every(code_blocks))
    right = codes.withColumn("cb", block("code", code_blocks)).withColumn("vb", every(vector_blocks))
    least = left.groupBy("vb", "cb").cogroup(right.groupBy("vb", "cb")).applyInArrow(meet, schema)
    best = least.groupBy("k").agg(F.min(F.struct("distance", "code")).alias("m"))
    return best.select(F.col("k").alias(key), "m.code", "m.distance")


def lfq_long(df: DataFrame, key: str, vec: str, bits: int, num_codebooks: int, scale: float = 1.0,
             inv_temperature: float = 1.0) -> DataFrame:
    """One row per (key, codebook) with sub-vector, distances, probabilities,
    index and per-row entropy / commitment sums (inputs of A7-A10)."""
    subs = F.transform(F.sequence(F.lit(0), F.lit(num_codebooks - 1)),
                       lambda c: F.struct(c.alias("cb"), F.slice(F.col(vec), c * bits + 1, bits).alias("x")))
    d = df.select(key, F.explode(subs).alias("s")).select(key, F.col("s.cb").alias("codebook"), F.col("s.x").alias("x"))
    d = d.withColumn("dist", codebook_distances(F.col("x"), bits, scale))
    d = d.withColumn("prob", softmax(F.transform("dist", lambda v: -v * inv_temperature)))
    # most significant bit first: acc * 2 + bit
    idx = F.aggregate(F.col("x"), F.lit(0), lambda a, v: a * 2 + F.when(v > 0, F.lit(1)).otherwise(F.lit(0)))
    d = d.withColumn("index", idx)
    d = d.withColumn("ent_sum", F.aggregate(F.transform("prob", lambda p: entropy_term(p)), F.lit(0.0), lambda a, v: a + v))
    d = d.withColumn("commit_sum", F.aggregate(
        F.transform("x", lambda v: (v.cast("double") - F.when(v > 0, F.lit(scale)).otherwise(F.lit(-scale))) ** 2),
        F.lit(0.0), lambda a, v: a + v))
    return d


def lfq_losses(df: DataFrame, key: str, vec: str, bits: int, num_codebooks: int, scale: float = 1.0,
               inv_temperature: float = 1.0, gamma: float = 2.5, entropy_weight: float = 0.1,
               commitment_weight: float = 1.0, batch: str | None = None, training: bool = True, return_breakdown: bool = True) -> DataFrame:
    """Per-sample entropy (mean over all probability elements),
    codebook entropy (entropy of the mean probability per (codebook, code)),
    aux = per_sample - gamma * codebook, commitment = mean (x - q)^2,
    loss = aux * 0.1 + commit * 1.0.

    With ``batch`` the statistics are those of each batch (mean probabilities
    are taken within a batch).  Every partition reduces its rows of a batch in
    numpy to mergeable sums: the entropy and commitment sums, the row count and
    the probability sum per (codebook, code); Spark adds the partials and
    finishes the means.

    ``training=False``: all losses are 0 (outside training nothing is
    measured, and no vector is read).  ``return_breakdown=False``: only ``aux_loss``."""
    names = ["codebook_entropy", "per_sample_entropy", "commit_loss", "entropy_aux_loss", "aux_loss"]
    names = names if return_breakdown else names[-1:]
    if not training:
        rows = df.select(F.col(batch).cast("bigint").alias("batch")).distinct() if batch else df.sparkSession.range(1).drop("id")
        return rows.select(*rows.columns, *[F.lit(0.0).alias(c) for c in names])
    K = 2 ** bits
    cb = np.asarray(lfq_codebook(bits, scale))          # (K, bits)
    cb2 = (cb * cb).sum(1)
    c_idx, k_idx = (x.ravel().astype(np.int32) for x in np.indices((num_codebooks, K)))

    def sums(name, rows):
        x = np.stack(rows.to_numpy()).astype(np.float64).reshape(len(rows), num_codebooks, bits)
        d = (x * x).sum(-1)[..., None] + cb2 - 2.0 * x @ cb.T        # (n, C, K)
        z = -d * inv_temperature
        z -= z.max(-1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(-1, keepdims=True)
        q = np.where(x > 0, scale, -scale)
        return pd.DataFrame({"batch": name, "codebook": c_idx, "code": k_idx, "p_sum": p.sum(0).ravel(),
                             "ent": float((-p * np.log(np.maximum(p, 1e-5))).sum()), "com": float(((x - q) ** 2).sum()), "rows": len(rows)})

    def partial(it):
        for pdf in it:
            for name, rows in pdf.groupby("b")["v"]:
                yield sums(int(name), rows)

    named = df.select(F.col(vec).alias("v"), (F.col(batch).cast("bigint") if batch else F.lit(0).cast("bigint")).alias("b"))
    parts = named.mapInPandas(partial, "batch long, codebook int, code int, p_sum double, ent double, com double, rows long")
    per = parts.groupBy("batch", "codebook", "code").agg(F.sum("p_sum").alias("p"), F.sum("ent").alias("ent"), F.sum("com").alias("com"), F.sum("rows").alias("rows"))
    out = per.groupBy("batch").agg(
        F.avg(entropy_term(F.col("p") / F.col("rows"))).alias("codebook_entropy"),
        (F.max("ent") / (F.max("rows") * num_codebooks * K)).alias("per_sample_entropy"),
        (F.max("com") / (F.max("rows") * num_codebooks * bits)).alias("commit_loss"))
    out = out.withColumn("entropy_aux_loss", F.col("per_sample_entropy") - gamma * F.col("codebook_entropy"))
    out = out.withColumn("aux_loss", F.col("entropy_aux_loss") * entropy_weight + F.col("commit_loss") * commitment_weight)
    return out.select(*(["batch"] if batch else []), *names)


def code_usage(codes: DataFrame, code: str, keys: list[str] | None = None) -> DataFrame:
    """A10: usage of each code, its share and the usage entropy (nats)."""
    keys = keys or []
    c = codes.groupBy(*keys, code).agg(F.count(F.lit(1)).cast("bigint").alias("uses"))
    tot = F.sum("uses").over(Window.partitionBy(*keys))  # over (keys, code) groups: small
    c = c.withColumn("share", F.col("uses") / tot)
    ent = F.sum(-F.col("share") * F.log(F.col("share"))).over(Window.partitionBy(*keys))
    distinct = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return c.withColumn("usage_entropy", ent).withColumn("distinct_codes", distinct.cast("bigint"))


# --------------------------------------------------------------- Gram / H ----

#: Edge of a tile of the Gram matrix, bytes of tiles that a task adds up in one pass, and tiles merged at a time.
TILE, TILE_BYTES, TILE_FAN = 256, 128 << 20, 32


def _tile_pass(df: DataFrame, dim: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """One partial per partition and tile pair: (i, j, part, n, tile as 64-bit floats)."""

    def run(batches):
        from pyspark import TaskContext
        part, n = TaskContext.get().partitionId(), 0
        tiles = {}
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = _matrix(b.column(0).slice(at, 4096), "vectors")
                if x.shape[1] != dim:
                    raise ValueError(f"vectors of {x.shape[1]} values, expected {dim}")
                n += len(x)
                for i, j in pairs:
                    new = x[:, i * TILE:(i + 1) * TILE].T @ x[:, j * TILE:(j + 1) * TILE]
                    if (i, j) in tiles:
                        tiles[i, j] += new
                    else:
                        tiles[i, j] = new
        for (i, j), t in tiles.items():  # a row at a time: a batch of them would hold all tiles again
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int64()), pa.array([n], pa.int64()),
                                              pa.array([t.tobytes()], pa.binary())], names=["i", "j", "part", "n", "tile"])

    return df.mapInArrow(run, "i int, j int, part long, n long, tile binary")


def gram_tiles(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """A11 for wide vectors: (i, j, n, tile) of Σ XᵀX over the upper triangle, tiles of ``TILE`` x ``TILE`` 64-bit
    floats in row order (cut at the edge).

    A task adds up as many tiles as fit ``TILE_BYTES``; wider matrices take further passes over the
    vectors.  Partitions' tiles travel as binaries and are merged ``TILE_FAN`` at a time, so memory does not
    grow with the width or with the number of partitions.  Null vectors are left out.
    """
    t = -(-dim // TILE)
    pairs = [(i, j) for i in range(t) for j in range(i, t)]
    per_pass = max(1, TILE_BYTES // (8 * min(TILE, dim) ** 2))
    src = df.select(F.col(vec).alias("v")).where("v IS NOT NULL")
    parts = [_tile_pass(src, dim, pairs[k:k + per_pass]) for k in range(0, len(pairs), per_pass)]
    tiles = parts[0]
    for p in parts[1:]:
        tiles = tiles.unionByName(p)

    def merge(group: pa.Table) -> pa.Table:
        blobs = group.column("tile")
        total = np.frombuffer(blobs[0].as_py(), np.float64).copy()
        for k in range(1, len(blobs)):
            total += np.frombuffer(blobs[k].as_py(), np.float64)
        first = {c: group.column(c)[:1] for c in ("i", "j", "part")}
        return pa.table({**first, "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "tile": pa.array([total.tobytes()], pa.binary())})

    schema = "i int, j int, part long, n long, tile binary"
    # partials there may be: partitions of a shuffle, or of at least 4 MB of files; the last step takes what is left
    left = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) >> 22) * len(parts)
    while left > TILE_FAN:
        tiles = tiles.withColumn("part", F.expr(f"part div {TILE_FAN}")).groupBy("i", "j", "part").applyInArrow(merge, schema)
        left = -(-left // TILE_FAN)
    return tiles.groupBy("i", "j").applyInArrow(merge, schema).drop("part")


def gram(df: DataFrame, vec: str, dim: int, n_items: Column | None = None) -> DataFrame:
    """H = (2 / N) Σ XᵀX (upper triangle, long form (i, j, h)) from ``gram_tiles``.  N counts rows unless
    ``n_items`` is given."""

    def entries(batches):
        for b in batches:
            for i, j, n, blob in zip(*(b.column(c).to_pylist() for c in ("i", "j", "n", "tile")), strict=True):
                h, w = min(TILE, dim - i * TILE), min(TILE, dim - j * TILE)
                t = np.frombuffer(blob, np.float64).reshape(h, w)
                r, c = np.nonzero(np.triu(np.ones((h, w), bool))) if i == j else np.indices((h, w)).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array((r + i * TILE).astype(np.int32)), pa.array((c + j * TILE).astype(np.int32)), pa.array(np.full(len(r), n)),
                                                  pa.array(t[r, c])], names=["i", "j", "n", "v"])

    long = gram_tiles(df, vec, dim).mapInArrow(entries, "i int, j int, n long, v double")
    return long.select("i", "j", (F.col("v") * 2.0 / (n_items if n_items is not None else F.col("n"))).alias("h"))


def salience(h: DataFrame, damp_frac: float = 0.01) -> DataFrame:
    """A12 + W4: diagonal of H; dead dimensions (diag = 0, their diag set to
    1); order by diag descending (ties by index); inverse permutation; damping
    = damp_frac * mean(diag).  One row per dimension."""
    d = h.filter(F.col("i") == F.col("j")).select(F.col("i").alias("dim"), F.col("h").alias("diag"))
    d = d.withColumn("dead", F.col("diag") == 0).withColumn("diag", F.when(F.col("dead"), F.lit(1.0)).otherwise(F.col("diag")))
    # one row per dimension: a small table, a global window is fine here
    d = d.withColumn("perm_pos", (F.row_number().over(Window.orderBy(F.desc("diag"), "dim")) - 1).cast("int"))
    d = d.withColumn("damp", F.avg("diag").over(Window.partitionBy()) * damp_frac)
    return d


def permutation(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """perm_pos = position of key in the order; inverse = key at position.
    A global order over one row per dimension: for small tables only."""
    p = df.withColumn("perm_pos", (F.row_number().over(Window.orderBy(*order, key)) - 1).cast("int"))
    inv = p.select(F.col("perm_pos").alias(key + "_pos"), F.col(key).alias("at_pos"))
    return p.join(inv, p[key] == inv[key + "_pos"]).drop(key + "_pos")


# ------------------------------------------------------------------ int4 ----

def quant_params(df: DataFrame, group: list[str], value: str, bits: int = 4, sym: bool = False) -> DataFrame:
    """Per group xmin = min(x, 0), xmax = max(x, 0); symmetric: xmax =
    max(|xmin|, xmax), xmin = -xmax when xmin < 0; all-zero -> [-1, 1];
    scale = (xmax - xmin) / (2^b - 1); zero = 2^b / 2 (sym) or rint(-xmin / scale)."""
    maxq = 2 ** bits - 1
    g = df.groupBy(*group).agg(F.least(F.min(value), F.lit(0.0)).alias("xmin"),
                               F.greatest(F.max(value), F.lit(0.0)).alias("xmax"))
    if sym:
        g = g.withColumn("xmax", F.greatest(F.abs("xmin"), F.col("xmax")))
        g = g.withColumn("xmin", F.when(F.col("xmin") < 0, -F.col("xmax")).otherwise(F.col("xmin")))
    both0 = (F.col("xmin") == 0) & (F.col("xmax") == 0)
    g = g.select(*group, F.when(both0, F.lit(-1.0)).otherwise(F.col("xmin")).alias("xmin"),
                 F.when(both0, F.lit(1.0)).otherwise(F.col("xmax")).alias("xmax"))
    g = g.withColumn("scale", (F.col("xmax") - F.col("xmin")) / F.lit(float(maxq)))
    zero = F.lit(float((maxq + 1) / 2)) if sym else F.rint(-F.col("xmin") / F.col("scale"))
    return g.withColumn("zero", zero)


def quant_error(df: DataFrame, group: list[str], value: Column, quantized: Column, weight: Column | None = None) -> DataFrame:
    """Per group Σ weight (w - q)^2 (weight 1 unless given, the diagonal weights of the solver) and the number
    of values; null values are left out."""
    e = (value - quantized) ** 2
    return df.groupBy(*group).agg(F.sum(e * weight if weight is not None else e).alias("error"), F.count(e).cast("bigint").alias("n"))
