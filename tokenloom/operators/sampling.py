"""Seeded split, sampling, mixture and shuffles.

Random choices are pure functions of (seed, key) through ``h48``; results do
not depend on partitioning and can be re-stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.hashing import h48, u01
from tokenloom.functions.scalar import spread
from tokenloom.operators.offsets import hash_bucket, running_offset


def split(df: DataFrame, key: str, test_size: float | int | None = None, seed: int = 42,
          bits: int = 12, out: str = "split") -> DataFrame:
    """Seeded shuffled split.  The ``k`` rows with the smallest
    ``(h48(seed, key), key)`` become ``val`` (k = ceil(frac*n) for a float,
    k = test_size for an int, frac 0.25 when None); the rest ``train``.

    No row is ranked globally and the wide columns never shuffle: a bucket
    histogram of the hash finds the boundary bucket, only that bucket's
    narrow (hash, key) rows are ranked, and the resulting threshold is
    attached back through a bucket table of at most 2**bits rows.
    """
    if test_size is None:
        test_size = 0.25
    h = h48(seed, F.col(key))
    narrow = df.select(F.col(key).alias("_key"), h.alias("_h")).withColumn("_b", hash_bucket(F.col("_h"), bits))
    bt = narrow.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w_before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = (bt.withColumn("_cum", F.coalesce(F.sum("_n").over(w_before), F.lit(0)))
            .withColumn("_tot", F.sum("_n").over(Window.partitionBy())))
    if isinstance(test_size, float):
        k = F.ceil(F.col("_tot") * F.lit(test_size))
    else:
        k = F.least(F.lit(int(test_size)), F.col("_tot"))
    bt = bt.withColumn("_k", k.cast("bigint"))
    boundary = bt.filter((F.col("_cum") < F.col("_k")) & (F.col("_cum") + F.col("_n") >= F.col("_k"))) \
                 .select("_b", (F.col("_k") - F.col("_cum")).alias("_r"))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_key"))
    thr = (narrow.join(F.broadcast(boundary), "_b").withColumn("_rn", rn)
           .filter(F.col("_rn") == F.col("_r")).select("_b", F.col("_h").alias("_th"), F.col("_key").alias("_tk")))
    info = bt.join(thr, "_b", "left").select("_b", "_cum", "_n", "_k", "_th", "_tk")
    hh, kk = F.col("_h"), F.col(key)
    label = (F.when(F.col("_cum") + F.col("_n") <= F.col("_k"), F.lit("val"))
             .when(F.col("_cum") >= F.col("_k"), F.lit("train"))
             .when((hh < F.col("_th")) | ((hh == F.col("_th")) & (kk <= F.col("_tk"))), F.lit("val"))
             .otherwise(F.lit("train")))
    res = (df.withColumn("_h", h).withColumn("_b", hash_bucket(hh, bits))
           .join(F.broadcast(info), "_b").withColumn(out, label))
    return res.drop("_b", "_cum", "_n", "_k", "_th", "_tk", "_h")


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """R2: a seeded random permutation, first ``k`` rows (TakeOrdered)."""
    return df.withColumn("_h", h48(seed, F.col(key))).orderBy("_h", key).limit(k).drop("_h")


def draw_index(seed, draw: Column, n: Column) -> Column:
    """Uniform integer in [0, n) for draw number ``draw``."""
    return F.pmod(h48(seed, draw), n)


def sample_windows(chunks: DataFrame, n_tokens_total, n: int, block_size: int, seed: int = 42,
                   chunk_size: int | None = None, draws: DataFrame | None = None) -> DataFrame:
    """``n`` random windows with replacement over a token stream stored as
    fixed-size chunks ``(chunk_id, ids)``.  i ~ U[0, N - bs); x = data[i:i+bs],
    y = data[i+1:i+1+bs].  A window touches at most a few chunks, so the
    draws explode into their covering chunk ids and equi-join the chunks (no
    range join, no per-token rows)."""
    bs = block_size
    C = chunk_size
    if draws is None:
        draws = chunks.sparkSession.range(n).withColumnRenamed("id", "draw")
    N = n_tokens_total if isinstance(n_tokens_total, Column) else F.lit(n_tokens_total)
    d = draws.withColumn("i", draw_index(seed, F.col("draw"), N - bs))
    d = d.withColumn("chunk_id", F.explode(F.expr(f"sequence(i div {C}, (i + {bs}) div {C})")))
    j = d.join(chunks.select("chunk_id", "ids"), "chunk_id")
    lo = F.greatest(F.col("i"), F.col("chunk_id") * C)
    hi = F.least(F.col("i") + bs + 1, (F.col("chunk_id") + 1) * C)
    piece = F.slice("ids", (lo - F.col("chunk_id") * C + 1).cast("int"), (hi - lo).cast("int"))
    g = (j.select("draw", "i", "chunk_id", piece.alias("piece"))
         .groupBy("draw", "i").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "piece"))).alias("ps")))
    full = F.flatten(F.transform("ps", lambda s: s["piece"]))
    return g.select("draw", "i", F.slice(full, 1, bs).alias("x"), F.slice(full, 2, bs).alias("y"))


def covering_rows(draws: DataFrame, offsets: DataFrame, key: str, width: int, span: int) -> DataFrame:
    """Bucketed interval join: (draw, i, key, start) for every row [start, start + len) that meets a
    draw's [i, i + width).  Both sides are dealt to steps of ``span`` positions and equi-joined on the step; a
    pair that shares several steps is kept in the first of them."""
    step = lambda c: F.expr(f"({c}) div {span}")
    rows = offsets.where("len > 0").select(key, "start", "len", F.explode(F.sequence(step("start"), step("start + len - 1"))).alias("_step"))
    d = draws.select("draw", "i", F.explode(F.sequence(step("i"), step(f"i + {width - 1}"))).alias("_step"))
    meets = (F.col("start") < F.col("i") + width) & (F.col("start") + F.col("len") > F.col("i"))
    return d.join(rows, "_step").where(meets & (F.col("_step") == F.greatest(step("i"), step("start")))).select("draw", "i", key, "start")


def sample_windows_by_offset(offsets: DataFrame, key: str, tokens, n: int, block_size: int, seed: int = 42, n_tokens_total=None, span: int | None = None) -> DataFrame:
    """R3 over documents that are not tokenised yet: ``n`` random windows with replacement of the stream whose
    row ``key`` occupies [start, start + len).

    ``offsets``: narrow (key, start, len) rows.  ``tokens(keys)`` gives (key, ids) for a table of keys: only
    documents that a window meets are tokenised, each once, whatever the number of windows on it.
    i ~ U[0, N - bs); x = data[i:i+bs], y = data[i+1:i+1+bs].
    """
    width = block_size + 1
    total = n_tokens_total if n_tokens_total is not None else offsets.agg(F.sum("len")).scalar()
    N = total if isinstance(total, Column) else F.lit(total)
    draws = offsets.sparkSession.range(n).select(F.col("id").alias("draw"), draw_index(seed, F.col("id"), N - block_size).alias("i"))
    met = covering_rows(draws, offsets, key, width, span or max(1 << 14, width))
    ids = tokens(met.select(key).distinct()).select(key, F.col("ids").alias("_ids"))
    lo = F.greatest(F.col("i") - F.col("start"), F.lit(0))
    take = F.least(F.col("i") + width - F.col("start"), F.size("_ids").cast("bigint")) - lo
    pieces = met.join(ids, key).select("draw", "i", "start", F.slice("_ids", (lo + 1).cast("int"), take.cast("int")).alias("_p"))
    g = pieces.groupBy("draw", "i").agg(F.array_sort(F.collect_list(F.struct("start", "_p"))).alias("_ps"))
    full = F.flatten(F.transform("_ps", lambda p: p["_p"]))
    return g.select("draw", "i", F.slice(full, 1, block_size).alias("x"), F.slice(full, 2, block_size).alias("y"))


def sample_batches(df: DataFrame, idx: str, n_batches: int, micro_batch_size: int, seed: int = 42,
                   longest_idx: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``n_batches * micro_batch_size`` draws of row indices with
    replacement; slot 0 of batch 0 is forced to the longest row (K11).
    Returns draws joined to rows: (batch, slot, <row columns>).  ``counted``: a
    narrow frame of as many rows to take the row count from."""
    spark = df.sparkSession
    n = (df if counted is None else counted).agg(F.count(F.lit(1))).scalar()  # scalar subquery, not a join
    draws = spark.range(n_batches * micro_batch_size).select(
        F.expr(f"id div {micro_batch_size}").alias("batch"),
        (F.col("id") % micro_batch_size).cast("bigint").alias("slot"), F.col("id").alias("_d"))
    pick = F.pmod(h48(seed, F.col("_d")), n)
    if longest_idx is not None:
        pick = F.when((F.col("batch") == 0) & (F.col("slot") == 0), longest_idx).otherwise(pick)
    draws = draws.select("batch", "slot", pick.alias(idx))
    return draws.join(df, idx)


def mix(sources: DataFrame, source_col: str, order: str, weights: dict[str, float] | None,
        n: int, seed: int = 42, order_shift: int = 10, draw_shift: int = 12) -> DataFrame:
    """Weighted mixture.  Draw t picks a source with probability w/sum(w)
    (inverse CDF of u01(seed, t); every source alike without weights), then
    that source's next row.  Stops at the first draw whose source is
    exhausted.  Returns (draw, source, rank, rows...).  The source names of a
    mixture are a short list: they become one CASE expression."""
    spark = sources.sparkSession
    if weights is None:
        weights = {row[0]: 1.0 for row in sources.select(source_col).distinct().toLocalIterator()}
    names = sorted(weights)
    if not names:
        return spark.range(0).withColumnRenamed("id", "draw").select(
            "draw", F.lit("").alias(source_col), F.lit(0).cast("bigint").alias("rank")).join(
            sources.withColumn("rank", F.lit(0).cast("bigint")), [source_col, "rank"])
    tot = float(sum(weights.values()))
    # inverse CDF over the fixed, small list of source names
    u = u01(seed, F.col("draw"))
    cum, pick = 0.0, None
    for nm in names:
        cum += weights[nm] / tot
        cond = u < F.lit(cum)
        pick = F.when(cond, F.lit(nm)) if pick is None else pick.when(cond, F.lit(nm))
    pick = pick.otherwise(F.lit(names[-1]))
    d = spark.range(n).withColumnRenamed("id", "draw").withColumn(source_col, pick)
    # rank of a draw inside its source: a per-source prefix count, computed
    # two-level so that a dominant source is never one window partition
    d = running_offset(d, "draw", F.shiftright(F.col("draw"), draw_shift), None, source_col, out="rank")
    counts = sources.groupBy(source_col).agg(F.count(F.lit(1)).alias("_cnt"))
    d = d.join(counts, source_col, "left").fillna(0, ["_cnt"])
    stop = d.filter(F.col("rank") >= F.col("_cnt")).agg(F.min("draw")).scalar()
    d = d.filter(stop.isNull() | (F.col("draw") < stop))
    ranked = running_offset(sources, order, F.shiftright(F.col(order), order_shift), None, source_col, out="rank")
    return d.select("draw", source_col, "rank").join(ranked, [source_col, "rank"])


def shuffle_blocks(blocks: DataFrame, group_cols: list[str], block_key: list[str], seed: int = 42,
                   shuffle: bool = True) -> DataFrame:
    """Permute the blocks of each group of chunks (one group = the files
    loaded together); ``pos`` is the block's position in its group.  The
    permutation is a per-group ``row_number`` over h48(seed, group, block)."""
    keys = [F.col(c) for c in group_cols + block_key]
    order = [h48(seed, *keys), *block_key] if shuffle else block_key
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return blocks.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


def sample_tokens(df: DataFrame, logits: str, temperature: float, top_k: int | None, seed: int = 42,
                  key: str = "row_id") -> DataFrame:
    """Keep exactly min(k, V) largest logits (ties cut by index), divide
    by the temperature, softmax, draw with the exponential race
    argmax(p / E), E = -ln(u).  T <= 0 means argmax.  All per row, array
    functions only."""
    z = F.col(logits)
    pairs = F.transform(z, lambda x, i: F.struct((-x).alias("nz"), i.alias("i")))
    kept = F.array_sort(pairs)
    if top_k is not None:
        kept = F.slice(kept, 1, top_k)
    if temperature <= 0:
        tok = kept[0]["i"]
        return df.withColumn("token", tok.cast("int"))
    m = F.array_max(F.transform(kept, lambda s: -s["nz"] / temperature))
    keys = F.array_repeat(F.col(key), F.size(kept))
    scored = F.zip_with(kept, F.zip_with(keys, spread(m, kept), lambda k, mm: F.struct(k.alias("k"), mm.alias("m"))),
                        lambda s, km: F.struct(
                            (F.exp(-s["nz"] / temperature - km["m"]) / -F.log(u01(seed, km["k"], s["i"]))).alias("score"),
                            s["i"].alias("i")))
    best = F.array_max(scored)
    return df.withColumn("token", best["i"].cast("int"))
