"""Token stream layout: totals, packing, blocks, shards, groups (K1, K4-K8).

A token stream is never exploded to one row per token.  Rows carry
``ids ARRAY<INT>`` and a ``start`` offset (K2); packing cuts every row into
the pieces that fall in each fixed-size chunk and regroups pieces by chunk
(a chunk holds at most ``chunk_size`` tokens, so each group is bounded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.offsets import running_offset


#: Chunks of a part into which long rows are cut before they are cut chunk by chunk.
SPAN = 4


def token_totals(df: DataFrame, part: list[str] | str = "split", length: str = "len") -> DataFrame:
    """K1: total tokens per split (partial + final aggregation)."""
    part = [part] if isinstance(part, str) else part
    return df.groupBy(*part).agg(F.sum(length).cast("bigint").alias("n_tokens"))


def pack(df: DataFrame, chunk_size: int, sep: int, order: list[str] | str, bucket: Column,
         part: list[str] | str = (), ids: str | Column = "ids", flush: bool = True,
         lengths: DataFrame | None = None, length: str | None = None,
         num_partitions: int | None = None) -> DataFrame:
    """K4: concatenate rows (in ``order`` within ``part``) into one stream and
    cut it into chunks of ``chunk_size``.  Rows are split across chunk
    boundaries; the last chunk is filled with ``sep``.  With ``flush`` the
    tail is kept (never an extra empty chunk); without, a partial tail is
    dropped.  ``lengths`` (optional): the same rows with ``len`` computed
    cheaply, for the bucket totals.

    Late tokenisation: with ``ids`` given as a Column expression and
    ``length`` naming a column that already holds each row's token count
    (cheap for byte tokens), offsets are computed on the input rows and the
    ids are evaluated only after the bucket shuffle, so the shuffle moves the
    (smaller) input instead of the token arrays and tokenisation runs spread
    over the shuffle partitions.  Returns (part..., chunk_id, n_tokens, ids)."""
    part = [part] if isinstance(part, str) else list(part)
    C = chunk_size
    late = isinstance(ids, Column)
    if late:
        if length is None:
            raise ValueError("late tokenisation needs a precomputed length column")
        d = df.withColumn("_len", F.col(length).cast("int"))
    else:
        d = df.withColumn("_len", F.size(ids))
    tf = None if lengths is None else lengths.withColumn("_len", F.col("len"))
    d = running_offset(d, order, bucket, "_len", part, out="_start", totals_from=tf, num_partitions=num_partitions)
    d = d.filter(F.col("_len") > 0)  # empty rows add nothing (after the window: no pushdown)
    if late:
        d = d.withColumn("_ids", ids)
        ids = "_ids"
    # A row's pieces are cut in two steps: first, inside the row, into parts of SPAN chunks (a row within one part, as
    # most are, is passed on as it is), then chunk by chunk after an explode that carries at most such a
    # part.  So a row of L ids carries L ids through the first explode, and the slices per chunk are compiled code
    # (inside a lambda they would be interpreted, id by id).
    W = C * SPAN
    d = d.select(*part, "_start", "_len", F.col(ids).alias("_row"))
    last = F.col("_start") + F.col("_len") - 1
    div = lambda x, n: F.call_function("div", x, F.lit(n))  # noqa: E731  whole-number division: offsets beyond 2**53 stay exact
    cs = F.sequence(div(F.col("_start"), W), div(last, W))
    parts = F.transform(cs, lambda c: F.struct(
        F.greatest(F.col("_start"), c * W).alias("_lo"),
        F.slice(F.col("_row"), (F.greatest(F.col("_start"), c * W) - F.col("_start") + 1).cast("int"),
                (F.least(F.col("_start") + F.col("_len"), (c + 1) * W) - F.greatest(F.col("_start"), c * W)).cast("int")).alias("_ids")))
    whole = F.array(F.struct(F.col("_start").alias("_lo"), F.col("_row").alias("_ids")))
    d = d.select(*part, F.explode(F.when(div(F.col("_start"), W) == div(last, W), whole).otherwise(parts)).alias("_c")).select(*part, "_c._lo", "_c._ids")
    d = d.withColumn("_end", F.col("_lo") + F.size("_ids"))
    d = d.withColumn("chunk_id", F.explode(F.sequence(div(F.col("_lo"), C), div(F.col("_end") - 1, C))))
    a, b = F.greatest("_lo", F.col("chunk_id") * C), F.least("_end", (F.col("chunk_id") + 1) * C)
    pieces = d.select(*part, "chunk_id", a.alias("_lo"), F.slice("_ids", (a - F.col("_lo") + 1).cast("int"), (b - a).cast("int")).alias("_p"))
    g = pieces.groupBy(*part, "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("_lo", "_p"))).alias("_ps"))
    flat = F.flatten(F.transform("_ps", lambda s: s["_p"]))
    out = g.select(*part, "chunk_id", flat.alias("ids")).withColumn("n_tokens", F.size("ids"))
    fill = F.array_repeat(F.lit(sep), F.greatest(F.lit(C) - F.col("n_tokens"), F.lit(0)))
    out = out.withColumn("ids", F.concat("ids", fill))
    if not flush:
        out = out.filter(F.col("n_tokens") == C)
    return out.select(*part, "chunk_id", "n_tokens", "ids")


def calibration_blocks(sample: DataFrame, tok, n_samples: int, block_size: int, order: list[str], bucket: Column,
                       text: str = "text", joiner: str = "\n") -> DataFrame:
    """K8: the sampled texts joined by ``joiner``, encoded with one closing eos and
    cut into ``n_samples`` blocks of ``block_size`` ids; fewer ids raise.  Exact for
    tokenizers that do not merge across the joiner.  Returns (sample, ids)."""
    key = F.struct(*order)
    last = sample.agg(F.max(key)).scalar()
    ids = F.concat(tok.encode(F.when(key < last, F.concat(F.col(text), F.lit(joiner))).otherwise(F.col(text))),
                   F.when(key < last, F.array().cast("array<int>")).otherwise(F.array(F.lit(tok.eos_id))))
    chunks = pack(sample.withColumn("_ids8", ids), block_size, 0, order=order, bucket=bucket, ids="_ids8")
    chunks = chunks.filter(F.col("chunk_id") < n_samples)
    full = chunks.filter(F.col("n_tokens") == block_size).agg(F.count(F.lit(1))).scalar()
    checked = F.when(full >= n_samples, F.col("ids")).otherwise(
        F.raise_error(F.lit("not enough calibration tokens for n_samples * block_size")))
    return chunks.select(F.col("chunk_id").alias("sample"), checked.alias("ids"))


def blocks(chunks: DataFrame, block_size: int, chunk_size: int, ids: str = "ids",
           keys: list[str] | None = None) -> DataFrame:
    """K5: ``chunk_size // block_size`` blocks per chunk, the remainder of
    every chunk dropped.  Built-in generator, no UDTF."""
    nb = chunk_size // block_size
    keys = keys if keys is not None else [c for c in chunks.columns if c not in (ids, "n_tokens")]
    if nb == 0:
        return chunks.select(*keys, F.lit(0).cast("bigint").alias("block_id"), F.col(ids)).limit(0)
    b = chunks.select(*keys, F.col(ids), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("block_id"))
    return b.select(*keys, F.col("block_id").cast("bigint"),
                    F.slice(ids, F.col("block_id") * block_size + 1, block_size).alias("ids"))


def assign_shards(files: DataFrame, idx: str, num_workers: int, num_processes: int) -> DataFrame:
    """K6: strided sharding.  num_shards = workers * processes; files past the
    last multiple of num_shards are dropped; shard s takes files s, s+n, ..."""
    n = num_workers * num_processes
    n_files = files.agg(F.count(F.lit(1))).scalar()
    return (files.filter(F.col(idx) < F.floor(n_files / n) * n)
            .withColumn("shard", (F.col(idx) % n).cast("bigint"))
            .withColumn("worker", (F.col("shard") % num_workers).cast("bigint"))
            .withColumn("rank", F.floor(F.col("shard") / num_workers).cast("bigint")))


def chunk_groups(files: DataFrame, idx: str, n_chunks: int, epochs: int = 1, wrap: bool = False) -> DataFrame:
    """K7: groups of ``n_chunks`` consecutive files (by ``idx`` inside a shard);
    an incomplete last group is dropped.  With ``wrap`` the stream restarts at
    file 0 for each of ``epochs`` epochs, again skipping the incomplete rest."""
    n_files = files.agg(F.count(F.lit(1))).scalar()
    g = (files.withColumn("group_id", F.floor(F.col(idx) / n_chunks).cast("bigint"))
         .filter(F.col("group_id") < F.floor(n_files / n_chunks)))
    n_ep = epochs if wrap else 1
    g = g.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_ep - 1))))
    return g.withColumn("epoch", F.col("epoch").cast("bigint"))
