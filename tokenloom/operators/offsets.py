"""Global ranks and running offsets without a single-partition window (K2, K3).

A global prefix sum is split in two levels:

1. every row gets a *bucket* that is monotone in the order key (for hash
   orders: the high bits of the hash; for dense ids: ``id >> k``);
2. per-bucket totals are prefix-summed, again in two levels (``FAN`` buckets to a
   group), and joined back on the bucket; the in-bucket prefix sum is a window
   partitioned by bucket.

No table is broadcast by force: rows and totals are dealt by the same key, and
the planner may still broadcast totals that it measures as small.  The wide
rows are shuffled once, on the bucket.  The bucket totals are a
map-side partial aggregation of the narrow (partition, bucket, weight)
columns; when the weight needs an expensive upstream projection
(tokenisation), ``totals_from`` supplies a cheap frame for the totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 48
MIN_BUCKET_BITS = 6
TARGET_BUCKET_BYTES = 256 << 20
FAN = 1 << 10  # buckets whose totals are summed in one window
BUCKET_ROWS = 1 << 20  # rows per bucket of a measured order


def input_bytes(df: DataFrame) -> int:
    """Total size of the files behind a scan, from the listing that Spark already made."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def bucket_plan(n_bytes: int, expansion: float = 1.0, target: int = TARGET_BUCKET_BYTES,
                min_partitions: int = 1) -> tuple[int, int]:
    """(bits, shuffle partitions) for a two-level offset over ``n_bytes`` of
    input whose shuffled rows are ``expansion`` times the file bytes (1 when
    the shuffle carries text, ~4 for int32 token arrays).

    About ``target`` bytes per window task and at least 64 buckets per task, so
    that hash placement of buckets stays balanced.  100 TB of text: 25 bits,
    ~410k tasks; 1 TB: 18 bits, ~4.1k tasks; the test tables: 9 bits, one
    task per slot."""
    parts = max(min_partitions, math.ceil(max(1.0, n_bytes * expansion / target)))
    return max(MIN_BUCKET_BITS, math.ceil(math.log2(parts * 64))), parts


def hash_bucket(h: Column, bits: int) -> Column:
    """Monotone bucket of a 48-bit hash: its top ``bits`` bits."""
    if not 0 < bits <= HASH_BITS:
        raise ValueError(f"bits must be in 1..{HASH_BITS}")
    return F.shiftright(h, HASH_BITS - bits)


def measured_bucket(df: DataFrame, order: Column, rows: int = BUCKET_ROWS) -> Column:
    """Monotone bucket of a numeric order key: equal steps between its extremes,
    about ``rows`` rows each (one narrow aggregate over the key)."""
    n, lo, hi = df.agg(F.count(order), F.min(order), F.max(order)).first()
    steps = max(1, math.ceil((n or 0) / rows))
    if steps == 1 or lo == hi:
        return F.lit(0).cast("bigint")
    width = (float(hi) - float(lo)) / steps
    return F.least(F.floor((order - F.lit(lo)) / F.lit(width)), F.lit(steps - 1)).cast("bigint")


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs or [])


def running_offset(
    df: DataFrame,
    order: Sequence[str] | str,
    bucket: Column,
    weight: Column | str | None = None,
    partition: Sequence[str] | str = (),
    out: str = "start",
    total: str | None = None,
    totals_from: DataFrame | None = None,
    dtype: str = "bigint",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over all earlier rows in ``partition``
    ordered by ``order``.  ``bucket`` must never decrease as the order key
    grows.  With ``total`` set, also add the partition-wide sum of weights.

    ``totals_from`` is an optional narrow frame with the same rows (partition,
    bucket and weight inputs only) used for the bucket totals, so that an
    expensive wide projection upstream (tokenisation) is evaluated once.
    """
    order, part = _cols(order), _cols(partition)
    w = F.lit(1).cast("bigint") if weight is None else (
        F.col(weight) if isinstance(weight, str) else weight).cast(dtype)
    keyed = df.withColumn("_bkt", bucket.cast("bigint")).withColumn("_w", w)
    def dealt(d):
        return d.repartition(num_partitions, *part, "_bkt") if num_partitions else d.repartition(*part, "_bkt")

    # bucket totals: summed from the frame *before* the shuffle (map-side partial
    # aggregation, only the (partition, bucket, weight) columns survive
    # pruning), so the wide rows are shuffled once, not twice.
    src = keyed if totals_from is None else (
        totals_from.withColumn("_bkt", bucket.cast("bigint")).withColumn("_w", w))
    tot = src.groupBy(*part, "_bkt").agg(F.sum("_w").alias("_bw")).withColumn("_grp", F.floor(F.col("_bkt") / FAN))
    grp = tot.groupBy(*part, "_grp").agg(F.sum("_bw").alias("_gw"))
    before = Window.partitionBy(*part).orderBy("_grp").rowsBetween(Window.unboundedPreceding, -1)
    grp = grp.withColumn("_gbase", F.coalesce(F.sum("_gw").over(before), F.lit(0)))
    if total:
        grp = grp.withColumn(total, F.sum("_gw").over(Window.partitionBy(*part)))
    within = Window.partitionBy(*part, "_grp").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*part, "_grp"]
    base = (tot.withColumn("_base", F.coalesce(F.sum("_bw").over(within), F.lit(0))).join(grp.drop("_gw"), keys)
            .withColumn("_base", F.col("_base") + F.col("_gbase")).drop("_bw", "_grp", "_gbase"))
    inside = Window.partitionBy(*part, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    res = (dealt(keyed).withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
           .join(dealt(base), [*part, "_bkt"])
           .withColumn(out, F.col("_base") + F.col("_in")))
    return res.drop("_bkt", "_w", "_base", "_in")


def contiguous_shards(df: DataFrame, order: Sequence[str] | str, bucket: Column, n_shards: int,
                      partition: Sequence[str] | str = (), out: str = "shard") -> DataFrame:
    """K3: ``n_shards`` contiguous shards in order; the first ``n % n_shards``
    shards hold one row more (the rule of ``ntile``)."""
    ranked = running_offset(df, order, bucket, None, partition, out="_rank", total="_n")
    q = F.floor(F.col("_n") / n_shards)
    rem = F.col("_n") % n_shards
    big = rem * (q + 1)
    shard = F.when(F.col("_rank") < big, F.floor(F.col("_rank") / (q + 1))).otherwise(
        rem + F.floor((F.col("_rank") - big) / q))
    return ranked.withColumn(out, shard.cast("bigint")).drop("_rank", "_n")


def halo_window(df: DataFrame, partition: Sequence[str] | str, step: str, halo: int, compute,
                bucket_rows: int = 1 << 16) -> DataFrame:
    """Evaluate a bounded-frame window (frame reaching ``halo`` rows back)
    without one task per ``partition`` value: rows are cut into buckets of
    ``bucket_rows`` consecutive dense steps; the last ``halo`` rows of each
    bucket are copied into the next bucket as context, ``compute(df, w)``
    adds columns with window ``w`` (partition + bucket, ordered by step), and
    the copies are dropped."""
    part = _cols(partition)
    B = bucket_rows
    if halo >= B:
        raise ValueError("halo must be smaller than bucket_rows")
    own = F.floor(F.col(step) / B)
    copies = F.when((F.col(step) % B) >= B - halo, F.array(own, own + 1)).otherwise(F.array(own))
    d = df.withColumn("_hb", F.explode(copies)).withColumn("_halo", F.col("_hb") != own)
    w = Window.partitionBy(*part, "_hb").orderBy(step)
    return compute(d, w).filter(~F.col("_halo")).drop("_hb", "_halo")
