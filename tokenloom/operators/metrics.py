"""Run logs, losses and evaluation roll-ups.

A run log is ``(run, step, ts, metric, value)``.  Per-run sequences are never
one window partition per run: steps come from the two-level rank, cumulative
sums from ``running_offset`` and bounded frames from ``halo_window``.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tokenloom.functions.hashing import h48
from tokenloom.functions.scalar import array_sum, spread
from tokenloom.operators.offsets import halo_window, measured_bucket, running_offset


def with_steps(log: DataFrame, run: str, order: list[str], bucket: Column, out: str = "step") -> DataFrame:
    """Dense 0-based step per run in ``order`` (two-level rank)."""
    return running_offset(log, order, bucket, None, run, out=out)


def row_cross_entropy(logits: Column, target: Column) -> Column:
    """logsumexp(z) - z[target] for one row (NULL when target = -1)."""
    z = F.transform(logits, lambda x: x.cast("double"))
    m = F.array_max(z)
    lse = m + F.log(array_sum(F.zip_with(z, spread(m, z), lambda x, mm: F.exp(x - mm))))
    return F.when(target != -1, lse - F.element_at(z, (target + 1).cast("int")))


def cross_entropy(df: DataFrame, logits: str, target: str, keys: list[str] | None = None,
                  empty: str = "nan") -> DataFrame:
    """A1: mean over rows with target != -1 of the row loss.  No valid row:
    NaN (``empty='nan'``, the unchunked rule) or 0 (``'zero'``, Σ/max(1,n))."""
    keys = keys or []
    loss = row_cross_entropy(F.col(logits), F.col(target))
    g = df.groupBy(*keys).agg(F.sum(loss).alias("_s"), F.count(loss).cast("bigint").alias("n_valid"))
    none = F.lit(float("nan")) if empty == "nan" else F.lit(0.0)
    return g.select(*keys, "n_valid",
                    F.when(F.col("n_valid") > 0, F.col("_s") / F.col("n_valid")).otherwise(none).alias("loss"))


def validation_loss(batch_losses: DataFrame, batch: str, loss: str = "loss", max_batches: int | None = None,
                    keys: list[str] | None = None) -> DataFrame:
    """A2: unweighted mean of batch means over the first ``max_batches`` batches."""
    keys = keys or []
    b = batch_losses if max_batches is None else batch_losses.filter(F.col(batch) < max_batches)
    return b.groupBy(*keys).agg(F.avg(loss).alias("val_loss"), F.count(F.lit(1)).cast("bigint").alias("n_batches"))


def run_totals(log: DataFrame, run: str, step: str, lengths: str, micro_batch_size: int,
               bucket_rows: int = 1 << 12) -> DataFrame:
    """Running total of padded lengths per run, samples = (step+1) * mbs."""
    d = running_offset(log, step, F.floor(F.col(step) / bucket_rows), lengths, run, out="_before", dtype="double")
    return (d.withColumn("lengths_total", F.col("_before") + F.col(lengths))
            .withColumn("samples", (F.col(step) + 1) * micro_batch_size).drop("_before"))


def throughput(log: DataFrame, run: str, step: str, ts: Column, counters: list[str], window: int = 50,
               bucket_rows: int = 1 << 16) -> DataFrame:
    """Rates over the last ``window`` records: (last - first) / (t_last - t_first)
    inside the trailing frame; NULL while the frame holds one record."""
    d = log.withColumn("_t", ts)

    def compute(x, w):
        fr = w.rowsBetween(-(window - 1), 0)
        dt = F.col("_t") - F.first("_t").over(fr)
        x = x.withColumn("_dt", dt)
        for c in counters:
            x = x.withColumn(f"{c}_per_sec", F.when(F.col("_dt") > 0, (F.col(c) - F.first(c).over(fr)) / F.col("_dt")))
        return x.drop("_dt")

    return halo_window(d, run, step, window - 1, compute, bucket_rows).drop("_t")


def iter_time(log: DataFrame, run: str, step: str, ts: Column, accum: int, bucket_rows: int = 1 << 16) -> DataFrame:
    """Seconds since the previous record of the run; optimizer-step flag
    every ``accum`` iterations."""
    d = log.withColumn("_t", ts)

    def compute(x, w):
        return x.withColumn("dt", F.col("_t") - F.lag("_t").over(w))

    out = halo_window(d, run, step, 1, compute, bucket_rows)
    return out.withColumn("is_optimizer_step", ((F.col(step) + 1) % accum) == 0).drop("_t")


def cadence(log: DataFrame, step: str, every: int, accum: int = 1) -> DataFrame:
    """Records on the eval/save/log cadence.  An optimizer step happens
    at iteration ``step`` when (step + 1) % accum == 0; the cadence counts
    optimizer steps: keep rows where that count is a multiple of ``every``."""
    opt = (F.col(step) + 1) % accum == 0
    return log.filter(opt & ((F.floor((F.col(step) + 1) / accum) % every) == 0))


def first_n(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in order (TakeOrdered)."""
    return df.orderBy(*order).limit(n)


def tokens_per_sec(df: DataFrame, run: str, total: str, prompt: str, seconds: str) -> DataFrame:
    """generated = total - prompt tokens; rate = Σ generated / Σ seconds per run."""
    g = df.groupBy(run).agg(F.sum(F.col(total) - F.col(prompt)).alias("generated"),
                            F.sum(seconds).alias("seconds"))
    return g.withColumn("tokens_per_sec", F.when(F.col("seconds") > 0, F.col("generated") / F.col("seconds")))


def compute_to_target(log: DataFrame, run: str, step: str, loss: str, flops_per_step: Column,
                      target: float, budget: float | None = None) -> DataFrame:
    """Compute spent until the loss first reaches ``target`` per run
    (cumulative flops = (step + 1) * flops per step), ranked; runs over the
    budget or never reaching the target get no rank."""
    hit = log.filter(F.col(loss) <= target).groupBy(run).agg(F.min(step).alias("first_step"))
    runs = log.groupBy(run).agg(F.first(flops_per_step, ignorenulls=True).alias("_fps"))
    d = runs.join(hit, run, "left").withColumn("compute", (F.col("first_step") + 1) * F.col("_fps"))
    if budget is not None:
        d = d.withColumn("compute", F.when(F.col("compute") <= budget, F.col("compute")))
    reached = d.filter(F.col("compute").isNotNull())
    # (compute, run) is unique, so the rank is the two-level row number
    ranked = running_offset(reached.select(run, "compute"), ["compute", run], measured_bucket(reached, F.col("compute")), None, out="_r")
    return d.join(ranked.select(run, (F.col("_r") + 1).alias("rank")), run, "left").drop("_fps")


def eval_rollup(scores: DataFrame, task: str, score: str, config: dict) -> DataFrame:
    """Per-task mean and count, with the run configuration attached."""
    g = scores.groupBy(task).agg(F.avg(score).alias("acc"), F.count(F.lit(1)).cast("bigint").alias("n"))
    for k, v in config.items():
        g = g.withColumn(k, F.lit(v))
    return g


#: Iterations of one vector of the bootstrap, and vectors a task holds before it sends them.
BOOT_BLOCK, BOOT_HOLD = 1 << 13, 512
#: Examples drawn at a time.
BOOT_ROWS = 16
#: Cumulative probabilities of Poisson(1); larger weights than 18 lie beyond the resolution of a draw.
POISSON1 = list(itertools.accumulate(math.exp(-1.0) / math.factorial(k) for k in range(18)))


def counter_uniforms(key: int, first: int, n: int):
    """``n`` uniforms in (0, 1) of a counter-based generator: the finaliser of ``key`` plus a multiple of
    the counter, 48 bits each; any range of counters can be had by itself."""
    import numpy as np
    return (_mixed(np.uint64(key), first, n) >> np.uint64(16)).astype(np.float64) / 2.0 ** 48 + 2.0 ** -49


def _mixed(key, first: int, n: int):
    import numpy as np
    z = key + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def poisson_table(n: int):
    """(least count, cumulative probabilities) of Poisson(n) within 12 standard deviations: O(sqrt n) entries."""
    import numpy as np
    lo, hi = max(0, int(n - 12 * n ** 0.5 - 20)), int(n + 12 * n ** 0.5 + 40)
    logs = np.concatenate(([lo * math.log(n) - n - math.lgamma(lo + 1)], math.log(n) - np.log(np.arange(lo + 1, hi + 1))))
    return lo, np.cumsum(np.exp(np.cumsum(logs)))


def _boot_batch(held: dict):
    """The vectors held so far as one batch; they are let go."""
    import pyarrow as pa
    rows = list(held.items())
    held.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()),
         pa.array([v[0] for _, v in rows], pa.list_(pa.float64())), pa.array([v[1] for _, v in rows], pa.list_(pa.float64()))],
        names=["task", "block", "sums", "weights"])


def _boot_partials(iters: int):
    """Arrow batches of (task, score, n, key, block) -> weighted sums and weights per iteration of a (task, block)."""
    def run(batches):
        import numpy as np
        held, tables = {}, {}
        for b in batches:
            for task, score, n, key, block in zip(*(b.column(c).to_pylist() for c in ("task", "score", "n", "key", "block")), strict=True):
                size = min(BOOT_BLOCK, iters - block * BOOT_BLOCK)
                if n not in tables:
                    if len(tables) >= 64:
                        tables.clear()
                    tables[n] = poisson_table(n)
                lo, cdf = tables[n]
                w = lo + np.searchsorted(cdf, counter_uniforms(key, block * BOOT_BLOCK, size), side="left")
                sums, weights = held.setdefault((task, block), (np.zeros(size), np.zeros(size)))
                sums += w * score
                weights += w
                if len(held) >= BOOT_HOLD:
                    yield _boot_batch(held)
        if held:
            yield _boot_batch(held)

    return run


def _boot_means(group):
    """Partial vectors of one (task, block) -> the resampled mean of every iteration that drew something."""
    import numpy as np
    import pyarrow as pa
    sums, weights = (np.sum([np.asarray(x) for x in group.column(c).to_pylist()], axis=0) for c in ("sums", "weights"))
    means = (sums / np.where(weights > 0, weights, np.nan))[weights > 0]
    return pa.table({"task": pa.array(group.column("task").to_pylist()[:1], pa.string()), "means": pa.array([means], pa.list_(pa.float64()))})


@functools.lru_cache(maxsize=1)
def _poisson1_table():
    """Weights by a draw's upper 16 bits: where these leave it open, 255."""
    import numpy as np
    cdf = np.array(POISSON1)
    top = np.arange(1 << 16, dtype=np.float64) * 2.0 ** 32
    low, high = (np.searchsorted(cdf, (top + m + 0.5) / 2.0 ** 48, side="right") for m in (0, 2.0 ** 32 - 1))
    return cdf, np.where(low == high, low, 255).astype(np.uint8)


def poisson1_weights(keys, first: int, n: int):
    """Poisson(1) weights of each key's counters ``first`` to ``first + n - 1``: one row per key."""
    import numpy as np
    cdf, table = _poisson1_table()
    z = _mixed(np.asarray(keys).astype(np.uint64)[:, None], first, n)
    out = table[z >> np.uint64(48)]
    at = np.nonzero(out == 255)
    out[at] = np.searchsorted(cdf, (z[at] >> np.uint64(16)).astype(np.float64) / 2.0 ** 48 + 2.0 ** -49, side="right")
    return out


def _boot_examples(iters: int):
    """Arrow batches of (task, score, key), a row per example -> weighted sums and weights per iteration of a (task, block)."""
    def run(batches):
        import numpy as np
        held = {}
        for b in batches:
            key, score = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "score"))
            tasks = b.column("task").to_pylist()
            for lo in range(0, len(tasks), BOOT_ROWS):
                rows = slice(lo, lo + BOOT_ROWS)
                kinds = list(dict.fromkeys(tasks[rows]))
                count = np.array([[t == k for t in tasks[rows]] for k in kinds], np.float64)
                take = np.concatenate([count * score[rows], count])
                for block in range(-(-iters // BOOT_BLOCK)):
                    size = min(BOOT_BLOCK, iters - block * BOOT_BLOCK)
                    made = take @ poisson1_weights(key[rows], block * BOOT_BLOCK, size)
                    for i, k in enumerate(kinds):
                        sums, weights = held.setdefault((k, block), (np.zeros(size), np.zeros(size)))
                        sums += made[i]
                        weights += made[len(kinds) + i]
                    if len(held) >= BOOT_HOLD:
                        yield _boot_batch(held)
        if held:
            yield _boot_batch(held)

    return run


def bootstrap_se(scores: DataFrame, task: str, score: str, iters: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """(task, stderr, iters), the bootstrap standard error of the per-task mean.

    Every example has a Poisson(1) weight in an iteration.  With ``key``, the column that names an
    example, each example draws its own weight in every iteration, by inversion of a uniform from a
    counter-based generator (a resample is the same for all tasks an example has).  Without one,
    examples are not told apart: the n that share a score have a Poisson(n) weight together, drawn
    once per distinct (task, score) and iteration.  Tasks add up vectors of ``BOOT_BLOCK``
    iterations, the shuffle carries those vectors, and the result does not depend on the
    partitioning.  Null scores are left out, as are iterations that draw nothing.
    """
    spark = scores.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the draws are the work, not the bytes
    named = [F.col(task).cast("string").alias("task"), F.col(score).cast("double").alias("score")]
    d = scores.where(F.col(score).isNotNull())
    if key is not None:
        d = d.select(*named, h48(seed, F.col(key)).alias("key")).repartition(tasks, "key").sortWithinPartitions("task")  # few tasks are held at a time
        partials = _boot_examples(iters)
    else:
        d = d.select(*named).groupBy("task", "score").agg(F.count(F.lit(1)).alias("n")).withColumn("key", h48(seed, F.col("task"), F.col("score")))
        d = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-iters // BOOT_BLOCK) - 1).cast("long"))))
        d = d.repartition(tasks, "score", "block")
        partials = _boot_partials(iters)
    parts = d.mapInArrow(partials, "task string, block long, sums array<double>, weights array<double>")
    means = parts.groupBy("task", "block").applyInArrow(_boot_means, "task string, means array<double>")
    return means.select("task", F.explode("means").alias("_m")).groupBy("task").agg(
        F.stddev_samp("_m").alias("stderr"), F.count(F.lit(1)).cast("bigint").alias("iters")).withColumnRenamed("task", task)


def daily_report(log: DataFrame, ts: str, metric: str, value: str, tie: str) -> DataFrame:
    """Per (day, metric): first/last value of the day, min, max, mean,
    count, with the day printed en-GB (dd/MM/yyyy)."""
    d = log.withColumn("day", F.to_date(ts))
    order = F.struct(F.col(ts), F.col(tie))
    g = d.groupBy("day", metric).agg(
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"),
        F.sum(value).alias("total_value"),
        F.count(F.lit(1)).cast("bigint").alias("n"))
    return g.withColumn("day_label", F.date_format("day", "dd/MM/yyyy"))


def score_examples(df: DataFrame, score_fn, key: str, text: str, task: str | None = None) -> DataFrame:
    """model plug-in.  ``score_fn(pandas.Series[str]) -> pandas.Series[float]``
    scores a batch of examples inside ``mapInPandas`` (Arrow batches); the
    result (key, task, score) feeds ``eval_rollup``."""
    def run(it):
        import pandas as pd
        for pdf in it:
            yield pd.DataFrame({key: pdf[key], "task": pdf["task"], "score": score_fn(pdf[text]).astype("float64")})

    src = df.select(key, text, (F.lit(task) if task is not None else F.col("task")).alias("task"))
    return src.mapInPandas(run, f"{key} bigint, task string, score double")


def observe_totals(df: DataFrame, metric: Observation, length: str = "len") -> DataFrame:
    """scalar statistics collected while the data flows (rows, tokens, the longest row), read from
    ``metric.get`` after the action; no extra job."""
    return df.observe(metric, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(length), F.lit(0)).cast("bigint").alias("tokens"),
                      F.coalesce(F.max(length), F.lit(0)).cast("bigint").alias("longest"))
