"""Instruction samples and batches: shift, pad, longest, mask, stop cut
(K9-K13).  Per-row array expressions; per-batch windows are bounded by the
micro-batch size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shift_targets(ids: Column) -> tuple[Column, Column]:
    """K9: x = ids[:-1], y = ids[1:] (next-token targets)."""
    n = F.size(ids)
    return F.slice(ids, 1, n - 1), F.slice(ids, 2, n - 1)


def drop_last_first(logits: Column, targets: Column) -> tuple[Column, Column]:
    """K9 (fine-tune form): drop the last logit row and the first target."""
    return F.slice(logits, 1, F.size(logits) - 1), F.slice(targets, 2, F.size(targets) - 1)


def pad_batch(df: DataFrame, batch: str | list[str], input_ids: str = "input_ids", labels: str = "labels",
              pad_id: int = 0, ignore_id: int = -1) -> DataFrame:
    """Right-pad every row to the longest ``input_ids`` of its batch:
    inputs with ``pad_id``, labels with ``ignore_id``.  Labels longer than
    that length raise (the max is taken over inputs only)."""
    keys = [batch] if isinstance(batch, str) else batch
    m = F.max(F.size(input_ids)).over(Window.partitionBy(*keys))
    d = df.withColumn("_m", m)
    bad = F.size(labels) > F.col("_m")
    x = F.concat(F.col(input_ids), F.array_repeat(F.lit(pad_id), F.col("_m") - F.size(input_ids)))
    y = F.when(bad, F.raise_error(F.lit("labels longer than the batch's longest input"))).otherwise(
        F.concat(F.col(labels), F.array_repeat(F.lit(ignore_id), F.col("_m") - F.size(labels))))
    return d.withColumn("x", x).withColumn("y", y).drop("_m")


def longest(df: DataFrame, idx: str, ids: str = "input_ids", size: Column | None = None) -> DataFrame:
    """The maximum length and the first index reaching it (``size``: lengths already at hand)."""
    n = F.size(ids) if size is None else size
    return df.agg(F.max(n).cast("bigint").alias("longest"),
                  F.min_by(F.col(idx), F.struct(-n, F.col(idx))).cast("bigint").alias("longest_idx"))


def mask_labels(ids: Column, prompt_len: Column, ignore_id: int = -1) -> Column:
    """labels = ids with the first ``prompt_len`` positions set to -1."""
    p = F.least(prompt_len, F.size(ids))
    return F.concat(F.array_repeat(F.lit(ignore_id), p), F.slice(ids, p + 1, F.size(ids)))


def first_match(ids: Column, stop: list[int]) -> Column:
    """1-based start of the first occurrence of ``stop`` in ids (0 if none).

    Searched as text: ``,a,b,`` inside ``,id1,id2,...,`` with ``instr``, so
    the cost is linear in the sequence and no lambda closes over ``ids``
    (Catalyst may inline an upstream expression into a lambda, which would
    re-evaluate it per element)."""
    s = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    pat = "," + ",".join(str(int(t)) for t in stop) + ","
    p = F.instr(s, pat)
    head = F.substring(s, F.lit(1), p)
    commas = F.length(head) - F.length(F.replace(head, F.lit(","), F.lit("")))
    return F.when(p > 0, commas).otherwise(F.lit(0))


def truncate_at_stop(ids: Column, stops: list[list[int]], keep_stop: bool = False, compat: bool = False) -> Column:
    """Generation ends with the stop sequence that is complete first; cut
    before it (``keep_stop``: after it, the single-eos form of generation).
    Of several that end at the same token the longest is cut.

    ``compat=True`` reproduces buffered streaming output: tokens are released
    in blocks of L = the longest stop length, so at a stop ending at position
    t only ``L * floor((t - 1) / L)`` tokens were released, and without a
    stop the unreleased tail ``n mod L`` is lost."""
    big = F.size(ids) + 1
    if compat:
        L = max((len(st) for st in stops), default=1)
        ends = []
        for st in stops:
            pos = first_match(ids, st)
            ends.append(F.when(pos > 0, pos + len(st) - 1))
        t = (F.least(*ends) if len(ends) > 1 else ends[0]) if ends else F.lit(None)
        n_out = F.when(t.isNotNull(), F.floor((t - 1) / L) * L).otherwise(F.floor(F.size(ids) / L) * L)
        return F.slice(ids, 1, n_out.cast("int"))
    found = []
    for st in stops:
        pos = first_match(ids, st)
        found.append(F.when(pos > 0, F.struct((pos + len(st)).alias("end"), pos.alias("start")))
                     .otherwise(F.struct((big + 1).alias("end"), big.alias("start"))))
    first = F.array_min(F.array(*found))
    cut = F.least(first["end"], big) if keep_stop else first["start"]
    return F.slice(ids, 1, cut - 1)
