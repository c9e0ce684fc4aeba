"""Scalar schedules, cost model and array maths as Column expressions
(C1-C3, C13-C15).  All JVM-side (higher-order array functions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cosine_lr(step, lr: float, warmup: int, decay: int, min_lr: float) -> Column:
    """Linear warmup, cosine decay to ``min_lr`` at ``decay``, then flat."""
    s = _c(step).cast("double")
    r = (s - warmup) / float(decay - warmup)
    cos = F.lit(min_lr) + F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * r)) * F.lit(lr - min_lr)
    return F.when(s < warmup, F.lit(lr) * s / F.lit(float(warmup))).when(s > decay, F.lit(min_lr)).otherwise(cos)


def linear_warmup(step, lr: float, warmup: int) -> Column:
    """Lr * step / warmup while step <= warmup, then lr."""
    s = _c(step).cast("double")
    return F.when(s <= warmup, F.lit(lr) * s / F.lit(float(warmup))).otherwise(F.lit(lr))


def flops_per_set(params: Column, seq: Column, layers: Column, embd: Column) -> Column:
    """C3 inner term: 2 * params * seq + layers * 4 * embd * seq^2 (DOUBLE)."""
    p, s, l, e = (x.cast("double") for x in (params, seq, layers, embd))
    return F.lit(2.0) * p * s + l * F.lit(4.0) * e * s * s


def flops(seq, layers, embd, trainable, frozen, training: Column | bool = True) -> Column:
    """total = (3 if training else 1) * f(trainable) + (2 if training else 1) * f(frozen)."""
    seq, layers, embd, trainable, frozen = (_c(x) for x in (seq, layers, embd, trainable, frozen))
    tr = _c(training)
    ft = flops_per_set(trainable, seq, layers, embd)
    ff = flops_per_set(frozen, seq, layers, embd)
    return F.when(tr, F.lit(3.0) * ft + F.lit(2.0) * ff).otherwise(ft + ff)


def spread(value: Column, like: Column) -> Column:
    """A per-row scalar repeated to the length of ``like``.  Lambdas must
    only see lambda variables: a per-row aggregate referenced inside a
    lambda is re-evaluated for every element (quadratic), so scalars enter
    element-wise maths through ``zip_with`` with this array instead."""
    return F.array_repeat(value, F.size(like))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def softmax(arr: Column, temperature: float = 1.0) -> Column:
    """C14: stable softmax of an array (max subtracted); linear per row."""
    z = F.transform(arr, lambda x: x.cast("double") / F.lit(float(temperature)))
    e = F.zip_with(z, spread(F.array_max(z), z), lambda x, m: F.exp(x - m))
    return F.zip_with(e, spread(array_sum(e), e), lambda x, s: x / s)


def clamped_log(x: Column, eps: float = 1e-5) -> Column:
    """log(max(x, eps))."""
    return F.log(F.greatest(x, F.lit(eps)))


def entropy_term(p: Column, eps: float = 1e-5) -> Column:
    """-p * log(max(p, eps))."""
    return -p * clamped_log(p, eps)


def rms_norm(vec: Column, weight: Column | None = None, eps: float = 1e-5) -> Column:
    """X * rsqrt(mean(x^2) + eps) * w."""
    ms = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(vec)
    r = F.lit(1.0) / F.sqrt(ms + F.lit(eps))
    y = F.zip_with(vec, spread(r, vec), lambda x, k: x * k)
    if weight is None:
        return y
    return F.zip_with(y, weight, lambda x, w: x * w)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def sq_dist(a: Column, b: Column) -> Column:
    """Squared euclidean distance of two equal-length arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
                       F.lit(0.0), lambda s, x: s + x)
