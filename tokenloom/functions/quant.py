"""Quantiser maths as Column expressions.

FSQ (finite scalar quantisation): per dimension with L levels,
``bound(z) = tanh(z + shift) * half - offset`` with ``half = (L-1)(1-eps)/2``,
``offset = 0.5`` for even L, ``shift = tan(offset/half)``; the code is
``round_half_even(bound) / (L // 2)``; the index is ``sum((code*hw + hw) *
basis)`` with ``basis = cumprod([1] + L[:-1])`` (first dimension least
significant).

LFQ (lookup-free quantisation): x > 0 -> +scale else -scale; index =
``sum(bit_j * 2^(D-1-j))`` (first dimension most significant).

int4: ``q = clamp(round(x/scale) + zero, 0, maxq)``, dequantised
``scale * (q - zero)``; two 4-bit codes per byte, even column in the low
nibble.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fsq_constants(levels: list[int], eps: float = 1e-3):
    half = [(L - 1) * (1 - eps) / 2 for L in levels]
    offset = [0.5 if L % 2 == 0 else 0.0 for L in levels]
    shift = [math.tan(o / h) for o, h in zip(offset, half)]
    hw = [L // 2 for L in levels]
    basis = [1]
    for L in levels[:-1]:
        basis.append(basis[-1] * L)
    return half, offset, shift, hw, basis


def fsq_bound(z: Column, level: int, eps: float = 1e-3) -> Column:
    """C4 for one dimension with ``level`` levels."""
    half, offset, shift, _, _ = fsq_constants([level], eps)
    return F.tanh(z.cast("double") + F.lit(shift[0])) * F.lit(half[0]) - F.lit(offset[0])


def fsq_quantize(z: Column, level: int) -> Column:
    """Round half to even of the bound, renormalised by L // 2 (+0.0 kills -0.0)."""
    return F.rint(fsq_bound(z, level)) / F.lit(float(level // 2)) + F.lit(0.0)


def fsq_codes(vec: Column, levels: list[int], codebook: int = 0) -> list[Column]:
    d = len(levels)
    return [fsq_quantize(vec[codebook * d + j], levels[j]) for j in range(d)]


def fsq_codes_to_index(codes: list[Column], levels: list[int]) -> Column:
    """C6 forward: sum((code*hw + hw) * basis)."""
    _, _, _, hw, basis = fsq_constants(levels)
    terms = [(c * F.lit(hw[j]) + F.lit(hw[j])) * F.lit(basis[j]) for j, c in enumerate(codes)]
    return reduce(lambda a, b: a + b, terms).cast("int")


def fsq_index_to_codes(idx: Column, levels: list[int]) -> Column:
    """C6 inverse: ((idx div basis) % L - hw) / hw per dimension, as an array."""
    _, _, _, hw, basis = fsq_constants(levels)
    return F.array(*[((F.floor(idx / basis[j]) % levels[j]) - hw[j]) / F.lit(float(hw[j]))
                     for j in range(len(levels))])


def fsq(vec: Column, levels: list[int], num_codebooks: int) -> tuple[Column, Column]:
    """(codes ARRAY<DOUBLE> of length len(levels)*num_codebooks, indices ARRAY<INT>).
    A vector of another length raises (the reference projects it first)."""
    dim = len(levels) * num_codebooks
    # the guard stands around the results: around the input it would be repeated for every value
    checked = lambda out: F.when(F.size(vec) == dim, out).otherwise(F.raise_error(F.lit(f"fsq needs vectors of {dim} values")))
    codes, idx = [], []
    for c in range(num_codebooks):
        cc = fsq_codes(vec, levels, c)
        codes.extend(cc)
        idx.append(fsq_codes_to_index(cc, levels))
    return checked(F.array(*codes)), checked(F.array(*idx))


def lfq_quantize(vec: Column, scale: float = 1.0) -> Column:
    """+scale where x > 0 else -scale (zero maps to -scale)."""
    return F.transform(vec, lambda x: F.when(x > 0, F.lit(scale)).otherwise(F.lit(-scale)))


def lfq_indices(vec: Column, bits: int, num_codebooks: int) -> Column:
    """Per codebook, bit j = x > 0, index = sum(bit_j << (bits-1-j))."""
    out = []
    for c in range(num_codebooks):
        terms = [F.when(vec[c * bits + j] > 0, F.lit(1 << (bits - 1 - j))).otherwise(F.lit(0)) for j in range(bits)]
        out.append(reduce(lambda a, b: a + b, terms))
    return F.array(*out)


def lfq(vec: Column, codebook_size: int, num_codebooks: int, scale: float = 1.0, activation=None) -> tuple[Column, Column]:
    """(quantised ARRAY<DOUBLE>, indices ARRAY<INT>); ``codebook_size`` must be a power of two.
    ``activation`` (F2): a Column function applied to the quantised values; indices come from the input's signs."""
    bits = codebook_size.bit_length() - 1
    if codebook_size < 2 or 1 << bits != codebook_size:
        raise ValueError("codebook_size must be a power of two")
    q = lfq_quantize(vec, scale)
    return (activation(q) if activation else q), lfq_indices(vec, bits, num_codebooks)


def lfq_index_to_codes(idx: Column, bits: int, scale: float = 1.0) -> Column:
    """Bits of idx (most significant first) -> bit*2*scale - scale."""
    bits_col = [F.floor(idx / (1 << s)) % 2 for s in range(bits - 1, -1, -1)]
    return F.array(*[(b.cast("double") * F.lit(2.0 * scale) - F.lit(scale)) for b in bits_col])


def quantize_weight(x: Column, scale: Column, zero: Column, maxq: int) -> Column:
    """C11: q = clamp(rint(x/scale) + zero, 0, maxq); returns scale * (q - zero)."""
    q = int4_code(x, scale, zero, maxq)
    return scale * (q - zero)


def int4_code(x: Column, scale: Column, zero: Column, maxq: int) -> Column:
    return F.least(F.greatest(F.rint(x / scale) + zero, F.lit(0.0)), F.lit(float(maxq)))


def pack_nibbles(codes: Column, bits: int = 4) -> Column:
    """Array of small codes -> BINARY, ``8 // bits`` codes per byte, code
    c in byte c // per at bit offset ``(c % per) * bits`` (even column = low
    nibble for 4 bits).  Codes are rounded, not truncated."""
    if 8 % bits:
        raise ValueError("8 % bits must be 0")
    per = 8 // bits
    ints = F.transform(codes, lambda x: F.rint(x).cast("int"))
    # code c goes to byte c // per: split by c % per, then zip the parts (linear)
    def lane(k):
        return F.filter(ints, lambda x, i: i % per == k)

    def merge(k):
        return lambda a, b: F.coalesce(a, F.lit(0)).bitwiseOR(F.shiftleft(F.coalesce(b, F.lit(0)), k * bits))

    acc = F.transform(lane(0), lambda x: F.coalesce(x, F.lit(0)))
    for k in range(1, per):
        acc = F.zip_with(acc, lane(k), merge(k))
    return F.unhex(F.array_join(F.transform(acc, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def unpack_nibbles(blob: Column, n: Column | int, bits: int = 4) -> Column:
    """C12 inverse: BINARY -> ``n`` codes."""
    per = 8 // bits
    mask = (1 << bits) - 1
    n = n if isinstance(n, Column) else F.lit(n)
    hx = F.hex(blob)
    byte_vals = F.transform(F.regexp_extract_all(hx, F.lit("(..)"), 1), lambda b: F.conv(b, 16, 10).cast("int"))
    codes = F.flatten(F.transform(byte_vals, lambda v: F.array(
        *[(F.floor(v / (1 << (k * bits))) % (mask + 1)).cast("int") for k in range(per)])))
    return F.slice(codes, 1, n)
