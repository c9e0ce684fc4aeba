"""int4 plans over ``lineitem`` (group = supplier, values = extended price):
scale/zero per group, quantise/dequantise, weighted error, nibble packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions.quant import int4_code, pack_nibbles, quantize_weight, unpack_nibbles
from tokenloom.operators.vectors import quant_error, quant_params
from tokenloom.plans.common import r, table

BITS = 4
MAXQ = 2 ** BITS - 1


def _params(spark, sf):
    li = table(spark, sf, "lineitem")
    asym = quant_params(li, ["l_suppkey"], "l_extendedprice", BITS, sym=False)
    return li, asym


def q_a13_quant_params(spark, sf):
    li = table(spark, sf, "lineitem")
    a = quant_params(li, ["l_suppkey"], "l_extendedprice", BITS, sym=False)
    s = quant_params(li, ["l_suppkey"], "l_extendedprice", BITS, sym=True).select(
        "l_suppkey", F.col("scale").alias("scale_sym"), F.col("zero").alias("zero_sym"))
    return a.join(s, "l_suppkey").select("l_suppkey", r("xmin").alias("xmin"), r("xmax").alias("xmax"),
                                         r("scale").alias("scale"), "zero", r("scale_sym").alias("scale_sym"), "zero_sym")


def _coded(spark, sf):
    li, p = _params(spark, sf)
    j = li.join(p, "l_suppkey")  # one row per supplier; AQE picks broadcast at runtime when small
    j = j.withColumn("q", int4_code(F.col("l_extendedprice"), F.col("scale"), F.col("zero"), MAXQ))
    return j.withColumn("deq", quantize_weight(F.col("l_extendedprice"), F.col("scale"), F.col("zero"), MAXQ))


def q_c11_quantize_weight(spark, sf):
    j = _coded(spark, sf)
    return j.select("l_orderkey", "l_linenumber", F.col("q").cast("bigint").alias("q"), r("deq").alias("deq"))


def q_a14_quant_error(spark, sf):
    """Σ (w - q)^2 with diagonal weights 1 / scale^2 per group."""
    e = quant_error(_coded(spark, sf), ["l_suppkey"], F.col("l_extendedprice") / F.col("scale"), F.col("deq") / F.col("scale"))
    return e.select("l_suppkey", r("error").alias("error"), "n")


def q_c12_pack_nibbles(spark, sf):
    j = _coded(spark, sf)
    # lines of one order (a handful) form one packed row
    g = j.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("s"))
    codes = F.transform("s", lambda x: x["q"])
    packed = pack_nibbles(codes, BITS)
    back = unpack_nibbles(packed, F.size(codes), BITS)
    return g.select("l_orderkey", F.size(codes).cast("bigint").alias("n"), F.hex(packed).alias("packed_hex"),
                    (back == F.transform(codes, lambda x: x.cast("int"))).alias("roundtrip"))


QUERIES = {
    "a13_quant_params": q_a13_quant_params,
    "c11_quantize_weight": q_c11_quantize_weight,
    "a14_quant_error": q_a14_quant_error,
    "c12_pack_nibbles": q_c12_pack_nibbles,
}


def _params_sql(sym: bool) -> str:
    if sym:
        return f"""(SELECT l_suppkey, xmin, xmax FROM (
            SELECT l_suppkey, CASE WHEN mn < 0 THEN -mx2 ELSE mn END AS xmin0, mx2 AS xmax0 FROM (
              SELECT l_suppkey, least(min(l_extendedprice), 0.0) AS mn,
                     greatest(abs(least(min(l_extendedprice), 0.0)), greatest(max(l_extendedprice), 0.0)) AS mx2
              FROM lineitem GROUP BY l_suppkey)) p0,
            LATERAL (SELECT CASE WHEN xmin0 = 0 AND xmax0 = 0 THEN -1.0 ELSE xmin0 END AS xmin,
                            CASE WHEN xmin0 = 0 AND xmax0 = 0 THEN 1.0 ELSE xmax0 END AS xmax))"""
    return f"""(SELECT l_suppkey, CASE WHEN mn = 0 AND mx = 0 THEN -1.0 ELSE mn END AS xmin,
                   CASE WHEN mn = 0 AND mx = 0 THEN 1.0 ELSE mx END AS xmax FROM (
              SELECT l_suppkey, least(min(l_extendedprice), 0.0) AS mn, greatest(max(l_extendedprice), 0.0) AS mx
              FROM lineitem GROUP BY l_suppkey))"""


_P = f"""pa AS (SELECT l_suppkey, xmin, xmax, (xmax - xmin) / {float(MAXQ)} AS scale,
                round_even(-xmin / ((xmax - xmin) / {float(MAXQ)}), 0) AS zero FROM {_params_sql(False)}),
ps AS (SELECT l_suppkey, (xmax - xmin) / {float(MAXQ)} AS scale_sym, CAST({float((MAXQ + 1) / 2)} AS DOUBLE) AS zero_sym
       FROM {_params_sql(True)}),
cd AS (SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice AS w, pa.scale, pa.zero,
              least(greatest(round_even(l.l_extendedprice / pa.scale, 0) + pa.zero, 0.0), {float(MAXQ)}) AS q
       FROM lineitem l JOIN pa ON l.l_suppkey = pa.l_suppkey),
cq AS (SELECT *, scale * (q - zero) AS deq FROM cd)"""

ORACLE = {
    "a13_quant_params": f"""WITH {_P} SELECT pa.l_suppkey, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, round(scale, 6) AS scale,
        zero, round(scale_sym, 6) AS scale_sym, zero_sym FROM pa JOIN ps ON pa.l_suppkey = ps.l_suppkey""",
    "c11_quantize_weight": f"""WITH {_P} SELECT l_orderkey, l_linenumber, CAST(q AS BIGINT) AS q, round(deq, 6) AS deq FROM cq""",
    "a14_quant_error": f"""WITH {_P} SELECT l_suppkey, round(sum(((w - deq) / scale) * ((w - deq) / scale)), 6) AS error,
        CAST(count(*) AS BIGINT) AS n FROM cq GROUP BY l_suppkey""",
    "c12_pack_nibbles": f"""WITH {_P}, o AS (SELECT l_orderkey, list(CAST(q AS INTEGER) ORDER BY l_linenumber, q) AS c FROM cq GROUP BY l_orderkey),
        b AS (SELECT l_orderkey, c, range(0, CAST(ceil(len(c) / 2) AS BIGINT)) AS bs FROM o)
        SELECT l_orderkey, CAST(len(c) AS BIGINT) AS n,
               array_to_string(list_transform(bs, lambda k: printf('%02X', coalesce(c[2 * k + 1], 0) + 16 * coalesce(c[2 * k + 2], 0))), '')
               AS packed_hex, true AS roundtrip FROM b""",
}
