"""Shared pieces of the plan catalog: table access, output normalisation and
the SQL fragments the DuckDB oracles reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
VAL_SIZE = 0.05
CHUNK = 4096
SEP = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table.  ``spark.tokenloom.inputPartitions`` (a setting of the
    session, unset by default) deals the scan to that many partitions, for files of a single row group."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get("spark.tokenloom.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ids_md5(c: Column | str) -> Column:
    return F.md5(F.array_join(F.col(c) if isinstance(c, str) else c, ","))


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def h_sql(*parts: str, seed: int = SEED) -> str:
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {args})), 1, 12)) AS BIGINT)"


def u_sql(*parts: str, seed: int = SEED) -> str:
    return f"((CAST({h_sql(*parts, seed=seed)} AS DOUBLE) + 0.5) / 281474976710656.0)"


# documents with the seeded split, as the Spark ``split`` operator assigns it
SPLIT_CTE = f"""
d0 AS (SELECT doc_id, text, lang, source, {h_sql('doc_id')} AS h FROM documents),
d1 AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) - 1 AS rk, count(*) OVER () AS n FROM d0),
ds AS (SELECT doc_id, text, lang, source, h, rk,
              CASE WHEN rk < ceil({VAL_SIZE} * n) THEN 'val' ELSE 'train' END AS split FROM d1)"""


def byte_ids_sql(text: str, eos: bool = True, bos: bool = False) -> str:
    """DuckDB list of byte-tokenizer ids of ``text`` (needs hx/l columns
    computed in a sub-select: hex(encode(text)) and octet_length)."""
    body = "list_transform(range(0, l), lambda i: CAST(('0x' || substr(hx, 2 * i + 1, 2)) AS INTEGER) + 3)"
    if bos:
        body = f"list_concat([1], {body})"
    if eos:
        body = f"list_concat({body}, [2])"
    return body


def list_md5_sql(lst: str) -> str:
    return f"md5(array_to_string({lst}, ','))"


# token positions of the packed train/val streams (one row per token; oracle only)
STREAM_CTE = SPLIT_CTE + """,
sx AS (SELECT split, doc_id, h, hex(encode(text)) AS hx, octet_length(encode(text)) AS l FROM ds),
so AS (SELECT *, coalesce(sum(l + 1) OVER (PARTITION BY split ORDER BY h, doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM sx),
st1 AS (SELECT split, st, l, hx, unnest(range(1, l + 2)) AS i FROM so),
tokens AS (SELECT split, st + i - 1 AS pos,
             CASE WHEN i = l + 1 THEN 2 ELSE CAST(('0x' || substr(hx, 2 * i - 1, 2)) AS INTEGER) + 3 END AS id
           FROM st1)"""
