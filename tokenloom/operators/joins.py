"""Lookups, draw fetches, request cache and keyed overlay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_tokens(df: DataFrame, vocab: DataFrame, token_col: str = "token", how: str = "left") -> DataFrame:
    """Piece -> id, an equi-join; the planner broadcasts the vocabulary
    when its measured size is below ``spark.sql.autoBroadcastJoinThreshold``."""
    return df.join(vocab.select(F.col("token").alias(token_col), "id"), token_col, how)


def fetch_draws(draws: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join of draws to rows on rank / (source, rank) / chunk id.
    Repeated draws of a hot row stay correct; AQE splits skewed partitions."""
    return draws.join(rows, keys)


def with_cache(requests: DataFrame, cache: DataFrame, key: str,
               compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hits come from the cache (semi/inner), misses (left-anti) are
    computed; the union of both, with ``from_cache`` flag."""
    hits = requests.join(cache, key, "inner").withColumn("from_cache", F.lit(True))
    misses = compute(requests.join(cache.select(key), key, "left_anti")).withColumn("from_cache", F.lit(False))
    return hits.unionByName(misses)


def overlay(base: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed overlay, right wins: full outer join, the patch value
    replaces the base value whenever the patch has the key."""
    b = base.select(F.col(key), F.col(value).alias("_bv"))
    p = patch.select(F.col(key), F.col(value).alias("_pv"), F.lit(True).alias("_present"))
    j = b.join(p, key, "full")
    return j.select(key, F.when(F.col("_present"), F.col("_pv")).otherwise(F.col("_bv")).alias(value),
                    F.coalesce(F.col("_present"), F.lit(False)).alias("patched"))
