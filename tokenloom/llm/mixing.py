"""Mixing sources to target weights, in DataFrame functions only.

A source's target is its share of ``share`` of all words by its weight, at most
``cap`` times its own words; what is cut off is shared again by weight until no
source is above its cap.  Its documents get hash-random keys, are range-sorted
within the source, and distributed prefix sums of their word counts say which
document meets the budget: whole epochs first, then the documents before the cut
once more, and the exact part of the document at the cut.

1. One pass over the texts writes (id, source, size, key) per document.
2. Totals per source; every round of the sharing is an aggregate over that table.
3. Equal (source, key, size, id) rows are counted first, so that a document
   repeated any number of times is one row of the range sort.  The ranges are
   written, their sums are added up, and only the range's own rows are summed in
   order: no task holds a source.
4. The cut of a source is one row; documents compare themselves with it, so the
   texts are never shuffled.

Rows: null text has no words and is taken for none; a null source is a source of
its own, the last in order; a null id is an id like any other; repeated rows are
one document each, and the cut may fall between them; equal keys are ordered by
size and id; very long texts are counted by one replacement, without an array of
their words; an empty table gives an empty result; further columns play no part
in ``plan`` and are kept by ``mixture``.  The same rows always give the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (3, 1, 2)
#: The mix holds SHARE[0] / SHARE[1] of all words; no source, and no document, more than CAP times its own.
SHARE = (3, 2)
CAP = 2
SEED = 42
_SPACE = "\\x20\\x09-\\x0D"
#: Rows of one range of the sort.
RANGE_ROWS = 1 << 20


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    lead = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{_SPACE}]++", "")
    return F.length(F.regexp_replace(lead, f"[^{_SPACE}]++[{_SPACE}]*+", "x")).cast("long")


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def prefix_sums(rows: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str, out: str) -> DataFrame:
    """``out`` = sum of ``weight`` over the earlier rows of the group: a range sort, written so that its ranges stay
    what they are if a task is repeated; sums of whole ranges, and of the rows of a range."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    ranged = written(rows.repartitionByRange(parts, *group, *order).withColumn("__tl_range", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*group).orderBy("__tl_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(*group, "__tl_range").agg(F.sum(weight).alias("__tl_sum"))
    base = base.withColumn("__tl_base", F.coalesce(F.sum("__tl_sum").over(whole), F.lit(0))).drop("__tl_sum")
    inside = Window.partitionBy(*group, "__tl_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(base, [*group, "__tl_range"]).withColumn(out, F.col("__tl_base") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .drop("__tl_range", "__tl_base"))


def targets(sources: DataFrame, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """(…, target, budget) for (source_size, weight) rows; the level rises while sources are above their caps."""
    whole = lambda c, digits: (F.col(c) if isinstance(c, str) else F.lit(c)).cast(f"decimal({digits},0)")
    total, weights = (int(x or 0) for x in sources.agg(F.sum("source_size"), F.sum("weight")).first())
    level, left = share[0] * total, weights
    while True:
        # weight * level / (share[1] * left) is what a source gets before its cap
        above = whole("weight", 6) * whole(level, 22) > whole(cap * share[1] * left, 16) * whole("source_size", 20)
        capped, weight = (int(x or 0) for x in sources.where(above).agg(F.sum(F.col("source_size") * cap), F.sum("weight")).first())
        if weights - weight == left:
            break
        level, left = share[0] * total - share[1] * capped, weights - weight
    fair = F.col("weight").cast("double") * F.lit(float(level)) / F.lit(float(share[1] * max(left, 1)))
    d = sources.withColumn("target", F.when(above, (F.col("source_size") * cap).cast("double")).otherwise(fair))
    return d.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[int], seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, source, size, key) per document, and one row per source: its target, whole epochs and cut."""
    rows = written(docs.select(F.col(id_col).alias("__tl_id"), F.col(source_col).alias("__tl_source"), n_words(F.col(text_col)).alias("__tl_size"),
                               _key(F.col(id_col), F.col(text_col), seed).alias("__tl_key")), "mix-rows")
    names = rows.groupBy("__tl_source").agg(F.sum("__tl_size").alias("source_size")).withColumn("__tl_one", F.lit(1).cast("long"))
    ranked = prefix_sums(names, [], [F.col("__tl_source").asc_nulls_last()], "__tl_one", "rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = targets(written(ranked.select("__tl_source", "source_size", "rank", weight.alias("weight")), "mix-sources"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    sources = written(sources.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "mix-targets")
    partial = sources.where("rest > 0").select(F.col("__tl_source").alias("__tl_s"), "rank", "rest")
    runs = (rows.where("__tl_size > 0").join(partial, F.col("__tl_source").eqNullSafe(F.col("__tl_s")))
            .groupBy("rank", "rest", "__tl_key", "__tl_size", "__tl_id").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("words", F.col("n") * F.col("__tl_size")))
    starts = prefix_sums(runs, ["rank"], [F.col("__tl_key"), F.col("__tl_size"), F.col("__tl_id")], "words", "start")
    cuts = starts.where("start <= rest AND rest < start + words").select(
        "rank", F.struct("__tl_key", "__tl_size", "__tl_id").alias("cut"), F.col("start").alias("cut_start"), F.col("n").alias("cut_n"))
    return rows, written(sources.join(cuts, "rank", "left").withColumnRenamed("__tl_source", "__tl_s"), "mix-cuts")


def _tuple() -> Column:
    return F.struct("__tl_key", "__tl_size", "__tl_id")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken) per document: words that the mix takes of it, repeats counted."""
    rows, cuts = _planned(docs, id_col, source_col, text_col, weights, seed)
    joined = rows.join(cuts, F.col("__tl_source").eqNullSafe(F.col("__tl_s"))).where(F.col("cut").isNull() | ~F.col("cut").eqNullSafe(_tuple()))
    once = F.when(F.col("cut").isNotNull() & (_tuple() < F.col("cut")), F.col("__tl_size")).otherwise(F.lit(0))
    aside = joined.select(F.col("__tl_id").alias(id_col), F.col("__tl_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("__tl_size") + once).alias("taken"))
    # the equal rows at the cut, one after the other; a run of any length is written out in pieces
    step = 1 << 12
    at = cuts.where("cut IS NOT NULL").withColumn("piece", F.explode(F.expr(f"sequence(0L, (cut_n - 1) div {step})")))
    at = at.withColumn("j", F.explode(F.expr(f"sequence(piece * {step}, least(cut_n, (piece + 1) * {step}) - 1)")))
    size = F.col("cut.__tl_size")
    part = F.least(F.greatest(F.col("rest") - F.col("cut_start") - F.col("j") * size, F.lit(0)), size)
    return aside.unionByName(at.select(F.col("cut.__tl_id").alias(id_col), size.alias("size"), "source_size", "target", (F.col("epochs") * size + part).alias("taken")))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself: the documents' columns once per copy; of the document at a source's cut the last copy
    holds its first words only, joined by one space."""
    _, cuts = _planned(docs, id_col, source_col, text_col, weights, seed)
    marked = (docs.withColumn("__tl_id", F.col(id_col)).withColumn("__tl_size", n_words(F.col(text_col)))
              .withColumn("__tl_key", _key(F.col(id_col), F.col(text_col), seed)))
    slim = cuts.select("__tl_s", F.col("epochs").alias("__tl_epochs"), F.col("rest").alias("__tl_rest"), F.col("cut").alias("__tl_cut"), F.col("cut_start").alias("__tl_start"))
    joined = marked.join(slim, F.col(source_col).eqNullSafe(F.col("__tl_s"))).where("__tl_size > 0")
    before = F.col("__tl_cut").isNotNull() & (_tuple() < F.col("__tl_cut"))
    copies = F.col("__tl_epochs") + before.cast("long")
    whole = joined.withColumn("__tl_n", copies).where("__tl_n > 0")
    edge = joined.where(F.col("__tl_cut").isNotNull() & F.col("__tl_cut").eqNullSafe(_tuple())).dropDuplicates(["__tl_s", "__tl_key", "__tl_size", "__tl_id"])
    edge = edge.withColumn("__tl_words", F.col("__tl_rest") - F.col("__tl_start"))
    more = edge.withColumn("__tl_n", F.expr("__tl_words div __tl_size")).where("__tl_n > 0")
    words = F.split(F.regexp_replace(F.col(text_col), f"^[{_SPACE}]++", ""), f"[{_SPACE}]++")
    cut = edge.where("__tl_words % __tl_size > 0").withColumn(text_col, F.array_join(F.slice(words, F.lit(1), F.expr("__tl_words % __tl_size").cast("int")), " "))
    repeat = lambda d: d.withColumn("__tl_copy", F.explode(F.expr("sequence(1L, __tl_n)"))).select(*docs.columns)
    return repeat(whole).unionByName(repeat(more)).unionByName(cut.select(*docs.columns))


def oracle_sql(seed: int = SEED) -> str:
    """DuckDB SQL for the rows of ``plan`` over ``documents``."""
    return f"""
WITH n AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             CAST(('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(text, ''))), 1, 15)) AS BIGINT) AS key FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
s AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM g),
f AS (SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS w,
        coalesce(sum(2 * source_size) OVER o, 0) AS c0, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS w0 FROM s
      WINDOW o AS (ORDER BY 12 * source_size // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, weight * (3 * t - 2 * c0) > 4 * w0 * source_size AS capped FROM f),
l AS (SELECT *, coalesce(sum(2 * source_size) FILTER (WHERE capped) OVER (), 0) AS c, w - coalesce(sum(weight) FILTER (WHERE capped) OVER (), 0) AS v FROM h),
a AS (SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
        ELSE CAST(weight AS DOUBLE) * CAST(3 * t - 2 * c AS DOUBLE) / CAST(2 * greatest(v, 1) AS DOUBLE) END AS target FROM l),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM a),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n)
SELECT p.doc_id, p.size, e.source_size, e.target,
       CAST(e.epochs * p.size + least(greatest(e.budget - e.epochs * e.source_size - p.start, 0), p.size) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source"""
