"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask over a span of words; only its care positions are
hashed, so substitutions at the others do not matter.  Seeds of every position
of every text are joined with those of the benchmark items; around a hit ``WINDOW``
words of the item (``BEFORE`` of them before the seed, or the whole of a shorter item) are laid
along the text and those that agree are counted, at substituted places too.  A text
overlaps an item when ``SHARE`` of some window agrees.  Agreement by chance far from the
hit does not count, however long the item.

Hits are verified where they arise, in the task that holds the text: neither
texts nor seeds are shuffled, only (document, item, agreement) rows after a
partial aggregation.  Texts are cut into pieces of ``PIECE`` positions (with the words around
them that windows need) and a hit's row holds the words of its two windows: Spark keeps
all rows that generated code makes of one row it reads, so with whole texts a text's hits
times its words would be in memory at once.  Items are cut into parts of ``PART_WORDS`` words
likewise, and the seeds of parts are broadcast in blocks of about
``BLOCK_WORDS`` item words, so a larger benchmark or a longer item means more passes, not a
larger broadcast.

Words: lower case, ASCII marks are separators.  Null texts, and items without
id or text, take no part; items or texts shorter than the span have no seeds and match
nothing; items that repeat an id count as one; documents that share an id (or a
null one) are reported as one; empty tables give an empty result; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Care positions of the masks (span 9, six words each); fixed parameters of the operator.
MASKS = ((0, 1, 3, 4, 6, 8), (0, 2, 4, 5, 7, 8), (0, 1, 2, 4, 7, 8))
SPAN = 9
SHARE = 0.6
WINDOW, BEFORE = 20, 5
#: Words that a window may have before its seed: ``BEFORE``, or more at an item's end.
LEAD = max(BEFORE, WINDOW - SPAN)
PIECE = 128
PART_WORDS = 2_000
BLOCK_WORDS = 100_000

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(text), MARKS, " " * len(MARKS)), " "), "")


def _pieces(texts: DataFrame) -> DataFrame:
    """(id, w, from, to): the words of a piece and around it, and its first and last position in them.

    The lambda keeps the pieces out of the generated code that makes their seeds, which so reads them one by one."""
    piece = lambda at: F.struct(F.least(at, F.lit(LEAD)).alias("from"), F.slice("w", F.greatest(at - LEAD, F.lit(0)) + 1, F.lit(LEAD + PIECE + WINDOW)).alias("w"))
    cut = texts.where(F.size("w") >= SPAN).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - SPAN, F.lit(PIECE)), piece)).alias("piece"))
    return cut.select("id", "piece.w", "piece.from", F.least(F.col("piece.from") + PIECE - 1, F.size("piece.w") - SPAN).alias("to"))


def _seeds(df: DataFrame, at: str, first: Column, last: Column) -> DataFrame:
    """Positions ``first`` to ``last`` of the word array ``w`` with every mask's hash."""
    placed = df.withColumn(at, F.explode(F.sequence(first, last)))
    hashes = [F.xxhash64(F.lit(k), *[F.get("w", F.col(at) + o) for o in mask]) for k, mask in enumerate(MASKS)]
    return placed.withColumn("seed", F.explode(F.array(*hashes)))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, agreeing words of the best window, item words) of every text that overlaps an item."""
    items = (benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item_col).alias("item")).agg(F.min(item_text).alias("t"))
             .select("item", words(F.col("t")).alias("w")).where(F.size("w") >= SPAN))
    total = items.agg(F.sum(F.size("w"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    part = lambda at: F.floor(F.col(at) / PART_WORDS).cast("int")
    base = F.greatest(F.col("part") * PART_WORDS - WINDOW, F.lit(0))
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PART_WORDS).cast("int"))))
    parts = parts.select("item", "part", F.size("w").alias("item_words"), base.alias("base"), F.slice("w", base + 1, F.lit(PART_WORDS + SPAN + 2 * WINDOW)).alias("iw"))
    seeds = _seeds(items, "j", F.lit(0), F.size("w") - SPAN).select("seed", "item", "j", part("j").alias("part")).distinct()
    texts = _pieces(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")))
    own = F.pmod(F.xxhash64("item", "part"), F.lit(blocks))
    length = F.least(F.col("item_words"), F.lit(WINDOW))
    first = F.greatest(F.least(F.col("j") - BEFORE, F.col("item_words") - WINDOW), F.lit(0))
    # the words of both windows, without those that would stand before the text; those after it are null when laid side by side
    gone = F.greatest(F.col("j") - F.col("lo") - F.col("i"), F.lit(0))
    windows = F.inline(F.array(F.struct(F.slice("w", F.col("i") - F.col("j") + F.col("lo") + gone + 1, length - gone).alias("tw"),
                                        F.slice("iw", F.col("lo") - F.col("base") + gone + 1, length - gone).alias("bw"))))
    agree = F.size(F.filter(F.zip_with("tw", "bw", lambda x, y: x == y), lambda same: same))
    found = []
    for b in range(blocks):
        hits = (_seeds(texts, "i", F.col("from"), F.col("to")).join(F.broadcast(seeds.where(own == b)), "seed")
                .join(F.broadcast(parts.where(own == b)), ["item", "part"]).withColumn("lo", first))
        best = (hits.select("id", "item", "item_words", windows).select("id", "item", "item_words", agree.alias("agree"))
                .where(F.col("agree") >= F.ceil(length * SHARE))
                .groupBy("id", "item", "item_words").agg(F.max("agree").alias("agree")))
        found.append(best if blocks == 1 else written(best, "overlaps"))  # pass by pass: one plan would hold the broadcasts of all blocks at once
    # an item's parts may lie in several blocks
    out = found[0] if blocks == 1 else reduce(DataFrame.unionByName, found).groupBy("id", "item", "item_words").agg(F.max("agree").alias("agree"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("agree").alias("agreeing_words"), "item_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """(id, n_items, first_item, best agreement) of every contaminated document."""
    return (overlaps(docs, benchmark, id_col, **columns).groupBy(id_col)
            .agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"), F.max("agreeing_words").alias("agreeing_words")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The documents that overlap no item."""
    bad = contaminated(docs, benchmark, id_col, **columns).select(F.col(id_col).alias("__tl_bad"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__tl_bad"]), "left_anti")


def oracle_sql() -> str:
    """The same rows in DuckDB SQL (seeds as word tuples, verified on the diagonal)."""
    marks = MARKS.replace("'", "''")
    chars = "".join(f"\\x{ord(c):02x}" for c in marks.replace("''", "'"))
    words_sql = "list_filter(string_split(regexp_replace(lower(text), '[" + chars + "]', ' ', 'g'), ' '), lambda x: x <> '')"
    seed = " UNION ALL ".join("SELECT {id}, {at}, w, " + f"{k} AS mask, " + " || ' ' || ".join(f"w[{{at}} + {o + 1}]" for o in mask) + " AS seed FROM {src}" for k, mask in enumerate(MASKS))
    return f"""
WITH dw AS (SELECT doc_id, {words_sql} AS w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT item_id, {words_sql} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM dw WHERE len(w) >= {SPAN}),
bp AS (SELECT item_id, w, unnest(range(0, len(w) - {SPAN - 1})) AS j FROM bw WHERE len(w) >= {SPAN}),
ds AS ({seed.format(id="doc_id", at="i", src="dp")}),
bs AS ({seed.format(id="item_id", at="j", src="bp")}),
hit AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.i - bs.j AS shift, bs.j FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed),
win AS (SELECT hit.*, dw.w, bw.w AS iw, greatest(least(j - {BEFORE}, len(bw.w) - {WINDOW}), 0) AS lo, least(len(bw.w), {WINDOW}) AS n
        FROM hit JOIN dw USING (doc_id) JOIN bw USING (item_id)),
v AS (SELECT doc_id, item_id, n, len(list_filter(range(lo, lo + n), lambda k: shift + k >= 0 AND w[shift + k + 1] = iw[k + 1])) AS agree FROM win),
ok AS (SELECT doc_id, item_id, max(agree) AS agree FROM v WHERE agree >= ceil(n * {SHARE}) GROUP BY ALL)
SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, CAST(max(agree) AS INTEGER) AS agreeing_words FROM ok GROUP BY doc_id"""
