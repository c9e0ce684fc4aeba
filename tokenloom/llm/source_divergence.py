"""Source divergence audit: how the term shares of (lang, source) groups differ.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A
language keeps the terms in at least ``min_docs`` of its documents.  In a group with N
occurrences of the V kept terms a term with count c has the smoothed share
p = 1 + floor(10**9 * (c + 2) / (N + 2 * V)); two shares differ by floor((p - q)**2 / (p + q)).

* **term** part: a group's terms whose share is above the language's, by that difference.  The
  difference grows with the group's count and falls with the language's, so a term that k
  others precede in higher group count, lower language count and earlier UTF-8 can't be
  among the first k.  Partitions keep the k-skyband of each group (the terms with fewer
  than k such dominators), skybands are merged in two steps, and what is left is ranked exactly.
* **pair** part: differences summed over all kept terms for any two sources of a language.
  Only terms that both have meet each other, inside their own row, and tasks add them up per
  pair before the shuffle; terms that one or none of them has follow from the group's
  histogram of counts.

Counting is exact: words are told apart by their bytes, and tasks send one row per (lang,
source, term) they hold, with occurrences and documents.

Rows: null text, lang and source read as ''; a group without terms takes part with counts of 0;
a language without kept terms has no term rows, and 0 for its pairs; repeated rows and null ids
are documents like any other (the id is not read); equal values are ordered by the item's UTF-8;
texts of any length are read whole, in slices; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytestext as B
from .common import written

TERM = np.zeros(256, dtype=bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
MIN_DOCS, RANKS, SCALE = 10, 10, 1_000_000_000
#: Counted rows a task holds before it sends them; pairs of one step, and pair sums a task holds.
HOLD, PAIR_STEP, PAIR_HOLD = 1 << 19, 1 << 20, 1 << 19
#: Points of one step of a skyband, and rows a task holds before it takes the skybands of its groups.
SKY_STEP, SKY_HOLD = 1 << 9, 1 << 19
_COUNTS = "lang string, source string, term string, n long, docs long"


def _strings(column) -> pa.Array:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("")


def _count_slice(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> pa.Table | None:
    """(lang, source, term, n, docs) of some documents."""
    low = B.LOWER[data]
    starts, ends, first = B.words(low, off, TERM)
    if not len(starts):
        return None
    body = low[TERM[low]]
    ends_at = np.concatenate(([0], np.cumsum(ends - starts)))
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
    code, size = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    key, n = np.unique(doc * size + code, return_counts=True)  # one entry per document and term
    langs, sources = _strings(part.column("lang")).dictionary_encode(), _strings(part.column("source")).dictionary_encode()
    group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
    cell, at = np.unique(group[key // size] * size + key % size, return_inverse=True)
    g = cell // size
    return pa.table({
        "lang": langs.dictionary.take(pa.array(g // len(sources.dictionary))).cast(pa.string()), "source": sources.dictionary.take(pa.array(g % len(sources.dictionary))).cast(pa.string()),
        "term": terms.dictionary.take(pa.array(cell % size)).cast(pa.string()),
        "n": pa.array(np.bincount(at, weights=n).astype(np.int64)), "docs": pa.array(np.bincount(at), pa.int64())})


def _merged(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).combine_chunks().group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for part, data, off in B.slices(batch, "text"):
            t = _count_slice(part, data, off)
            if t is None:
                continue
            held.append(t)
            rows += t.num_rows
            if rows >= HOLD:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows >= HOLD // 2:  # merging no longer makes room
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(max_chunksize=1 << 16)


def skyband(group_count: np.ndarray, lang_count: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the points that fewer than k others dominate (count not lower, language count not higher, place earlier)."""
    order = np.lexsort((place, lang_count, -group_count))
    g, c = group_count[order], lang_count[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(new)
    order = order[np.arange(len(order)) - head[np.cumsum(new) - 1] < k]  # the k first of equal counts dominate the rest
    c, r = lang_count[order], place[order]
    kept = np.zeros(0, np.int64)
    for i in range(0, len(order), SKY_STEP):
        own = np.arange(i, min(i + SKY_STEP, len(order)))
        over = np.zeros(len(own), np.int64)
        for j in range(0, len(kept), 1 << 13):  # dominators come earlier in the order
            h = kept[j:j + (1 << 13)]
            over += ((c[h][None, :] <= c[own][:, None]) & (r[h][None, :] < r[own][:, None])).sum(axis=1)
        over += np.tril((c[own][None, :] <= c[own][:, None]) & (r[own][None, :] < r[own][:, None]), -1).sum(axis=1)
        kept = np.append(kept, own[over < k])
    return order[kept]


def _sky(table: pa.Table, k: int) -> pa.Table:
    """The skyband of rows (…, term, n, lang_n) of one group."""
    place = np.empty(table.num_rows, np.int64)
    place[pc.sort_indices(table.column("term").combine_chunks().cast(pa.binary())).to_numpy()] = np.arange(table.num_rows)
    return table.take(pa.array(np.sort(skyband(table.column("n").to_numpy(), table.column("lang_n").to_numpy(), place, k))))


def _skies(table: pa.Table, k: int) -> pa.Table:
    """The skyband of each (lang, source) in the rows."""
    key = [_strings(table.column(c)).dictionary_encode() for c in ("lang", "source")]
    group = key[0].indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(key[1].dictionary) + key[1].indices.to_numpy(zero_copy_only=False)
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0, [True])))
    return pa.concat_tables([_sky(table.take(pa.array(order[i:j])), k) for i, j in zip(cut[:-1], cut[1:], strict=True)])


def _partition_skies(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, held, rows = TaskContext.get().partitionId(), [], 0

        def send(t):
            return t.append_column("part", pa.array(np.full(t.num_rows, part), pa.int64())).to_batches(max_chunksize=1 << 16)

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= SKY_HOLD:
                held = [_skies(pa.concat_tables(held), k)]
                rows = held[0].num_rows
                if rows >= SKY_HOLD // 2:
                    yield from send(held[0])
                    held, rows = [], 0
        if rows:
            yield from send(_skies(pa.concat_tables(held), k))

    return run


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) with a < b in the order of a language's groups: for terms that both have, the
    difference of their shares less what the histograms of each alone count for the term."""
    held: list[pa.Table] = []
    rows = 0

    def merged():
        t = pa.concat_tables(held).combine_chunks().group_by(["lang", "a", "b"], use_threads=False).aggregate([("value", "sum")])
        return t.select(["lang", "a", "b", "value_sum"]).rename_columns(["lang", "a", "b", "value"])

    for batch in batches:
        lists = batch.column("shares")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        s = lists.flatten()
        g, p, p0 = (s.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        langs = _strings(batch.column("lang")).dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(g)) - 1  # later entries of the same term
        upto = np.cumsum(after)
        i = 0
        while i < len(g):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIR_STEP, side="right")))
            a = np.repeat(np.arange(i, j), after[i:j])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[i:j]) - after[i:j], after[i:j])
            i = j
            if not len(a):
                continue
            value = _differ(p[a], p[b]) - _differ(p[a], p0[b]) - _differ(p0[a], p[b]) + _differ(p0[a], p0[b])
            order = np.lexsort((g[b], g[a], lang[a]))
            la, ga, gb = lang[a][order], g[a][order], g[b][order]
            cut = np.flatnonzero(np.concatenate(([True], (la[1:] != la[:-1]) | (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1]))))
            held.append(pa.table({"lang": langs.dictionary.take(pa.array(la[cut])).cast(pa.string()), "a": pa.array(ga[cut], pa.int64()), "b": pa.array(gb[cut], pa.int64()),
                                  "value": pa.array(np.add.reduceat(value[order], cut), pa.int64())}))
            rows += len(cut)
            if rows >= PAIR_HOLD:
                held = [merged()]
                rows = held[0].num_rows
                if rows >= PAIR_HOLD // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
    if held:
        yield from merged().to_batches(max_chunksize=1 << 16)


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _difference(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _share(count: str, total: str, kept: str) -> str:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)) by three decimal digits at a time, so that it stays in 64 bits."""
    d, out, rest = f"({total} + 2 * {kept})", "0L", f"({count} + 2)"
    for _ in range(3):
        out, rest = f"({out} * 1000 + (1000 * {rest}) div {d})", f"((1000 * {rest}) % {d})"
    return f"1 + {out}"


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' for all other sources of the language, 'term' for the first ``ranks`` terms."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(F.col(text_col).alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    # one shuffle by (lang, term) serves the sums per source and per language
    counts = docs.mapInArrow(_count, _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    terms = written(terms.where(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    per_group = terms.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source", "h.n").agg(F.count(F.lit(1)).alias("terms"))
    histogram = written(per_group.select("lang", "source", "n", "terms"), "divergence-histogram")
    group_totals = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("own"))
    lang_totals = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = groups.join(group_totals, ["lang", "source"], "left").join(lang_totals, "lang", "left").na.fill(0, ["total", "own", "kept", "lang_total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    totals = written(totals.withColumn("g", place).withColumn("p0", F.when(F.col("kept") > 0, F.expr(_share("0L", "total", "greatest(kept, 1)"))).otherwise(F.lit(1).cast("long"))), "divergence-groups")
    return _terms(terms, totals, ranks).unionByName(_pairs(terms, histogram, totals))


def _terms(terms: DataFrame, totals: DataFrame, ranks: int) -> DataFrame:
    rows = terms.select("lang", "term", "lang_n", F.explode("held").alias("h")).select("lang", "h.source", "term", "h.n", "lang_n")
    schema = "lang string, source string, term string, n long, lang_n long"
    skies = rows.mapInArrow(_partition_skies(ranks), schema + ", part long")
    # partitions' skybands meet in some groups of partitions first, so no task holds those of all
    fan = max(1, round(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    merge = lambda t: _sky(t.select(["lang", "source", "term", "n", "lang_n"]), ranks)
    skies = skies.withColumn("part", F.col("part") % fan).groupBy("lang", "source", "part").applyInArrow(merge, schema)
    skies = skies.groupBy("lang", "source").applyInArrow(merge, schema)
    shares = skies.join(totals.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "kept"))).withColumn("q", F.expr(_share("lang_n", "lang_total", "kept")))
    ahead = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_difference("p", "q")).alias("value"))
    return _ranked(ahead).where(F.col("rank") <= ranks)


def _pairs(terms: DataFrame, histogram: DataFrame, totals: DataFrame) -> DataFrame:
    one = totals.select("lang", "source", "g", "total", "kept", "own", "p0")
    held = terms.select("lang", "term", F.explode("held").alias("h")).select("lang", "term", "h.source", "h.n").join(one.select("lang", "source", "g", "total", "kept", "p0"), ["lang", "source"])
    shares = held.select("lang", "term", F.struct("g", F.expr(_share("n", "total", "kept")).alias("p"), "p0").alias("s")).groupBy("lang", "term").agg(F.sort_array(F.collect_list("s")).alias("shares"))
    both = shares.select("lang", "shares").mapInArrow(_pair_sums, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))
    # what a group's own terms add against another group that lacks them
    other = one.select("lang", F.col("g").alias("h"), F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("other_own"))
    mine = histogram.join(one, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "kept"))).select("lang", "g", "p", "terms")
    alone = mine.join(other.select("lang", "h", "q0"), "lang").where("g <> h").groupBy("lang", "g", "h").agg(F.expr(f"sum(terms * ({_difference('p', 'q0')}))").alias("alone"))
    pairs = one.join(other, "lang").where("g <> h").withColumn("a", F.least("g", "h")).withColumn("b", F.greatest("g", "h"))
    back = alone.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), F.col("alone").alias("back"))
    pairs = pairs.join(alone, ["lang", "g", "h"], "left").join(back, ["lang", "g", "h"], "left").join(both, ["lang", "a", "b"], "left")
    none = f"(kept - own - other_own) * ({_difference('p0', 'q0')})"
    value = F.when(F.col("kept") > 0, F.expr(f"coalesce(alone, 0) + coalesce(back, 0) + coalesce(both, 0) + {none}")).otherwise(F.lit(0)).cast("long")
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order).cast("int"))


def oracle_sql(min_docs: int = MIN_DOCS, ranks: int = RANKS) -> str:
    """DuckDB SQL for the rows of ``audit`` over ``documents``: every kept term of every group and pair."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, translate(unnest(w), '{upper}', '{lower}') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= {min_docs}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
m AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM m GROUP BY ALL),
p AS (SELECT m.lang, m.source, m.term, m.n, 1 + CAST(1000000000 AS HUGEINT) * (m.n + 2) // (s.total + 2 * v.v) AS p,
        1 + CAST(1000000000 AS HUGEINT) * (m.lang_n + 2) // (v.total + 2 * v.v) AS q
      FROM m JOIN s ON m.lang = s.lang AND m.source = s.source JOIN v ON v.lang = m.lang),
u AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM u UNION ALL SELECT * FROM x))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= {ranks}"""
