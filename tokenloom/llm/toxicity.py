"""Toxicity by class-conditional Kneser-Ney models over words.

Two interpolated bigram models, one of toxic and one of ordinary training
texts, share their lowest order: the word distribution of the whole corpus.

    P_c(w | v) = max(c_c(v w) - D, 0) / c_c(v .) + L_c(v) P_c(w)
    P_c(w)     = max(N_c(. w) - D, 0) / N_c(. .) + L_c P(w),   P(w) = (count(w) + 1) / (total + words)

c counts pairs in the training texts, N counts the distinct left neighbours
of a word (Kneser-Ney continuation counts) and L is the mass that is left.  The first
terms are kept for expressions that are typical of one of the classes (``EVIDENCE``,
``RATIO``), toxic or ordinary; all others, the rare ones above all, back off to the shared
counts, which cancel.  Words without a term of their own pass through one more backoff, a
Kneser-Ney distribution of their stems (first ``STEM`` bytes), so that unseen
forms of a known expression count.  A text's feature is the mean over its words
of log P_toxic - log P_ordinary, above that of a plain word at the same place; a one-feature
logistic regression on training texts kept out of the counts turns it into a score.

What is gathered: word counts of all texts (they grow with the corpus and stay
distributed), pair counts of a bounded sample of labelled texts
(``SAMPLE`` per class, at most ``SAMPLE_WORDS`` words of them in all).  The score table holds
only kept expressions of the sample: its size is bounded by the sample, so
every task may hold it.

Rows: null and empty texts have feature 0; labels that repeat an id count as
toxic if any is; null labels and ids are not learnt from; with fewer than two
classes of labels, every score is the share of toxic labels (0 without any); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as B
from .common import written

#: Labelled training texts per class (an expected number: a hash of the id picks them), and the
#: words of them that may be counted in all.
SAMPLE = 3000
SAMPLE_WORDS = 4_000_000
#: Expressions have a class term if texts of the two classes hold them differently (G squared of at
#: least EVIDENCE) and those of one class at least RATIO times as often; the others are left to the shared backoff.
EVIDENCE = 24.0
RATIO = 3.0
#: Bytes of a word's stem (words no longer have none), and the step of the score's feature.
STEM = 4
STEP = 1e-3
#: One in so many sampled texts calibrates the score and is not counted.
FOLDS = 4
_TASK_WORDS = 1 << 20
_COUNTS = ["kind", "l", "r", "bad", "good", "bad_texts", "good_texts"]


def held_out(id_col: str = "doc_id", folds: int = 5, rest: int = 0):
    """crc32 of the id as text leaves the remainder ``rest``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == F.lit(rest)


def _tokens(data, off):
    data = B.LOWER[data]
    starts, ends, first = B.words(data, off, B.ALNUM)
    return B.word_hashes(data, starts, ends), first


def _stems(data, off):
    """Stem hash per word, 0 for words without one."""
    data = B.LOWER[data]
    starts, ends, _ = B.words(data, off, B.ALNUM)
    stem = B.mix(B.poly_hash(data, starts, np.minimum(ends, starts + STEM), B._B2))
    stem[ends - starts <= STEM] = 0
    return stem


def _pairs(w, first):
    """(left, right) word hashes of neighbouring words; a text opens with hash 0."""
    left = np.concatenate(([np.uint64(0)], w[:-1])) if len(w) else w
    left[first[:-1][first[:-1] < first[1:]]] = 0
    return left, w


def _pair_key(left, right):
    return B.mix(left * np.uint64(B._B1) + right)


def _word_counts(text_col):
    """Partial (word, count) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for _, data, off in B.slices(batch, text_col):
                w, _ = _tokens(data, off)
                held.append(w)
                n += len(w)
                if n >= _TASK_WORDS:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return run


def _pair_counts(text_col):
    """Per class, counts of pairs and of the texts that hold them; and the same of words (kind 1) and
    of words' stems (kind 2), left 0."""

    def kinds_of(keys, doc, toxic):
        order = np.lexsort((doc, *keys))
        keys, doc = [k[order] for k in keys], doc[order]
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(doc) else np.zeros(0, bool)
        at = np.flatnonzero(np.concatenate(([True], change)))
        text = np.flatnonzero(np.concatenate(([True], change | (doc[1:] != doc[:-1]))))
        bad, n = np.add.reduceat(toxic[doc], at), np.diff(np.append(at, len(doc)))
        per = np.searchsorted(text, np.append(at, len(doc)))
        bad_texts, texts = np.add.reduceat(toxic[doc[text]], per[:-1]), np.diff(per)
        return [k[at].view(np.int64) for k in keys], bad, n - bad, bad_texts, texts - bad_texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in B.slices(batch, text_col):
                w, first = _tokens(data, off)
                if not len(w):
                    continue
                left, right = _pairs(w, first)
                toxic = part.column("toxic").to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                (r, l), *counts = kinds_of([right, left], doc, toxic)
                (one,), *alone = kinds_of([right], doc, toxic)
                (stem,), *stems = kinds_of([_stems(data, off)], doc, toxic)
                kind = np.repeat([0, 1, 2], [len(r), len(one), len(stem)]).astype(np.int32)
                none = np.zeros(len(one) + len(stem), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, np.concatenate([l, none]), np.concatenate([r, one, stem]), *(np.concatenate(c) for c in zip(counts, alone, stems, strict=True)))],
                                                 names=_COUNTS)

    return run


def strong(sizes: dict[int, int]):
    """Whether an expression has a class term: G squared of holding it or not against the class of the
    text, from ``bad_texts`` and ``good_texts``, and the ratio of the rates; ``sizes``: texts per class."""
    bad, good = float(sizes[1]), float(sizes[0])
    b, g = F.col("bad_texts").cast("double"), F.col("good_texts").cast("double")
    term = lambda n, share, row: F.when(n > 0, n * F.log(n / (row * share))).otherwise(0.0)
    shares = bad / (bad + good), good / (bad + good)
    held, rest = b + g, F.lit(bad + good) - b - g
    g2 = 2 * (term(b, shares[0], held) + term(g, shares[1], held) + term(bad - b, shares[0], rest) + term(good - g, shares[1], rest))
    return (g2 >= EVIDENCE) & ((b * good >= RATIO * g * bad) | (g * bad >= RATIO * b * good))


def kept_tables(counts: DataFrame, shared: DataFrame, sizes: dict[int, int]):
    """(words, pairs, stems, totals) that the score table needs: kept expressions and sums, nothing else leaves Spark."""
    keep = strong(sizes)
    pairs, words, stems = (counts.where(f"kind = {k}") for k in range(3))
    by_word = pairs.groupBy("r").agg(F.count_if(F.col("bad") > 0).alias("nb"), F.count_if(F.col("good") > 0).alias("ng"))
    by_context = pairs.groupBy("l").agg(F.sum("bad").alias("size_bad"), F.sum("good").alias("size_good"))
    kept = pairs.where(keep).join(by_context, "l").select("l", "r", "bad", "good", "size_bad", "size_good")
    own = words.where(keep).select("r", F.lit(True).alias("own")).unionByName(kept.select("r", F.lit(False).alias("own"))).groupBy("r").agg(F.max("own").alias("own"))
    needed = own.join(by_word, "r").join(shared.withColumnRenamed("word", "r"), "r").select("r", "own", "nb", "ng", "n")
    few = lambda c: [F.count_if(F.col(c) == k).alias(f"{c}{k}") for k in (1, 2)]
    totals = {**pairs.agg(*few("bad"), *few("good")).first().asDict(), **by_word.agg(F.sum("nb").alias("nb"), F.sum("ng").alias("ng"), *few("nb"), *few("ng")).first().asDict(),
              **shared.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).first().asDict()}
    named = stems.where("r <> 0")
    totals |= named.agg(F.sum("bad").alias("stems_bad"), F.sum("good").alias("stems_good"), F.count(F.lit(1)).alias("stem_kinds"),
                        *[F.count_if(F.col(c) == k).alias(f"stem_{c}{k}") for c in ("bad", "good") for k in (1, 2)]).first().asDict()
    return _rows(needed, ["r", "own", "nb", "ng", "n"]), _rows(kept, ["l", "r", "bad", "good", "size_bad", "size_good"]), _rows(named.where(keep), ["r", "bad", "good"]), totals


class Scores:
    """Log-likelihood differences in sorted hash arrays: of words, of stems, of pairs."""

    def __init__(self, words: dict[str, np.ndarray], pairs: dict[str, np.ndarray], stems: dict[str, np.ndarray], totals: dict[str, int]):
        order = np.argsort(words["r"].view(np.uint64))
        words = {k: v[order] for k, v in words.items()}
        keys, own = words["r"].view(np.uint64), words["own"].astype(bool)
        left, right = pairs["l"].view(np.uint64), pairs["r"].view(np.uint64)
        contexts, ctx = np.unique(left, return_inverse=True)
        at = np.searchsorted(keys, right)
        uniform = (words["n"] + 1) / (totals["total"] + totals["kinds"])
        word, pair, default = [], [], 0.0
        for sign, c, n in ((1, "bad", "nb"), (-1, "good", "ng")):
            d, e = _discount(totals[c + "1"], totals[c + "2"]), _discount(totals[n + "1"], totals[n + "2"])
            low = np.where(own, np.maximum(words[n] - e, 0), 0) / max(1.0, float(totals[n] or 0))
            free = max(1 - low.sum(), 1e-9)
            low = low + free * uniform
            high = np.maximum(pairs[c] - d, 0) / np.maximum(pairs["size_" + c], 1)
            back = np.maximum(1 - np.bincount(ctx, weights=high, minlength=len(contexts)), 1e-9)
            word.append(np.log(low))
            pair.append(np.log(high / back[ctx] + low[at]))
            default += sign * np.log(free)
        all_stems = float((totals["stems_bad"] or 0) + (totals["stems_good"] or 0))
        shared = (stems["bad"] + stems["good"] + 1) / (all_stems + totals["stem_kinds"] + 1)
        stem, plain = [], 0.0
        for sign, c in ((1, "bad"), (-1, "good")):
            d = _discount(totals[f"stem_{c}1"], totals[f"stem_{c}2"])
            high = np.maximum(stems[c] - d, 0) / max(1.0, float(totals[f"stems_{c}"] or 0))
            free = max(1 - high.sum(), 1e-9)
            stem.append(np.log(high + free * shared) - np.log(shared))
            plain += sign * np.log(free)
        order = np.argsort(stems["r"].view(np.uint64))
        # differences above those of a plain word after the same word, whose class terms are all backoff
        self.stems, self.stem = stems["r"].view(np.uint64)[order], (stem[0] - stem[1] - plain)[order].astype(np.float32)
        self.words, self.word = keys[own], (word[0] - word[1] - default - plain)[own].astype(np.float32)
        key = _pair_key(left, right)
        order = np.argsort(key)
        self.pairs, self.pair = key[order], (pair[0] - pair[1] - default - plain)[order].astype(np.float32)

    @staticmethod
    def _find(table, keys):
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def features(self, data, off) -> np.ndarray:
        """Mean log-likelihood difference per text, above that of plain words."""
        w, first = _tokens(data, off)
        diff = np.zeros(len(w), np.float64)
        if len(w):
            left, right = _pairs(w, first)
            for table, value, keys in ((self.stems, self.stem, _stems(data, off)), (self.words, self.word, right), (self.pairs, self.pair, _pair_key(left, right))):
                if len(table):  # a word's own term replaces its stem's, a pair's replaces both
                    at, ok = self._find(table, keys)
                    diff[ok] = value[at[ok]]
        sums = np.concatenate(([0], np.cumsum(diff)))
        return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """(slope, bias, scale): weighted logistic regression on one standardised feature, slightly regularised."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + np.array([1e-2 * b[0], 0])
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1]), scale


def _discount(n1: int, n2: int) -> float:
    """Kneser-Ney discount from the counts of counts."""
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _rows(df: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """A bounded table as arrays."""
    t = df.select(*columns).toArrow()
    return {c: t.column(c).to_numpy() for c in columns}


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", test=None) -> DataFrame:
    """The documents with ``held_out``, ``score`` and ``predicted`` (null ids are held out)."""
    spark = docs.sparkSession
    test = held_out(id_col) if test is None else test
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~test)
             .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic")))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    sizes = {r["toxic"]: r["n"] for r in known.join(ids, "id", "left_semi").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    out = docs.withColumn("__tl_held", F.coalesce(test, F.lit(True)))
    if len(sizes) < 2:
        model, slope, bias, scale = None, 0.0, 0.0, 1.0
    else:
        share = {c: min(1.0, SAMPLE / n) for c, n in sizes.items()}
        u = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 53))  # fine enough for any number of labels
        picked = F.broadcast(known.where(u < F.when(F.col("toxic") == 1, share[1] * (1 << 53)).otherwise(share[0] * (1 << 53))))  # about 2 * SAMPLE rows
        texts = written(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, "id")
                        .withColumn("fold", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(FOLDS))), "toxic-sample")
        learn = texts.where("fold > 0")
        n_words = learn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        thin = min(1.0, 6 * SAMPLE_WORDS / max(1, n_words))
        learn = learn.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1_000_000)) < F.lit(thin * 1e6))
        pairs = learn.select("text", "toxic").mapInArrow(_pair_counts("text"), "kind int, l long, r long, bad long, good long, bad_texts long, good_texts long").groupBy("kind", "l", "r").agg(*[F.sum(c).alias(c) for c in _COUNTS[3:]])
        pairs = written(pairs, "toxic-pairs")
        shared = written(docs.select(F.col(text_col).alias("text")).mapInArrow(_word_counts("text"), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "toxic-words")
        n_texts = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        model = Scores(*kept_tables(pairs, shared, n_texts)) if len(n_texts) == 2 else None
        slope, bias, scale = 0.0, 0.0, 1.0
        if model is not None:
            held = spark.sparkContext.broadcast(model)
            fit = _rows(texts.where("fold = 0").select("text", "toxic").mapInArrow(_features(held, "text"), "toxic int, x double"), ["toxic", "x"])
            if len(set(fit["toxic"].tolist())) == 2:
                y = fit["toxic"].astype(np.float64)
                weight = np.where(y > 0, 1 / share[1], 1 / share[0])
                slope, bias, scale = calibrate(fit["x"], y, weight / weight.mean())
                slope = max(slope, 0.0)
    names = [f for f in out.columns if f != "__tl_held"]
    extra = [("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    kept = [f for f in names if f not in {n for n, _ in extra}]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), *(f"{n} {t}" for n, t in extra)])
    held = spark.sparkContext.broadcast(model)
    fixed = prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part, data, off in B.slices(batch, text_col):
                if m is None or slope == 0.0:
                    p = np.full(part.num_rows, fixed)
                else:
                    p = 1 / (1 + np.exp(-np.clip(slope * np.arcsinh(m.features(data, off) / STEP) / scale + bias, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), part.column("__tl_held"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                    names=[*kept, *(n for n, _ in extra)])

    return out.mapInArrow(run, schema)


def _features(model, text_col):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in B.slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array(np.arcsinh(model.value.features(data, off) / STEP))], names=["toxic", "x"])

    return run
