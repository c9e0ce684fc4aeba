"""Quality of documents from a linear-chain conditional random field over their lines.

Every line gets a state, good or bad.  Its evidence is a vector of surface
features of the line and of its two neighbours; neighbouring states are tied by
transition weights.  The field is trained by gradient ascent on the
conditional likelihood (forward-backward marginals), lines carrying the label of
their document.  A document's quality is the length-weighted mean of its
lines' marginals; a one-feature logistic regression on texts kept out of the
training turns it into the score.

Training sees a bounded sample of labelled documents (``SAMPLE`` per class, picked by a hash of
the id; of each the first ``DOC_LINES`` lines, in all about ``SAMPLE_LINES`` lines, shared by
the classes); only the sample's sizes and its bounded line features reach the driver.
Scoring covers every line of every text.

Rows: null and empty texts have one empty line; repeated labels of an id count as
low quality if any is; null labels and ids are not learnt from; with fewer than two classes
of labels every score is the share of good ones (1 without any); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as B
from .toxicity import calibrate, held_out

#: Labelled documents per class (an expected number), lines of them that train the field, and lines of one of them.
SAMPLE = 1500
SAMPLE_LINES = 200_000
DOC_LINES = 2000
FOLDS = 4
STEPS = 150
RATE = 0.05

_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC0:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_OTHER = np.zeros(256, bool)
_OTHER[list(b"/\\@_=~^[]{}()+-\"'`")] = True

N_LINE = 14


def lines(data, off):
    """(start, end, document) of every line; a text without newline, or empty, is one line."""
    cut = np.flatnonzero(data == 0x0A) + 1
    doc_of_cut = np.searchsorted(off, cut - 1, side="right") - 1  # the newline's own text
    begin = np.concatenate([off[:-1], cut])
    doc = np.concatenate([np.arange(len(off) - 1), doc_of_cut])
    order = np.lexsort((np.concatenate([np.zeros(len(off) - 1, np.int8), np.ones(len(cut), np.int8)]), begin, doc))
    begin, doc = begin[order], doc[order]
    end = np.append(begin[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = off[doc[last] + 1]
    return begin, end, doc


def line_features(data, off):
    """(feature rows of single lines, line lengths, document per line)."""
    begin, end, doc = lines(data, off)
    n = (end - begin).astype(np.float64)
    count = lambda table: (lambda s: (s[end] - s[begin]).astype(np.float64))(np.concatenate(([0], np.cumsum(table[data]))))
    share = lambda table: count(table) / np.maximum(n, 1)
    starts, ends, _ = B.words(data, off, B.SPACED)
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    n_words = (b - a).astype(np.float64)
    low = B.word_hashes(data, starts, ends)
    same = np.zeros(len(starts), np.int64)
    same[1:] = low[1:] == low[:-1]
    of = np.repeat(np.arange(len(begin)), b - a)
    order = np.lexsort((low, of))
    new = np.ones(len(low))
    new[1:] = (low[order][1:] != low[order][:-1]) | (of[order][1:] != of[order][:-1])
    kinds = np.bincount(of[order], weights=new, minlength=len(begin)) if len(low) else np.zeros(len(begin))
    sums = lambda v: (lambda s: s[b] - s[a])(np.concatenate(([0], np.cumsum(v))))
    letters = count(_LETTER)
    x = np.stack([
        np.log1p(n) / 6, np.log1p(n_words) / 4, share(_MARK) * 4, share(_BANG) * 4, count(_UPPER) / np.maximum(letters, 1), share(_DIGIT) * 4,
        share(_STOP) * 8, share(_OTHER) * 4, letters / np.maximum(n, 1), sums(ends - starts) / np.maximum(n_words, 1) / 10,
        sums(same) / np.maximum(n_words, 1), kinds / np.maximum(n_words, 1), (n_words < 3).astype(np.float64), (count(_MARK) >= 3).astype(np.float64)], axis=1)
    return x, n, doc


def with_neighbours(x, doc):
    """A line's features, those of the lines before and after it in its document, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = doc[1:] == doc[:-1]
    before[1:][same] = x[:-1][same]
    after[:-1][same] = x[1:][same]
    edge = np.zeros((len(x), 2))
    edge[1:, 0], edge[:-1, 1] = same, same
    return np.concatenate([x, before, after, edge, np.ones((len(x), 1))], axis=1)


def marginals(emit, trans, doc):
    """(P(good) per line, expected transitions summed, log partition summed) over chains of lines.

    ``emit``: score of good minus bad per line; ``trans``: 2 x 2 transition scores.
    Chains step together, the longest first, so a step is one vector operation.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    e = np.stack([np.zeros(n), emit], axis=1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[first] = e[first]
    longest = int(size[0])
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # chains of at least t + 1 lines
    lse = lambda v: (lambda m: m + np.log(np.exp(v - m[..., None]).sum(-1)))(v.max(-1))
    for t in range(1, longest):
        at = first[:alive[t]] + t
        alpha[at] = e[at] + lse(alpha[at - 1][:, None, :] + trans.T[None])
    for t in range(longest - 1, 0, -1):
        at = first[:alive[t]] + t
        beta[at - 1] = lse((e[at] + beta[at])[:, None, :] + trans[None])
    z = lse(alpha[first + size - 1])
    by = np.argsort(first)  # chains in line order again
    per = np.repeat(z[by], size[by])
    good = np.exp(alpha[:, 1] + beta[:, 1] - per)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pair = np.exp(alpha[inner - 1][:, :, None] + trans[None] + (e[inner] + beta[inner])[:, None, :] - per[inner][:, None, None]).sum(0) if len(inner) else np.zeros((2, 2))
    return good, pair, float(z.sum())


def train(x, doc, label, weight_good: float = 1.0):
    """(feature weights, transition scores) by gradient ascent with per-weight step sizes (Adam)."""
    mean, std = x.mean(0), x.std(0)
    constant = std < 1e-9
    mean[constant], std[constant] = 0.0, 1.0
    z = (x - mean) / std
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    y = label.astype(np.float64)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    n = len(y)
    for t in range(1, STEPS + 1):
        good, pair, _ = marginals(z @ w, trans, doc)
        grad = np.concatenate([z.T @ (y - good) / n - 1e-4 * w, ((seen - pair) / n - 1e-3 * trans).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w += step[:-4]
        trans += step[-4:].reshape(2, 2)
    return w / std, trans, float(-(w * mean / std).sum())


def qualities(data, off, model) -> np.ndarray:
    """Length-weighted mean of the lines' good marginals per text."""
    w, trans, bias = model
    x, n, doc = line_features(data, off)
    good, _, _ = marginals(with_neighbours(x, doc) @ w + bias, trans, doc)
    weight = n + 1
    return np.bincount(doc, weights=good * weight, minlength=len(off) - 1) / np.bincount(doc, weights=weight, minlength=len(off) - 1)


def _logit(q):
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def draw_limit(n: int) -> float:
    """Bound on a 53-bit hash that draws about ``SAMPLE`` of ``n`` rows (never 0)."""
    return min(1.0, SAMPLE / n) * (1 << 53)


def fitting(classes: list[int], lengths: list[int], room: int) -> list[int]:
    """Documents, taken in order, whose lines fit: half the room for each class, then what is left for all; one that does not fit is passed over."""
    taken, left = [], room
    for c in (0, 1):
        mine = room // 2
        for k, n in enumerate(lengths):
            if classes[k] == c and n <= mine:
                taken.append(k)
                mine -= n
                left -= n
    for k in sorted(set(range(len(lengths))) - set(taken)):
        if lengths[k] <= left:
            taken.append(k)
            left -= lengths[k]
    return sorted(taken)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", test=None) -> DataFrame:
    """(id, held_out, score, predicted) per document; null ids are held out."""
    spark = docs.sparkSession
    test = held_out(id_col, 3, 1) if test is None else test
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~test)
             .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("good")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = {r["good"]: r["n"] for r in known.join(rows.select("id").distinct(), "id", "left_semi").groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 1.0
    model, slope, bias, scale = None, 0.0, 0.0, 1.0
    if len(sizes) == 2:
        u = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 53))
        picked = F.broadcast(known.where(u < F.when(F.col("good") == 1, draw_limit(sizes[1])).otherwise(draw_limit(sizes[0]))))  # about 2 * SAMPLE rows
        drawn = rows.join(picked, "id").select("id", F.xxhash64("text").alias("h"), "good", F.substring_index("text", "\n", DOC_LINES).alias("text"))
        n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        # ids that many rows share cannot make this longer
        lengths = drawn.select("id", "h", "good", n_lines.alias("n")).distinct().orderBy(F.xxhash64("id", "h"), "id", "h").limit(4 * SAMPLE).collect()
        chosen = fitting([r["good"] for r in lengths], [r["n"] for r in lengths], SAMPLE_LINES * FOLDS // (FOLDS - 1))
        keys = spark.createDataFrame([(lengths[k]["id"], lengths[k]["h"]) for k in chosen], "id long, h long")
        sample = (drawn.join(F.broadcast(keys), ["id", "h"], "left_semi").select("id", "h", "text", "good")
                  .mapInArrow(_sample, "id long, h long, good int, x binary, n int, size binary").dropDuplicates(["id", "h"]).toArrow())
        order = np.lexsort((sample.column("h").to_numpy(), sample.column("id").to_numpy()))
        ids, good = sample.column("id").to_numpy()[order], sample.column("good").to_numpy()[order]
        x = [np.frombuffer(b, np.float32).reshape(-1, N_LINE).astype(np.float64) for b in sample.column("x").take(pa.array(order)).to_pylist()]
        share = {c: (good == c).sum() / n for c, n in sizes.items()}
        fold = np.arange(len(ids)) % FOLDS
        fit = [k for k in np.flatnonzero(fold > 0)]
        if len(set(good[fit].tolist())) == 2:
            doc = np.repeat(np.arange(len(fit)), [len(x[k]) for k in fit])
            model = train(with_neighbours(np.concatenate([x[k] for k in fit]), doc), doc, np.repeat(good[fit], [len(x[k]) for k in fit]).astype(np.int64))
            rest = np.flatnonzero(fold == 0)
            sizes_of = [np.frombuffer(b, np.float32) for b in sample.column("size").take(pa.array(order)).to_pylist()]
            doc = np.repeat(np.arange(len(rest)), [len(x[k]) for k in rest])
            w, trans, b0 = model
            p, _, _ = marginals(with_neighbours(np.concatenate([x[k] for k in rest]), doc) @ w + b0, trans, doc)
            weight = np.concatenate([sizes_of[k] for k in rest]) + 1.0
            q = np.bincount(doc, weights=p * weight) / np.bincount(doc, weights=weight)
            if len(set(good[rest].tolist())) == 2:
                y = good[rest].astype(np.float64)
                slope, bias, scale = calibrate(_logit(q), y, np.where(y > 0, 1 / share[1], 1 / share[0]) / np.mean(np.where(y > 0, 1 / share[1], 1 / share[0])))
            if slope <= 0:
                slope, bias, scale = 1.0, 0.0, 1.0
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part, data, off in B.slices(batch, "text"):
                if m is None:
                    p = np.full(part.num_rows, prior)
                else:
                    p = 1 / (1 + np.exp(-np.clip(slope * _logit(qualities(data, off, m)) / scale + bias, -700, 700)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(test, F.lit(True)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line features of the sampled texts."""
    for batch in batches:
        for part, data, off in B.slices(batch, "text"):
            x, n, doc = line_features(data, off)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            x, n = x.astype(np.float32), n.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("h"), part.column("good").cast(pa.int32()), pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                 pa.array(np.diff(cut).astype(np.int32)), pa.array([n[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], names=["id", "h", "good", "x", "n", "size"])
