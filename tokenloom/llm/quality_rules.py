"""Quality rules with a word n-gram perplexity band per language.

Base counts come from one vectorised pass over the bytes of every whole text.
The perplexity model of a language is a modified Kneser-Ney model over words (``[^\\x20\\x09-\\x0D]+``, by
44-bit hashes; a text opens with hash 0):

    P(w | v) = (c(v w) - D(c(v w))) / c(v .) + L(v) P(w)      (P(w) where v is unknown)
    P(w)     = (N(. w) - D'(N(. w))) / N(. .) + L' S(w)

N(. w) is the number of distinct words before w, D and D' are the three discounts from counts
of counts, L the mass left.  S spells w: a modified Kneser-Ney model of order 4 over characters folded into 64
classes, which only spreads the mass of words that were never seen.

A text is not scored by counts that it made itself: texts form two halves, by the least hash of a text's
``SHINGLE``-word shingles (copies stay together, near copies mostly), each half is counted apart, and
a text is scored with the counts of the other half.

* Word pairs go to a grid of cells by hash range of v (row) and of w (column), as sorted hash
  arrays, made per task for chunks of ``HOLD_WORDS`` words.  A pair comes once a chunk, with its numbers in the two halves and the
  numbers of its texts in the chunk; the texts' keys go once a chunk.  A language's grid has a cell
  for every ``CELL_BYTES`` of its text, so a cell does not grow with the corpus, and the pairs of a
  frequent word lie in a whole row or column of cells.
* A cell counts its pairs; rows of cells add up c(v .) and what is left after v, columns N(. w), and
  the sums go back to the cells.  No count leaves Spark and none is dropped.
* A cell scores its pairs and adds them up per text of a chunk, a chunk adds up its cells; sums are of integers (steps of 2**-20 nats), so order does not matter.

``log_perplexity`` is in nats per letter: bytes of letters, digits and other scripts, and one a word for the space
after it.  Marks cost what the model says but do not dilute a text's level.

Spelling: Spark counts the character 4-grams of all texts; each language's model is one row of sorted
code arrays.  A code has 24 bits, so this model has at most 2**24 entries; they go to the
tasks in groups of languages of at most ``MODEL_BYTES`` together (a language of its own if larger).

Bands: exact quantiles of the log-perplexity, in steps of ``1/STEPS`` nats, per
language over documents that pass the base rules: the median plus and minus
``WIDTH`` times the distance between median and the quartile on that side,
at least ``FLOOR``.  Documents outside are rejected.

Rows: null text has no words (and fails the base rules); a null language is a language of
its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytestext as B
from .common import written

ORDER = 4
MODEL_BYTES = 128 << 20
STEPS = 1000
WIDTH = 3.0
FLOOR = 0.05
_HOLD = 1 << 23
CELL_BYTES = 64 << 20
HOLD_WORDS = 9 << 19
SHINGLE = 3
_NATS = float(1 << 20)
#: Words are told apart by the upper 44 bits of their hashes: of n distinct words n / 2**44 share theirs with another.
_SHIFT = np.uint64(20)

#: The symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CLASS = np.full(256, 45, np.uint32)  # other marks and controls
_CLASS[0x61:0x7B] = np.arange(2, 28)
_CLASS[0x41:0x5B] = 28
_CLASS[0x30:0x3A] = 29
for _k, _c in enumerate(b".,|!?:;'\"-#*$%&"):
    _CLASS[_c] = 30 + _k
_CLASS[[0x20, 0x09]] = 1
_CLASS[[0x0A, 0x0D]] = 0
_CLASS[0x80:0xC0] = 46 + np.arange(64) % 16
_CLASS[0xC0:] = 62 + np.arange(64) % 2


def _codes(data, off):
    """24-bit code of the 4-gram that ends at every byte; a text opens with three boundaries."""
    c = _CLASS[data]
    code = c.copy()
    pos = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, ORDER):
        prev = np.zeros_like(c)
        prev[k:] = c[:-k]
        prev[pos < k] = 0
        code |= prev << np.uint32(6 * k)
    return code


def _count(text_col, lang_col):
    """Partial (lang, code, n) over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def add(lang, codes):
            codes = np.sort(codes)
            at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            held.setdefault(lang, []).append((codes[at], np.diff(np.append(at, len(codes)))))
            if sum(len(x) for x, _ in held[lang]) > _HOLD:
                held[lang] = [merge(held[lang])]

        def merge(parts):
            k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            return k[at], np.add.reduceat(n, at)

        for batch in batches:
            for part, data, off in B.slices(batch, text_col):
                if not len(data):
                    continue
                code = _codes(data, off)
                langs = part.column(lang_col).dictionary_encode()
                of = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                at = np.repeat(of, np.diff(off))
                for k in np.unique(of):
                    mine = code[at == k]
                    if len(mine):
                        add(None if k < 0 else langs.dictionary[int(k)].as_py(), mine)
        for lang, parts in held.items():
            k, n = merge(parts)
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k[i:i + (1 << 16)]), pa.string()), pa.array(k[i:i + (1 << 16)].astype(np.int32)), pa.array(n[i:i + (1 << 16)].astype(np.int64))],
                                                 names=["lang", "code", "n"])

    return run


def _discounts(t):
    """(0, D1, D2, D3+) from the numbers of n-grams that were counted once to four times."""
    t = [max(1, int(x)) for x in t]
    y = t[0] / (t[0] + 2 * t[1])
    return np.clip([0.0, 1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]], [0, 0.1, 0.1, 0.1], [0, 0.9, 1.8, 2.7])


class Model:
    """Modified Kneser-Ney probabilities of one language in sorted arrays, order by order."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        tables = [(codes.astype(np.uint32), counts.astype(np.int64))]
        for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before an n-gram
            k = np.sort(tables[0][0] & np.uint32((1 << (6 * n)) - 1))
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            tables.insert(0, (k[at], np.diff(np.append(at, len(k)))))
        self.keys, self.logp, self.contexts, self.backoff = [], [], [], []
        lower = None
        for n, (k, c) in enumerate(tables, 1):
            d = _discounts([int((c == i).sum()) for i in (1, 2, 3, 4)])
            cut = d[np.minimum(c, 3)]
            ctx, of = np.unique(k >> np.uint32(6), return_inverse=True)  # the context of a code is its high part
            total = np.bincount(of, weights=c)
            free = np.bincount(of, weights=cut) / total
            base = np.full(len(k), 1 / 64) if lower is None else lower[np.searchsorted(tables[n - 2][0], k & np.uint32((1 << (6 * (n - 1))) - 1))]
            lower = (c - cut) / total[of] + free[of] * base
            self.keys.append(k)
            self.logp.append(np.log(lower).astype(np.float32))
            self.contexts.append(ctx)
            self.backoff.append(np.log(np.maximum(free, 1e-12)).astype(np.float32))

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each code."""
        kinds, back = np.unique(codes, return_inverse=True)
        out = np.zeros(len(kinds), np.float32)
        todo = np.arange(len(kinds))
        for n in range(ORDER, 0, -1):
            k = kinds[todo] & np.uint32((1 << (6 * n)) - 1)
            at = np.minimum(np.searchsorted(self.keys[n - 1], k), len(self.keys[n - 1]) - 1)
            ok = self.keys[n - 1][at] == k
            out[todo[ok]] += self.logp[n - 1][at[ok]]
            todo, k = todo[~ok], k[~ok] >> np.uint32(6)
            at = np.minimum(np.searchsorted(self.contexts[n - 1], k), len(self.contexts[n - 1]) - 1)
            out[todo] += np.where(self.contexts[n - 1][at] == k, self.backoff[n - 1][at], 0)
        out[todo] += np.float32(np.log(1 / 64))
        return out[back]

    def nbytes(self) -> int:
        return sum(a.nbytes for arrays in (self.keys, self.logp, self.contexts, self.backoff) for a in arrays)


def base_counts(data, off):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per text."""
    starts, ends, first = B.words(data, off, B.SPACED)
    n_words = np.diff(first)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    sums = lambda v, cut: (lambda s: s[cut[1:]] - s[cut[:-1]])(np.concatenate(([0], np.cumsum(v))))
    word_chars = sums(points[ends] - points[starts], first)
    n_symbols = sums(_SYMBOL[data], off)
    # lines: text starts and the bytes after a newline
    newline = np.flatnonzero(data == 0x0A) + 1
    full = off[:-1][np.diff(off) > 0]
    begin = np.unique(np.concatenate([full, newline]))
    doc = np.searchsorted(off, begin, side="right") - 1
    inside = (begin < len(data)) & (begin < off[np.minimum(doc + 1, len(off) - 1)])
    begin, doc = begin[inside], doc[inside]
    stop = np.minimum(np.append(begin[1:], len(data)), off[doc + 1])
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 0x0A) if len(stop) else 0)
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, doc = begin[has], stop[has], doc[has]
    n_dup = np.bincount(doc[_repeated(B.poly_hash(data, begin, stop) + B.mix((stop - begin).astype(np.uint64)), doc)[1]], minlength=len(n_words))
    h, at = B.window_hashes(B.word_hashes(data, starts, ends), first, 3)
    of = np.repeat(np.arange(len(n_words)), np.maximum(n_words - 2, 0))
    again, _ = _repeated(h, of)
    cover = np.zeros(len(starts) + 1, np.int32)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, np.minimum(at[again] + 3, len(starts)), -1)
    n_repeat = sums(np.cumsum(cover[:-1]) > 0, first)
    return n_words, word_chars, n_symbols, n_dup, n_repeat


def _repeated(h, doc):
    """Flags (found twice or more in its text, equal to an earlier one of its text)."""
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((np.arange(len(h)), h, doc))
    sh, sd = h[order], doc[order]
    same = (sh[1:] == sh[:-1]) & (sd[1:] == sd[:-1])
    many, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def _estimate(group: pa.Table) -> pa.Table:
    import pickle
    order = np.argsort(group.column("code").to_numpy())
    m = Model(group.column("code").to_numpy()[order], group.column("n").to_numpy()[order])
    return pa.table({"lang": group.column("lang").slice(0, 1), "model": pa.array([pickle.dumps(m)], pa.binary()), "bytes": pa.array([m.nbytes()], pa.int64())})


def _spelling(model, data, starts, ends):
    """Log probability of the letters of each word and the space after it."""
    size = ends - starts + 2
    off = np.concatenate(([0], np.cumsum(size)))
    text = np.full(off[-1], 0x20, np.uint8)
    at = np.arange(off[-1]) - np.repeat(off[:-1], size)
    inner = (at > 0) & (at < np.repeat(size - 1, size))
    text[inner] = data[(np.repeat(starts, size) + at - 1)[inner]]
    logp = model.score(_codes(text, off)).astype(np.float64)
    logp[off[:-1]] = 0.0
    return np.add.reduceat(logp, off[:-1])


def _half(w, first):
    """0 or 1 per text: a bit of the least hash of its shingles (of all its words if it has fewer)."""
    size = np.diff(first)
    h, at = B.window_hashes(w, first, SHINGLE)
    least = B.mix(B.poly_hash(w, first[:-1], first[1:]))
    n = np.maximum(size - SHINGLE + 1, 0)
    if len(h):
        least[n > 0] = np.minimum.reduceat(h, (np.cumsum(n) - n)[n > 0])
    return B.mix(least) & np.uint64(1)


def _press(values, kind: str) -> bytes:
    """Numbers as bytes of equal weight side by side, compressed."""
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _open(blob: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sorted(values) -> bytes:
    return _press(np.diff(values, prepend=np.uint64(0)), "<u8")


def _unsorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_open(blob, "<u8"), dtype=np.uint64)


_SMALL = np.array([(n - k, k) for n in range(22) for k in range(n + 1)], np.int64).T


def _joint(n0, n1) -> bytes:
    """Two small numbers each in a byte (their place in ``_SMALL``); pairs of a larger sum apart."""
    both = n0 + n1
    few = both < 22
    head = _press(np.where(few, both * (both + 1) // 2 + n1, 255), "u1")
    return len(head).to_bytes(8, "little") + head + _press(np.concatenate((n0[~few], n1[~few])), "<u4")


def _split(blob: bytes) -> np.ndarray:
    """The numbers of ``_joint`` as two rows."""
    cut = 8 + int.from_bytes(blob[:8], "little")
    at = _open(blob[8:cut], "u1")
    out = _SMALL[:, np.where(at < 255, at, 0)]
    out[:, at == 255] = _open(blob[cut:], "<u4").reshape(2, -1)
    return out


_PAIRS = "lkey string, i int, j int, chunk long, zero int, v binary, w binary, s binary, vi binary, wi binary, n binary, t binary, k binary, size binary"
_SUMS = "lkey string, axis int, k int, at int, words binary, sums binary"
_ANSWERS = "lkey string, i int, j int, axis int, at int, sums binary"
_COSTS = "lkey string, chunk long, n long, t binary, cost binary, k binary, size binary"


def _firsts(*values) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values[0])), bool), np.any([x[1:] != x[:-1] for x in values], axis=0))))


def _steps(values, first) -> bytes:
    """Numbers that rise within runs (``first``: where runs begin), as steps."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return _press(out, "<u4")


def _unstepped(blob: bytes, first) -> np.ndarray:
    steps = _open(blob, "<u4").astype(np.int64)
    sums = np.cumsum(steps)
    return sums - np.repeat(sums[first] - steps[first], np.diff(np.append(first, len(sums))))


def _pairs(models, grids):
    """Word pairs with their texts, per language, cell and chunk (the texts that a task held together), as sorted hash
    arrays, places in them and numbers of the chunk's texts, half 0 first.  One row of a chunk has its texts' keys and sizes."""
    names, types = [x.split(" ")[0] for x in _PAIRS.split(", ")], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 9

    def rows(lang, parts, spelt):
        grid = grids[lang]
        zero = sum(len(size) for _, size, _ in parts[0])
        w, size, key = (np.concatenate(x) for x in zip(*parts[0], *parts[1], strict=True))
        for part in parts:
            part.clear()
        wk, wi = np.unique(w, return_inverse=True)
        wi = wi.astype(np.int32)
        del w
        s = np.zeros(len(wk), np.float16)
        for words, cost in spelt:
            s[np.searchsorted(wk, words)] = cost
        opens = 0 if wk[0] == 0 else 1  # a text opens with hash 0
        vk = np.concatenate((np.zeros(opens, np.uint64), wk))
        vi = np.concatenate((np.zeros(1, np.int32), wi[:-1] + np.int32(opens)))
        vi[np.cumsum(size) - size] = 0
        t = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.argsort(vi * np.int64(len(wk)) + wi, kind="stable")
        vi, wi, t = vi[order], wi[order], t[order]
        small = np.uint16 if grid < 256 else np.int64
        cell = (_range(vk, grid) * grid).astype(small)[vi] + _range(wk, grid).astype(small)[wi]
        order = np.argsort(cell, kind="stable")
        vi, wi, t, cell = vi[order], wi[order], t[order], cell[order]
        del order
        cuts = np.append(_firsts(cell), len(cell))
        keys = key.tobytes(), size.astype(np.uint32).tobytes()
        chunk = int.from_bytes(hashlib.blake2b(b"".join(keys), digest_size=8).digest(), "little", signed=True)
        for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            pair = _firsts(vi[a:b], wi[a:b])
            pv, pw, half = vi[a:b][pair], wi[a:b][pair], t[a:b] >= zero
            v_at, (wu, at) = _firsts(pv), np.unique(pw, return_inverse=True)
            n1 = np.add.reduceat(half.astype(np.int64), pair)
            mine = c == chunk % (len(cuts) - 1)
            new = np.zeros(len(pv), np.uint8)
            new[v_at] = 1
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(
                [lang, int(cell[a]) // grid, int(cell[a]) % grid, chunk, zero, _sorted(vk[pv[v_at]]), _sorted(wk[wu]), _press(s[wu], "<f2"), _press(new, "u1"), _steps(at, v_at),
                 _joint(np.diff(np.append(pair, b - a)) - n1, n1), _steps(t[a:b] - zero * half, _firsts(vi[a:b], wi[a:b], half)),
                 _press(key, "<u8") if mine else None, _press(size, "<u4") if mine else None], types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle
        loaded = {k: pickle.loads(v) for k, v in models.value.items()}
        held: dict[str, tuple] = {}
        n = 0
        for batch in batches:
            for part, data, off in B.slices(batch, "text"):
                starts, ends, first = B.words(data, off, B.SPACED)
                w = B.word_hashes(data, starts, ends) >> _SHIFT << _SHIFT
                size = np.diff(first)
                key, half = part.column("key").to_numpy().view(np.uint64), _half(w, first)
                lkeys = part.column("lkey").dictionary_encode()
                of = np.where(size > 0, lkeys.indices.to_numpy(), -1)
                for c in np.unique(of[of >= 0]):
                    lang, mine = lkeys.dictionary[int(c)].as_py(), np.flatnonzero(np.repeat(of == c, size))
                    words, at = np.unique(w[mine], return_index=True)
                    parts, spelt = held.setdefault(lang, (([], []), []))
                    spelt.append((words, _spelling(loaded[lang], data, starts[mine][at], ends[mine][at]).astype(np.float32)))
                    for h in (0, 1):
                        texts = (of == c) & (half == h)
                        parts[h].append((w[np.repeat(texts, size)], size[texts], key[texts]))
                n += len(w)
                if n >= HOLD_WORDS:
                    for lang in list(held):
                        yield from rows(lang, *held.pop(lang))
                    n = 0
        for lang in list(held):
            yield from rows(lang, *held.pop(lang))
        B._give_back()

    return run


def _range(h, grid: int):
    return ((h >> np.uint64(32)) * np.uint64(grid) >> np.uint64(32)).astype(np.int64)


class _Cell:
    """A cell's pairs of words, counted apart for the two halves of the texts."""

    def __init__(self, table: pa.Table):
        column = lambda name: (x.as_py() for x in table.column(name))
        words = [(_unsorted(v), _unsorted(w)) for v, w in zip(column("v"), column("w"), strict=True)]
        self.v = np.unique(np.concatenate([x for x, _ in words]))
        self.w, at = np.unique(np.concatenate([x for _, x in words]), return_index=True)
        self.spelt = np.exp(np.concatenate([_open(s, "<f2") for s in column("s")])[at].astype(np.float64))
        pairs, self.counts = [], []
        for (vk, wk), vi, wi, n in zip(words, column("vi"), column("wi"), column("n"), strict=True):
            new = _open(vi, "u1")
            v = np.searchsorted(self.v, vk)[np.cumsum(new, dtype=np.int64) - 1]
            pairs.append(v * len(self.w) + np.searchsorted(self.w, wk)[_unstepped(wi, np.flatnonzero(new))])
            self.counts.append(_split(n).astype(np.int32))
        del words
        kinds = np.concatenate(pairs)
        kinds.sort()
        kinds = kinds[_firsts(kinds)]
        self.pairs = [np.searchsorted(kinds, x).astype(np.int32) for x in pairs]  # a unit's pairs among the cell's
        self.n = np.zeros((2, len(kinds)), np.int64)
        for at, n in zip(self.pairs, self.counts, strict=True):
            self.n[:, at] += n
        self.v_of = (kinds // len(self.w)).astype(np.int32)
        self.w_of = (kinds % len(self.w)).astype(np.int32)
        self.v_at = _firsts(self.v_of)


def _sums(grids):
    """What a cell adds to its row (per v: count, pairs counted once, twice, more often), to its column
    (per w: distinct words before it) and to the language (pairs counted once to four times); all for both halves."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lang, i, j = (k.as_py() for k in key)
        c = _Cell(group)
        after = np.concatenate([np.add.reduceat(np.stack([n, n == 1, n == 2, n > 2]).astype(np.int64), c.v_at, axis=1) for n in c.n])
        before = np.stack([np.bincount(c.w_of[n > 0], minlength=len(c.w)) for n in c.n]).astype(np.int64)
        few = np.array([[(n == x).sum() for x in (1, 2, 3, 4)] for n in c.n], np.int64)
        rows = [(lang, 0, i, j, _sorted(c.v), _press(after.ravel(), "<i8")), (lang, 1, j, i, _sorted(c.w), _press(before.ravel(), "<i8"))]
        rows += [(lang, 0, k, -1, _sorted(c.v[:0]), _press(few.ravel(), "<i8")) for k in range(grids[lang])]
        del c
        B._give_back()
        return _table(rows, ["lkey", "axis", "k", "at", "words", "sums"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _answers(grids):
    """Sums over a row or a column of cells, for each of its cells: per v the numbers of ``_sums``, per w the words before
    it.  Axis 2 has the discounts of pairs (at 0) and a column's counts of counts (at 1), for every cell that needs them."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lang, axis, k = (x.as_py() for x in key)
        grid = grids[lang]
        parts = [(r["at"], _unsorted(r["words"]), _open(r["sums"], "<i8")) for r in group.select(["at", "words", "sums"]).to_pylist()]
        few = sum((x.reshape(2, 4) for at, _, x in parts if at < 0), np.zeros((2, 4), np.int64))
        parts = [(at, words, x.reshape(-1, len(words))) for at, words, x in parts if at >= 0]
        if not parts:
            return _table([], ["lkey", "i", "j", "axis", "at", "sums"], [pa.string(), *[pa.int32()] * 4, pa.binary()])
        words = np.unique(np.concatenate([x for _, x, _ in parts]))
        total = np.zeros((len(parts[0][2]), len(words)), np.int64)
        for _, x, sums in parts:
            total[:, np.searchsorted(words, x)] += sums
        if axis == 0:
            rows = [(lang, k, at, 2, 0, np.stack([_discounts(x) for x in few]).tobytes()) for at, _, _ in parts]
            cell = lambda at: (k, at)
        else:
            few = np.array([[*((n == x).sum() for x in (1, 2, 3, 4)), (n > 2).sum(), n.sum()] for n in total], np.int64)
            rows = [(lang, i, j, 2, 1, few.tobytes()) for i in range(grid) for j in range(grid)]
            cell = lambda at: (at, k)
        rows += [(lang, *cell(at), axis, 0, _press(total[:, np.searchsorted(words, x)].ravel(), "<i8")) for at, x, _ in parts]
        return _table(rows, ["lkey", "i", "j", "axis", "at", "sums"], [pa.string(), *[pa.int32()] * 4, pa.binary()])

    return run


def _table(rows, names, types) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _costs(key: tuple[pa.Scalar, ...], pairs: pa.Table, answers: pa.Table) -> pa.Table:
    """Per chunk, the cost of its texts' words in this cell (steps of ``1/_NATS`` nats), by numbers of texts."""
    rows = []
    if pairs.num_rows:
        c = _Cell(pairs)
        costs = _pair_costs(c, answers)
        texts = (r for batch in pairs.select(["chunk", "zero", "t", "k", "size"]).to_batches(1) for r in batch.to_pylist())
        for r, n, at in zip(texts, c.counts, c.pairs, strict=True):
            n = n.T.ravel()  # per pair the words of half 0, then those of half 1
            full = np.flatnonzero(n)
            n, cost = n[full], costs[:, at].T.ravel()[full]
            t = _unstepped(r["t"], np.cumsum(n) - n) + r["zero"] * np.repeat(full % 2, n)
            kinds = np.flatnonzero(np.bincount(t))
            rows.append((key[0].as_py(), r["chunk"], len(t), _press(np.diff(kinds, prepend=0), "<u4"), _press(np.bincount(t, weights=np.repeat(cost, n))[kinds], "<i8"), r["k"], r["size"]))
        del c, costs
        B._give_back()
    return _table(rows, [x.split(" ")[0] for x in _COSTS.split(", ")], [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4])


def _totals(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Mean cost of a word per text of a chunk, in nats, over all cells.  Chunks of the same texts are one, their words add up."""
    rows = group.select(["n", "t", "cost", "k", "size"]).to_pylist()
    held = [r for r in rows if r["k"] is not None]
    size = np.sum([_open(r["size"], "<u4") for r in held], axis=0, dtype=np.int64)
    if np.sum(size) != sum(r["n"] for r in rows):
        raise RuntimeError("a task that ran again met its texts in another order: words of a chunk are missing")
    cost = np.zeros(len(size), np.int64)
    for r in rows:
        cost[np.cumsum(_open(r["t"], "<u4"), dtype=np.int64)] += _open(r["cost"], "<i8")
    return pa.table({"lkey": pa.array([key[0].as_py()] * len(size), pa.string()), "key": pa.array(_open(held[0]["k"], "<u8").view(np.int64)), "cost": pa.array(cost / size / _NATS)})


def _pair_costs(c: _Cell, answers: pa.Table) -> np.ndarray:
    """Cost of each pair in a text of half 0 and of half 1."""
    few = np.zeros((2, 6), np.int64)
    for r in answers.select(["axis", "at", "sums"]).to_pylist():
        if r["axis"] == 2 and r["at"]:
            few = few + np.frombuffer(r["sums"], np.int64).reshape(2, 6)
        elif r["axis"] == 2:
            cut = np.frombuffer(r["sums"], np.float64).reshape(2, 4)
        elif r["axis"] == 0:
            after = _open(r["sums"], "<i8").reshape(2, 4, -1)
        else:
            before = _open(r["sums"], "<i8").reshape(2, -1)
    costs = np.empty(c.n.shape, np.int32)  # at most 691 nats, so below 2**30 steps
    for o in (1, 0):  # texts of half 0 are scored with the counts of half 1
        d, kinds = _discounts(few[o, :4]), max(1, few[o, 5])
        word = (before[o] - d[np.minimum(before[o], 3)]) / kinds + ((d[1] * few[o, 0] + d[2] * few[o, 1] + d[3] * few[o, 4]) / kinds if few[o, 5] else 1.0) * c.spelt
        size, once, twice, more = after[o]
        left = np.where(size > 0, (cut[o, 1] * once + cut[o, 2] * twice + cut[o, 3] * more) / np.maximum(size, 1), 1.0).astype(np.float32).astype(np.float64)
        size = np.maximum(size, 1)
        for a in range(0, c.n.shape[1], 1 << 20):
            n, v, w = c.n[o, a:a + (1 << 20)], c.v_of[a:a + (1 << 20)], c.w_of[a:a + (1 << 20)]
            p = (n - cut[o][np.minimum(n, 3)]) / size[v] + left[v] * word[w]
            costs[1 - o, a:a + (1 << 20)] = np.rint(-np.log(np.maximum(p, 1e-300)) * _NATS)
    return costs


def _base(id_col):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in B.slices(batch, "text"):
                counts = base_counts(data, off)
                letters = np.concatenate(([0], np.cumsum(B.ALNUM[data])))
                failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in (id_col, "lang", "lkey", "key")), *(pa.array(x.astype(np.int64)) for x in counts), pa.array(failed), pa.array((letters[off[1:]] - letters[off[:-1]] + counts[0]).astype(np.int64))],
                    names=["id", "lang", "lkey", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_letters"])

    return run


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, log-perplexity, the language's band and the verdict ``kept`` per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumns({"lkey": F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")), "key": F.xxhash64("text").bitwiseAND(-2)})  # equal texts share a key and a level; the last bit is their half
    counts = rows.select("lang", "text").mapInArrow(_count("text", "lang"), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    models = written(counts.groupBy("lang").applyInArrow(_estimate, "lang string, model binary, bytes long"), "kn-models")
    groups, held = [[]], 0
    for r in models.select("lang", "bytes").orderBy("lang").toLocalIterator():
        if groups[-1] and held + r["bytes"] > MODEL_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(r["lang"])
        held += r["bytes"]
    member = lambda langs: F.coalesce(F.col("lang").isin([x for x in langs if x is not None]), F.lit(False)) | (F.col("lang").isNull() & F.lit(None in langs))
    sizes = rows.groupBy("lkey").agg(F.sum(F.octet_length("text")).alias("n")).toLocalIterator()
    grids = {r["lkey"]: max(1, int(np.ceil(np.sqrt(r["n"] / CELL_BYTES)))) for r in sizes}
    pairs = None
    for langs in groups:
        blobs = {"" if r["lang"] is None else "=" + r["lang"]: bytes(r["model"]) for r in models.where(member(langs)).toLocalIterator()}
        mine = rows if len(groups) == 1 else rows.where(member(langs))
        part = mine.select("lkey", "key", "text").mapInArrow(_pairs(spark.sparkContext.broadcast(blobs), grids), _PAIRS)
        pairs = part if pairs is None else pairs.unionByName(part)
    cells = ("lkey", "i", "j")
    sums = pairs.groupBy(*cells).applyInArrow(_sums(grids), _SUMS)
    answers = sums.groupBy("lkey", "axis", "k").applyInArrow(_answers(grids), _ANSWERS)
    costs = pairs.groupBy(*cells).cogroup(answers.groupBy(*cells)).applyInArrow(_costs, _COSTS)
    costs = costs.groupBy("lkey", "chunk").applyInArrow(_totals, "lkey string, key long, cost double")
    costs = costs.groupBy("lkey", "key").agg(F.min("cost").alias("cost"))  # equal texts cost the same
    base = rows.mapInArrow(_base("id"), f"id {docs.schema[id_col].dataType.simpleString()}, lang string, lkey string, key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_letters long")
    scored = written(base.join(costs, ["lkey", "key"], "left").withColumn("log_perplexity", F.coalesce(F.col("cost") * F.col("n_words") / F.col("n_letters"), F.lit(0.0))).drop("lkey", "key", "cost", "n_letters"), "kn-scores")
    # exact quantiles at the histogram's resolution; its rows per language are bounded by the log-perplexity's range
    bins = scored.where(~F.col("base_failed")).groupBy("lang", F.floor(F.col("log_perplexity") * STEPS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy("bin")
    spread = bins.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    q = lambda p: F.min(F.when(F.col("upto") >= F.col("all") * p, F.col("bin") / STEPS))
    bands = spread.groupBy("lang").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))
    bands = bands.select(F.col("lang").alias("band_lang"), (F.col("q2") - F.greatest(F.lit(FLOOR), WIDTH * (F.col("q2") - F.col("q1")))).alias("band_low"),
                         (F.col("q2") + F.greatest(F.lit(FLOOR), WIDTH * (F.col("q3") - F.col("q2")))).alias("band_high"))
    out = scored.join(bands, scored["lang"].eqNullSafe(bands["band_lang"]), "left").drop("band_lang")
    inside = F.col("log_perplexity").between(F.col("band_low"), F.col("band_high"))
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(True)))).withColumnRenamed("id", id_col)
