"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def substring_dedup(rows, width=13):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, kept sha256)}"""
    least = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def ngram_classes(rows, n=3, num=90, den=100):
    """rows: (doc_id, text) -> sorted [(doc_id, n_shingles, component_id)]"""
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def base_counts(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


class KneserNey:
    """Modified Kneser-Ney from dictionaries over symbol tuples, orders 1 to 4."""

    def __init__(self, texts, classes):
        from collections import Counter
        top = Counter()
        for t in texts:
            s = [0, 0, 0] + [int(classes[b]) for b in t.encode()]
            for k in range(len(s) - 3):
                top[tuple(s[k:k + 4])] += 1
        self.tables = [top]
        for _ in range(3):
            self.tables.insert(0, Counter(g[1:] for g in self.tables[0]))

    def p(self, gram):
        if not gram:
            return 1 / 64
        t = self.tables[len(gram) - 1]
        n = [max(1, sum(v == i for v in t.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        d = [0.0] + [min(max(x, 0.1), hi) for x, hi in zip(raw, (0.9, 1.8, 2.7))]
        after = [v for g, v in t.items() if g[:-1] == gram[:-1]]
        if not after:
            return self.p(gram[1:])
        total = sum(after)
        c = t.get(gram, 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(v, 3)] for v in after) / total * self.p(gram[1:])


def licence(text, phrases, notices, block, threshold):
    """(n_words, n_base, first, last, base labels, labels, best containment) of one text."""
    w = ALNUM.findall((text or "").translate(LOWER))
    places, base = [], set()
    for p, label in phrases:
        p = p.split()
        at = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for label, t in notices:
        t = ALNUM.findall(t.translate(LOWER))
        half = block // 2
        while half < len(t):
            half *= 2
        t = set(t)
        for b in range(max(1, -(-len(w) // half) - 1)):
            have = set(w[b * half:(b + 2) * half])
            if len(have & t) >= threshold * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(have & t) / len(t))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best)


def word_levels(rows, half, spell):
    """log-perplexity per (lang, text) from dictionaries: word pairs of the other half's texts, modified Kneser-Ney."""
    import math
    from collections import Counter

    def discounts(counts):
        n = [max(1, sum(v == i for v in counts.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0.0] + [min(max(x, 0.1), hi) for x, hi in zip(raw, (0.9, 1.8, 2.7))]

    pairs = {}
    for lang, text in rows:
        words = SPACED.findall(text or "")
        pairs.setdefault((lang, half(text)), Counter()).update(zip([None, *words], words))
    out = {}
    for lang, text in set(rows):
        words, c = SPACED.findall(text or ""), pairs.get((lang, 1 - half(text)), Counter())
        before = Counter(w for _, w in c)
        d, e, cost = discounts(c), discounts(before), 0.0
        for v, w in zip([None, *words], words):
            p = spell(lang, w)
            if c:
                p = (before[w] - e[min(before[w], 3)]) / len(c) + sum(e[min(n, 3)] for n in before.values()) / len(c) * p
            after = [n for (x, _), n in c.items() if x == v]
            if after:
                p = (c[v, w] - d[min(c[v, w], 3)]) / sum(after) + sum(d[min(n, 3)] for n in after) / sum(after) * p
            cost -= math.log(p)
        letters = sum(b >= 0x80 or chr(b).isalnum() for b in (text or "").encode())
        out[lang, text] = cost / (letters + len(words)) if words else 0.0
    return out
