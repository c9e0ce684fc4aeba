"""Token ids from a public byte-level BPE file through the ``tokenizers`` library, inside Arrow tasks.

In byte-level BPE with the usual word pattern a single space or newline
between two visible characters always starts a new pre-token, and a pre-token's
ids do not depend on its neighbours.  So a regular text is the concatenation of
the ids of its " word" pieces: each piece is encoded by the library once per
worker and looked up afterwards, by a 64-bit hash of its bytes.  Texts with other white space, control
characters, scripts beyond Latin letters or the string of an added token are encoded
whole by the library, whose settings are left as they are.
"""

from __future__ import annotations

import os

import numpy as np

from .bytestext import HELD, word_hashes

#: Pieces that a worker remembers before it starts anew (about 100 MB).
MEMORY = 3_000_000
#: ASCII marks that form one pre-token when they follow a letter and end a piece.
_MARKS = ".,|!%$*&#"
_MARK_SET = set(_MARKS)

# byte table of texts that go to the library whole: controls other than newline, and lead bytes of
# characters beyond U+017F; U+0080-U+00A0 (C2 80 - C2 A0) is looked for apart
_ODD = np.zeros(256, bool)
_ODD[:0x20] = _ODD[0x7F] = _ODD[0xC6:] = True
_ODD[0x0A] = False
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, 0x0A]] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        #: Strings of added tokens: the library takes them out of a text first, so texts that hold one go to it whole.
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        line = self.whole(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else None
        self.forget()

    def forget(self):
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0
        # sorted hashes of known pieces with their places in ``flat``: a large table, and a small one of late pieces
        self.tables = [_Known(), _Known()]

    @property
    def n(self) -> int:
        return sum(len(t.keys) for t in self.tables)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray) -> int:
        """Append ids to ``flat``; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        while self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at:self.used] = ids
        return at

    def _remember(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray):
        large, late = self.tables
        late = late.joined(hashes, start, size)
        if len(late.keys) > max(1 << 15, len(large.keys) // 8):
            large, late = large.joined(late.keys, late.start, late.size), _Known()
        self.tables = [large, late]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat``, ids) of sorted hashes; place -1 for unknown ones."""
        start, size = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for t in self.tables:
            if len(t.keys):
                at = np.minimum(np.searchsorted(t.keys, hashes), len(t.keys) - 1)
                ok = t.keys[at] == hashes
                start[ok], size[ok] = t.start[at[ok]], t.size[at[ok]]
        return start, size

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place, ids) of distinct pieces: '\x01w' opens a text, '\nw' follows a newline, 'w' follows a space.

        Marks after a letter are a pre-token of their own, so a piece is its core and its marks.
        """
        cores: dict[str, int] = {}
        core_of, mark_of = [], []
        for p in pieces:
            mark = ""
            if p[-1:] in _MARK_SET:
                core = p.rstrip(_MARKS)
                if len(core) > 1 and core[-1].isalpha():
                    p, mark = core, p[len(core):]
            core_of.append(cores.setdefault(p, len(cores)))
            mark_of.append(mark)
        names = list(cores)
        raw = [c.encode() for c in names]
        ends = np.cumsum([len(r) for r in raw])
        hashes = word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.diff(ends, prepend=0), ends)
        order = np.argsort(hashes)
        start, size = (x[np.argsort(order)] for x in self._find(hashes[order]))
        new = np.flatnonzero(start < 0)
        # one text, a newline before every piece: the newline id separates them again
        for i in range(0, len(new), 2000):
            block = [names[k] for k in new[i:i + 2000]]
            ids = self.whole(["\n" + "\n".join([c[1:] if c[0] in "\x01\n" else " " + c for c in block])])[0]
            cut = np.flatnonzero(ids == self.line)
            skip = np.array([c[0] != "\n" for c in block], np.int64)
            start[new[i:i + 2000]] = self._store(ids) + cut + skip
            size[new[i:i + 2000]] = np.diff(np.append(cut, len(ids))) - skip
        self._remember(hashes[new], start[new], size[new])
        start, size = start[core_of], size[core_of]
        marked = np.flatnonzero([bool(m) for m in mark_of])
        if len(marked):
            kinds = {m: k for k, m in enumerate(dict.fromkeys(mark_of[k] for k in marked))}
            tails = self.whole(list(kinds))
            tail_size = np.array([len(t) for t in tails])
            tail_at = self._store(np.concatenate(tails)) + np.cumsum(tail_size) - tail_size
            t = np.array([kinds[mark_of[k]] for k in marked])
            both = np.stack([size[marked], tail_size[t]], axis=1).ravel()
            origin = np.stack([start[marked], tail_at[t]], axis=1).ravel()
            ends = np.cumsum(both)
            size[marked] += tail_size[t]
            ends_of = np.cumsum(size[marked])
            start[marked] = self._store(self.flat[np.repeat(origin - (ends - both), both) + np.arange(ends[-1])]) + ends_of - size[marked]
        return start, size

    def _regular(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that are " word" pieces throughout: single spaces and newlines between visible characters, no
        other white space or script, no added token."""
        bad = _ODD[data] | _after_c2(data)
        sep = _SEPARATES[data]
        bad[1:] |= sep[1:] & sep[:-1]  # (two texts whose separators meet are irregular at these edges anyway)
        full = np.diff(off) > 0
        bad[off[:-1][full]] |= sep[off[:-1][full]]
        bad[off[1:][full] - 1] |= sep[off[1:][full] - 1]
        regular = full & (np.diff(np.concatenate(([0], np.cumsum(bad)))[off]) == 0)
        raw = data.tobytes() if self.added else b""
        for t in self.added:
            at = raw.find(t)
            while at >= 0:
                regular[np.searchsorted(off, at, side="right") - 1] = False
                at = raw.find(t, at + 1)
        return regular if self.line is not None else np.zeros(len(full), bool)

    def _pieces(self, data: np.ndarray, off: np.ndarray, regular: np.ndarray):
        """(bytes, where each piece begins in them and the end, pieces per text) of the regular texts.

        A piece's key is its bytes, after \x01 where it opens a text and after the newline it follows; so the
        keys lie one after the other in the bytes without spaces, with \x01 put before each text.
        """
        inside = np.repeat(regular, np.diff(off))
        keep = inside & (data != 0x20)
        kept = np.concatenate(([0], np.cumsum(keep)))
        heads = off[:-1][regular]
        begins = inside & (data == 0x0A)
        begins[1:] |= inside[1:] & (data[:-1] == 0x20)
        begins[heads] = True
        at = np.flatnonzero(begins)
        text = np.searchsorted(heads, at, side="right")  # texts so far, this one included
        opens = np.zeros(len(data), bool)
        opens[heads] = True
        body = np.insert(data[keep], kept[heads], 0x01)
        bounds = np.append(kept[at] + text - opens[at], len(body))
        count = np.zeros(len(off) - 1, np.int64)
        count[regular] = np.bincount(text - 1, minlength=len(heads))
        return body, bounds, count

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text) of UTF-8 texts given as bytes and offsets."""
        n = len(off) - 1
        regular = self._regular(data, off)
        body, bounds, count = self._pieces(data, off, regular)
        if self.n > MEMORY:
            self.forget()
        hashes, first, each = np.unique(word_hashes(body, bounds[:-1], bounds[1:]), return_index=True, return_inverse=True)
        start, size = self._find(hashes)
        miss = np.flatnonzero(start < 0)
        if len(miss):
            raw = body.tobytes()
            start[miss], size[miss] = self._learn([raw[a:b].decode() for a, b in zip(bounds[first[miss]].tolist(), bounds[first[miss] + 1].tolist(), strict=True)])
            self._remember(hashes[miss], start[miss], size[miss])
        start, size = start[each], size[each]
        at = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(start - at[:-1], size) + np.arange(at[-1])] if len(each) else np.zeros(0, np.uint32)
        ends = np.concatenate(([0], np.cumsum(count)))
        sizes = np.diff(at[ends])
        rest = np.flatnonzero(~regular & (np.diff(off) > 0)).tolist()
        if rest:
            raw = data.tobytes()
            parts = dict(zip(rest, self.whole([raw[off[i]:off[i + 1]].decode() for i in rest]), strict=True))
            cut = np.concatenate(([0], np.cumsum(sizes)))
            ids = np.concatenate([parts[i] if i in parts else ids[cut[i]:cut[i + 1]] for i in range(n)])
            for i, p in parts.items():
                sizes[i] = len(p)
        return ids, sizes


class _Known:
    """Sorted hashes of pieces with their places."""

    def __init__(self, keys=None, start=None, size=None):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.start = np.zeros(0, np.int64) if start is None else start
        self.size = np.zeros(0, np.int32) if size is None else size

    def joined(self, keys, start, size) -> _Known:
        keys, first = np.unique(np.concatenate([self.keys, keys]), return_index=True)
        return _Known(keys, np.concatenate([self.start, start])[first], np.concatenate([self.size, size.astype(np.int32)])[first])


def _after_c2(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data), bool)
    out[1:] = (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
    return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    if path not in HELD:
        HELD[path] = Encoder(path)
    return HELD[path]
