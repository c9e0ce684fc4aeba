"""Token-ID files: canonical length-limited Huffman codes in independent blocks.

1. Texts are encoded once; ids (with the end id) go to a table in the shared
   folder, with their global counts (at most one row per id of the vocabulary).
2. Code lengths (at most ``MAX_BITS``) come from the counts by package-merge;
   codes are canonical, so the lengths alone describe them.
3. Documents are dealt to id ranges; each range is sorted and written as one file:
   header, document ids and sizes, bit offset of every block of ``BLOCK`` ids (the
   checkpoints), bits.  Files in part order hold the documents in ascending id order.
4. The reader decodes all blocks of a file side by side from their checkpoints,
   one table lookup per id, and cuts the ids back into documents.

Rows: null text is the empty text (the end id alone); a null document id sorts first;
rows that repeat an id are all written, in the order of their ids' checksum; an
empty table gives no files; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytestext as B
from .bpe import encoder, tokenizer_path
from .common import scratch, written
from .sharedfiles import Writer, open_input

END_ID = 0
MAX_BITS = 18
BLOCK = 4096
#: Ids per file (a bounded group).
FILE_IDS = 4 << 20
MAGIC = b"TLHUFF01"
_NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    weights, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        seq = np.argsort(both, kind="stable")
        weights = both[seq]
        kinds.append(seq < len(leaves))
    take, length = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for kind in reversed(kinds):
        n = int(kind[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = lengths[order].astype(np.int64)
    for size in np.unique(n):
        at = order[n == size]
        code <<= int(size) - before
        codes[at] = code + np.arange(len(at))
        code += len(at)
        before = int(size)
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every block)."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros((total >> 5) + 2, np.uint64)
    for i in range(0, len(ids), 1 << 20):  # every code touches at most two 32-bit words; bits never overlap, so sums are unions
        a, c, m = at[i:i + (1 << 20)], codes[ids[i:i + (1 << 20)]].astype(np.uint64), n[i:i + (1 << 20)]
        pair = c << (64 - (a & 31) - m).astype(np.uint64)
        first = a >> 5
        base, size = int(first[0]), int(first[-1] - first[0]) + 1
        words[base:base + size] += np.bincount(first - base, weights=(pair >> np.uint64(32)).astype(np.float64), minlength=size).astype(np.uint64)
        words[base + 1:base + 1 + size] += np.bincount(first - base, weights=(pair & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size).astype(np.uint64)
    return words.astype(">u4").tobytes()[:(total + 7) // 8], at[::BLOCK]


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for every value of the next ``MAX_BITS`` bits."""
    ids = np.zeros(1 << MAX_BITS, np.uint32)
    bits = np.zeros(1 << MAX_BITS, np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = (1 << (MAX_BITS - lengths[used].astype(np.int64)))
    start = codes[used].astype(np.int64) << (MAX_BITS - lengths[used].astype(np.int64))
    at = np.repeat(start - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
    ids[at], bits[at] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, bits


def decode_bits(raw: bytes, offsets: np.ndarray, n: int, table) -> np.ndarray:
    """All blocks side by side, one id of each per step."""
    ids, bits = table
    data = np.frombuffer(raw + bytes(16), np.uint8).astype(np.uint32)
    window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    pos, top = offsets.astype(np.int64).copy(), (len(window) - 1) * 8
    out = np.zeros((BLOCK, len(offsets)), np.uint32)
    for t in range(min(BLOCK, n)):
        key = (window[pos >> 3] >> (32 - MAX_BITS - (pos & 7)).astype(np.uint32)) & np.uint32((1 << MAX_BITS) - 1)
        out[t] = ids[key]
        pos += bits[key]
        np.minimum(pos, top, out=pos)  # only the last, shorter block runs on
    return out.T.reshape(-1)[:n]


def _encode(path, end_id):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part, data, off in B.slices(batch, "text", holds=True):
                ids, sizes = coder.encode(data, off)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                rows, crc = [], []
                for a, b in zip(cut, cut[1:]):
                    x = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    crc.append(zlib.crc32(x.tobytes()))
                    rows.append(pack_ids(x))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes + 1), pa.array(np.array(crc, np.int64)), pa.array(rows, pa.binary())], names=["id", "n", "crc", "ids"])

    return run


def pack_ids(ids: np.ndarray) -> bytes:
    """A document's ids on their way: as few bytes an id as the largest needs (2 or 4), low and high bytes apart."""
    width = 2 if int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + zstandard.compress(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack_ids(blob: bytes) -> np.ndarray:
    width = blob[0]
    return np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for blob in batch.column("ids"):
            n = np.bincount(unpack_ids(blob.as_py()))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(max(len(n), 2 * len(total)) - len(total), np.int64)])
            total[:len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["token", "n"])


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files; a written table (part, file, documents, ids) of them."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    tokens = written(rows.mapInArrow(_encode(path or tokenizer_path(), end_id), "id long, n long, crc long, ids binary"), "token-rows")
    counts = tokens.select("ids").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # one row per id of the vocabulary
    top = np.zeros(int(max(counts.column("token").to_numpy(), default=0)) + 1, np.int64)
    top[counts.column("token").to_numpy()] = counts.column("n").to_numpy()
    lengths = code_lengths(top)
    total = int(top.sum())
    parts = max(1, -(-total // FILE_IDS))
    bounds = sorted({int(c) for c in tokens.approxQuantile("id", [k / parts for k in range(1, parts)], 1 / (8 * parts))}) if parts > 1 else []
    cuts = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    code = spark.sparkContext.broadcast(lengths)

    def put(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        order = np.lexsort((group.column("crc").to_numpy(), group.column("n").to_numpy(), group.column("id").to_numpy()))
        names, sizes = group.column("id").to_numpy()[order], group.column("n").to_numpy()[order]
        blobs = group.column("ids")
        ids = np.concatenate([unpack_ids(blobs[int(k)].as_py()) for k in order])
        bits, offsets = encode_bits(ids, code.value, canonical(code.value))
        name = f"part-{part:08d}.tok"
        book = zlib.compress(code.value.tobytes())
        head = json.dumps({"part": part, "documents": len(names), "ids": len(ids), "blocks": len(offsets), "block": BLOCK, "bits": len(bits), "book": len(book), "vocabulary": len(code.value)}).encode()
        out = Writer(folder, name)
        for piece in (MAGIC, len(head).to_bytes(4, "little"), head, book, names.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), bits):
            out.write(piece)
        out.close()
        return pa.table({"part": pa.array([part], pa.int32()), "file": pa.array([name]), "documents": pa.array([len(names)], pa.int64()), "ids": pa.array([len(ids)], pa.int64())})

    return written(tokens.withColumn("part", part_of("id")).repartition(parts, "part").groupBy("part").applyInArrow(put, "part int, file string, documents long, ids long"), "token-files")


def load(stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids) of one file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    head = json.loads(stream.read(int.from_bytes(stream.read(4), "little")))
    lengths = np.frombuffer(zlib.decompress(stream.read(head["book"])), np.uint8)
    names, sizes, offsets = (np.frombuffer(stream.read(8 * n), "<i8") for n in (head["documents"], head["documents"], head["blocks"]))
    bits = stream.read(head["bits"])
    if head["block"] != BLOCK or len(bits) != head["bits"] or int(sizes.sum()) != head["ids"]:
        raise ValueError("the token file is damaged")
    return names, sizes, decode_bits(bits, offsets, head["ids"], decode_table(lengths, canonical(lengths)))


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; ``ids`` as little-endian 32-bit bytes."""
    # offsets of the files: one row per file, as a range partitioner holds its bounds
    totals = {r["part"]: r["ids"] for r in files.select("part", "ids").collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    first = files.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with open_input(folder, file) as stream:
                    names, sizes, ids = load(stream)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                ids = ids.astype("<u4")
                for i in range(0, len(names), 2000):
                    raws = [ids[a:b].tobytes() for a, b in zip(cut[i:i + 2000], cut[i + 1:i + 2001])]
                    n = len(raws)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[i:i + n], mask=names[i:i + n] == _NULL_ID), pa.array(first.value[part] + cut[i:i + n]), pa.array(sizes[i:i + n]), pa.array([zlib.crc32(x) for x in raws], pa.int64()), pa.array(raws, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.repartition(max(1, len(totals)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back."""
    folder = scratch(docs.sparkSession, "tokens")
    return read(write(docs, folder, **options), folder)
