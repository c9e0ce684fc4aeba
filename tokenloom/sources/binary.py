"""Binary token formats as Python Data Sources (S3-S6), on any file system by URI.

``tokenstream``: headerless little-endian token files.  Rows (split, start, ids)
are range-partitioned by position; a task joins consecutive rows into part files
``{split}/part-{start:015d}.bin`` of up to ``part_bytes``, and the commit writes a
manifest (split, start, n_tokens, file).  The parts concatenated in manifest
order are the single stream file.  The reader takes a folder with a manifest, a
folder of parts or a single file and cuts it into rows of at most
``tokens_per_row`` tokens; a row never crosses a multiple of ``tokens_per_row``
(global offset) nor a part-file boundary.

``packedchunks``: one file per fixed-size chunk, ``{prefix}_{chunk:010d}.bin``:
a 24-byte header (magic, version, dtype code, chunk size) then the array.  The
commit writes a manifest: dtype code, chunk size and the runs of consecutive chunks
of each prefix, so neither commit nor read lists the folder; a folder without one is
listed once.  Every task validates the headers of its files against the manifest's (or
the first file's), so mixed dtypes or chunk sizes raise; ids that do not fit the on-disk dtype raise.

Both readers settle comparisons on their position columns (``split`` and ``start``,
``prefix`` and ``chunk_id``) themselves: only the parts and chunks that can hold such rows are planned and opened.

Arrays keep the dtype of the file: up to 32 bits ``array<int>``, int64
``array<bigint>``, float32/float64 ``array<float>``/``array<double>``.
"""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
                                    LessThan, LessThanOrEqual, WriterCommitMessage)

from tokenloom.sources.files import folder, get, get_json, list_files, put

# Fixed values of the packed-chunk file format.
HDR_MAGIC = b"LITPKDS"
HDR_SIZE = 24  # magic 7 + version <Q 8 + dtype code <B 1 + chunk size <Q 8
VERSION = 1
DTYPES = {1: np.uint8, 2: np.int8, 3: np.int16, 4: np.int32, 5: np.int64, 6: np.float32, 7: np.float64,
          8: np.uint16}
NAMES = {"uint8": 1, "int8": 2, "int16": 3, "int32": 4, "int64": 5, "float32": 6, "float64": 7, "uint16": 8}
MANIFEST = "_manifest.json"
PART_BYTES = 64 << 20


def choose_dtype(dtype: str, vocab_size: int | None) -> int:
    """dtype code; ``auto`` = uint16 below 65500 pieces, else int32."""
    if dtype == "auto":
        if vocab_size is None:
            raise ValueError("vocab_size cannot be None when dtype='auto'")
        return 8 if vocab_size < 65500 else 4
    return NAMES[dtype]


def column_type(code: int) -> tuple[str, np.dtype]:
    """(SQL element type, in-memory dtype) that holds every value of a dtype code."""
    kind = np.dtype(DTYPES[code])
    if kind.kind == "f":
        return ("float", np.dtype(np.float32)) if kind.itemsize == 4 else ("double", np.dtype(np.float64))
    return ("bigint", np.dtype(np.int64)) if kind.itemsize == 8 else ("int", np.dtype(np.int32))


def _little(code: int) -> np.dtype:
    return np.dtype(DTYPES[code]).newbyteorder("<")


def _check_range(arr: np.ndarray, code: int) -> None:
    dt = np.dtype(DTYPES[code])
    if dt.kind not in "iu" or not len(arr):
        return
    if arr.dtype.kind == "f" and (arr != np.rint(arr)).any():
        raise ValueError(f"values are not whole numbers, {dt.name} would cut them")
    info = np.iinfo(dt)
    if arr.min() < info.min or arr.max() > info.max:
        raise ValueError(f"token id out of range for {dt.name}: [{arr.min()}, {arr.max()}]")


def parse_header(head: bytes, path: str) -> tuple[int, int]:
    """(dtype code, chunk size) of a packed chunk file."""
    if len(head) < HDR_SIZE or head[:7] != HDR_MAGIC:
        raise ValueError(f"{path}: not a packed chunk file (bad magic)")
    (version,) = struct.unpack("<Q", head[7:15])
    if version != VERSION:
        raise ValueError(f"{path}: unsupported version {version}")
    (code,) = struct.unpack("<B", head[15:16])
    if code not in DTYPES:
        raise ValueError(f"{path}: unknown dtype code {code}")
    (chunk_size,) = struct.unpack("<Q", head[16:24])
    return code, chunk_size


class Where:
    """A conjunction of comparisons with constants on some columns, as pushed by the planner."""

    TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
             LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, IsNotNull: lambda x, v: True}

    def __init__(self, *columns: str):
        self.columns, self.terms = columns, []

    def push(self, filters) -> list:
        """Take what can be settled here; the rest is returned for Spark."""
        rest = []
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) in self.TESTS and f.attribute[0] in self.columns and len(f.attribute) == 1 and (value is not None or isinstance(f, IsNotNull)):
                self.terms.append((type(f).__name__, f.attribute[0], value))
            else:
                rest.append(f)
        return rest

    def holds(self, column: str, x) -> bool:
        tests = {k.__name__: t for k, t in self.TESTS.items()}
        return all(tests[kind](x, v) for kind, c, v in self.terms if c == column)

    def bounds(self, column: str) -> tuple[float, float]:
        """Closed bounds of the whole numbers that can hold."""
        lo, hi = -np.inf, np.inf
        for kind, c, v in self.terms:
            if c != column or kind == "IsNotNull":
                continue
            least, most = (min(v), max(v)) if kind == "In" else (v, v)
            if kind in ("EqualTo", "In", "GreaterThan", "GreaterThanOrEqual"):
                lo = max(lo, least + (kind == "GreaterThan"))
            if kind in ("EqualTo", "In", "LessThan", "LessThanOrEqual"):
                hi = min(hi, most - (kind == "LessThan"))
        return lo, hi


# ------------------------------------------------------------ tokenstream ----

class _Segments(InputPartition):
    """Consecutive ranges (split, file, file start offset, lo, hi) of the stream."""

    def __init__(self, segments: list[tuple[str, str, int, int, int]]):
        self.segments = segments


class TokenStreamReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.code = NAMES[options.get("dtype", "uint16")]
        self.per_row = int(options.get("tokens_per_row", 4096))
        self.rows_per_partition = int(options.get("rows_per_partition", 64))
        self.where = Where("split", "start")

    def pushFilters(self, filters):
        return self.where.push(filters)

    def _rows(self, start: int, end: int) -> tuple[int, int]:
        """The part of a file's tokens whose rows begin inside the pushed bounds."""
        lo, hi = self.where.bounds("start")
        if lo > start:
            start = -(-int(min(lo, end)) // self.per_row) * self.per_row
        if hi < end:
            end = min(end, (int(hi) // self.per_row + 1) * self.per_row) if hi >= start else start
        return start, end

    def _files(self):
        """(split, file, start token offset, n tokens) in stream order; a manifest spares the listing."""
        import pyarrow.fs as pafs
        fs, root = folder(self.path)
        size = _little(self.code).itemsize
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [(info.base_name.rsplit(".", 1)[0], root, 0, info.size // size)]
        manifest = get_json(fs, f"{root}/{MANIFEST}")
        if manifest is not None:
            return sorted((m["split"], f"{root}/{m['file']}", m["start"], m["n_tokens"]) for m in manifest)
        splits = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory)
        return [(d.rsplit("/", 1)[1], f, int(f.rsplit("/part-", 1)[1][:-4]), n // size) for d in splits for f, n in list_files(fs, d, ".bin")]

    def partitions(self):
        """Cut big files at multiples of the partition span and pack small
        consecutive parts together, so every task reads about one span."""
        span = self.per_row * self.rows_per_partition
        parts, cur, cur_n = [], [], 0
        for split, path, start, n in self._files():
            if not self.where.holds("split", split):
                continue
            lo, end = self._rows(start, start + n)
            while lo < end:
                hi = min(end, (lo // span + 1) * span)
                cur.append((split, path, start, lo, hi))
                cur_n += hi - lo
                lo = hi
                if cur_n >= span:
                    parts.append(_Segments(cur))
                    cur, cur_n = [], 0
        if cur or not parts:  # the planner wants one partition at least
            parts.append(_Segments(cur))
        return parts

    def read(self, p: _Segments):
        import pyarrow as pa
        fs, _ = folder(self.path)
        kind, memory = _little(self.code), column_type(self.code)[1]
        splits, starts, pieces = [], [], []
        for split, path, file_start, lo, hi in p.segments:
            raw = get(fs, path, (lo - file_start) * kind.itemsize, (hi - lo) * kind.itemsize)
            arr = np.frombuffer(raw, dtype=kind).astype(memory)
            if len(arr) != hi - lo:
                raise ValueError(f"{path}: shorter than its manifest says")
            a = lo
            while a < hi:
                b = min(hi, (a // self.per_row + 1) * self.per_row)
                if self.where.holds("start", a):
                    splits.append(split)
                    starts.append(a)
                    pieces.append(arr[a - lo:b - lo])
                a = b
        if not pieces:
            return
        offs = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(pieces)))
        yield pa.RecordBatch.from_arrays([pa.array(splits), pa.array(starts, pa.int64()), ids],
                                         names=["split", "start", "ids"])


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


def _lists(batch, col: str):
    """(offsets, values) numpy views of a list column of an Arrow batch, in the values' own dtype."""
    arr = batch.column(batch.schema.get_field_index(col))
    return arr.offsets.to_numpy(), arr.values.to_numpy(zero_copy_only=False)


class TokenStreamWriter(DataSourceArrowWriter):
    """Arrow batches of (split, start, ids), sorted by position within a task -> part files and the manifest."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.code = NAMES[options.get("dtype", "uint16")]
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.overwrite = overwrite

    def write(self, batches):
        fs, root = folder(self.path, create=True)
        files, dt, held, size, at = [], _little(self.code), [], 0, None

        def flush():
            nonlocal held, size, at
            if held:
                split, start, n = at
                name = f"{split}/part-{start:015d}.bin"
                fs.create_dir(f"{root}/{split}", recursive=True)
                put(fs, f"{root}/{name}", b"".join(held))
                files.append({"split": split, "start": start, "n_tokens": n, "file": name})
            held, size, at = [], 0, None

        for b in batches:
            offs, vals = _lists(b, "ids")
            _check_range(vals[offs[0]:offs[-1]], self.code)
            splits = b.column(b.schema.get_field_index("split")).to_pylist()
            starts = b.column(b.schema.get_field_index("start")).to_pylist()
            for i, (split, start) in enumerate(zip(splits, starts, strict=True)):
                raw = vals[offs[i]:offs[i + 1]].astype(dt).tobytes()
                n = len(raw) // dt.itemsize
                if at is None or at[0] != split or at[1] + at[2] != start or size + len(raw) > self.part_bytes:
                    flush()
                    at = (split, int(start), 0)
                held.append(raw)
                size += len(raw)
                at = (at[0], at[1], at[2] + n)
        flush()
        return _Written(files)

    def commit(self, messages):
        """The manifest names the files of this write (after those that are kept); overwritten parts go."""
        fs, root = folder(self.path, create=True)
        old = get_json(fs, f"{root}/{MANIFEST}") or []
        new = [f for m in messages if m is not None for f in m.files]
        names = {f["file"] for f in new}
        kept = [] if self.overwrite else [f for f in old if f["file"] not in names]
        put(fs, f"{root}/{MANIFEST}", json.dumps(sorted(kept + new, key=lambda f: (f["split"], f["start"]))).encode())
        for f in old if self.overwrite else []:
            if f["file"] not in names:
                fs.delete_file(f"{root}/{f['file']}")

    def abort(self, messages):
        """Files of a failed write are not in the manifest; those that no manifest names go."""
        fs, root = folder(self.path)
        kept = {f["file"] for f in get_json(fs, f"{root}/{MANIFEST}") or []}
        for m in messages:
            for f in m.files if m is not None else []:
                if f["file"] not in kept:
                    fs.delete_file(f"{root}/{f['file']}")


class TokenStreamSource(DataSource):
    @classmethod
    def name(cls):
        return "tokenstream"

    def schema(self):
        return f"split string, start bigint, ids array<{column_type(NAMES[self.options.get('dtype', 'uint16')])[0]}>"

    def reader(self, schema):
        return TokenStreamReader(self.options)

    def writer(self, schema, overwrite):
        return TokenStreamWriter(self.options, overwrite)


# ------------------------------------------------------------ packed chunks --

class _Files(InputPartition):
    """Runs (prefix, first chunk, last chunk) of consecutive chunk files."""

    def __init__(self, runs: list[tuple[str, int, int]]):
        self.runs = runs


def chunk_file(prefix: str, chunk_id: int) -> str:
    return f"{prefix}_{chunk_id:010d}.bin"


def runs_of(chunks) -> list[tuple[str, int, int]]:
    """Runs of consecutive ids per prefix of (prefix, first, last) entries, overlaps merged."""
    out: list[tuple[str, int, int]] = []
    for prefix, first, last in sorted(chunks):
        if out and out[-1][0] == prefix and first <= out[-1][2] + 1:
            out[-1] = (prefix, out[-1][1], max(out[-1][2], last))
        else:
            out.append((prefix, first, last))
    return out


def packed_summary(path: str) -> tuple[tuple[int, int], list[tuple[str, int, int]]]:
    """((dtype code, chunk size), runs) of a folder of chunk files: its manifest, or one listing and the first header."""
    fs, root = folder(path)
    manifest = get_json(fs, f"{root}/{MANIFEST}")
    if manifest is not None:
        return (manifest["dtype_code"], manifest["chunk_size"]), [tuple(r) for r in manifest["runs"]]
    files = list_files(fs, root, ".bin")
    if not files:
        return (4, 0), []
    names = [f.rsplit("/", 1)[1][:-4].rsplit("_", 1) for f, _ in files]
    return parse_header(get(fs, files[0][0], 0, HDR_SIZE), files[0][0]), runs_of((p, int(c), int(c)) for p, c in names)


class PackedReader(DataSourceReader):
    def __init__(self, options, summary):
        self.path = options["path"]
        self.prefix = options.get("prefix")
        self.files_per_partition = int(options.get("files_per_partition", 256))
        self.expected, self.runs = summary
        self.where = Where("prefix", "chunk_id")

    def pushFilters(self, filters):
        return self.where.push(filters)

    def partitions(self):
        lo, hi = self.where.bounds("chunk_id")
        parts, held, n = [], [], 0
        for prefix, first, last in self.runs:
            if (self.prefix is not None and prefix != self.prefix) or not self.where.holds("prefix", prefix):
                continue
            first, last = int(max(first, lo)), int(min(last, hi))
            while first <= last:
                upto = min(last, first + self.files_per_partition - n - 1)
                held.append((prefix, first, upto))
                n += upto - first + 1
                first = upto + 1
                if n == self.files_per_partition:
                    parts.append(_Files(held))
                    held, n = [], 0
        return parts + ([_Files(held)] if held or not parts else [])  # the planner wants one partition at least

    def read(self, p: _Files):
        import pyarrow as pa
        fs, root = folder(self.path)
        prefixes, counters, arrays = [], [], []
        code, chunk_size = self.expected
        for prefix, counter in ((x, c) for x, first, last in p.runs for c in range(first, last + 1)):
            if not self.where.holds("chunk_id", counter):
                continue
            path = f"{root}/{chunk_file(prefix, counter)}"
            raw = get(fs, path)
            if (found := parse_header(raw[:HDR_SIZE], path)) != self.expected:
                raise ValueError(f"packed files disagree on (dtype code, chunk size): {path} has {found}, others {self.expected}")
            arr = np.frombuffer(raw, dtype=_little(code), offset=HDR_SIZE)
            if len(arr) != chunk_size:
                raise ValueError(f"{path}: payload has {len(arr)} items, header says {chunk_size}")
            prefixes.append(prefix)
            counters.append(counter)
            arrays.append(arr.astype(column_type(code)[1]))
        if not arrays:
            return
        offs = (np.arange(len(arrays) + 1) * chunk_size).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(arrays)))
        n = len(arrays)
        yield pa.RecordBatch.from_arrays(
            [pa.array(prefixes), pa.array(counters, pa.int64()), pa.array([code] * n, pa.int32()), pa.array([chunk_size] * n, pa.int64()), ids],
            names=["prefix", "chunk_id", "dtype_code", "chunk_size", "ids"])


class PackedWriter(DataSourceArrowWriter):
    """Arrow batches of (prefix, chunk_id, ids) -> one file per chunk.  ids
    must be exactly ``chunk_size`` long (pack() fills the last chunk)."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.code = choose_dtype(options.get("dtype", "auto"),
                                 int(options["vocab_size"]) if "vocab_size" in options else None)
        self.chunk_size = int(options["chunk_size"])
        self.overwrite = overwrite

    def write(self, batches):
        fs, root = folder(self.path, create=True)
        files, dt = [], _little(self.code)
        head = HDR_MAGIC + struct.pack("<Q", VERSION) + struct.pack("<B", self.code) + struct.pack("<Q", self.chunk_size)
        for b in batches:
            offs, vals = _lists(b, "ids")
            sizes = np.diff(offs)
            prefixes = b.column(b.schema.get_field_index("prefix")).to_pylist()
            chunk_ids = b.column(b.schema.get_field_index("chunk_id")).to_pylist()
            if len(sizes) and (sizes != self.chunk_size).any():
                bad = int(np.nonzero(sizes != self.chunk_size)[0][0])
                raise ValueError(f"chunk {chunk_ids[bad]} has {sizes[bad]} ids, expected {self.chunk_size}")
            _check_range(vals[offs[0]:offs[-1]], self.code)
            for i, (prefix, cid) in enumerate(zip(prefixes, chunk_ids, strict=True)):
                put(fs, f"{root}/{chunk_file(prefix, int(cid))}", head + vals[offs[i]:offs[i + 1]].astype(dt).tobytes())
                files.append((prefix, int(cid), int(cid)))
        return _Written(runs_of(files))

    def commit(self, messages):
        """The manifest of this write, after the chunks that are kept (whose header stays: a chunk of another dtype or
        size raises when it is read); with overwrite, those that were there before go."""
        fs, root = folder(self.path, create=True)
        new = runs_of(r for m in messages if m is not None for r in m.files)
        expected, old = packed_summary(self.path)
        code, chunk_size = expected if old and not self.overwrite else (self.code, self.chunk_size)
        manifest = {"dtype_code": code, "chunk_size": chunk_size, "runs": new if self.overwrite else runs_of(old + new)}
        put(fs, f"{root}/{MANIFEST}", json.dumps(manifest).encode())
        for prefix, first, last in old if self.overwrite else []:
            kept = [(a, b) for p, a, b in new if p == prefix]
            for c in range(first, last + 1):
                if not any(a <= c <= b for a, b in kept):
                    fs.delete_file(f"{root}/{chunk_file(prefix, c)}")


class PackedSource(DataSource):
    @classmethod
    def name(cls):
        return "packedchunks"

    def _summary(self):
        return packed_summary(self.options["path"])

    def schema(self):
        return f"prefix string, chunk_id bigint, dtype_code int, chunk_size bigint, ids array<{column_type(self._summary()[0][0])[0]}>"

    def reader(self, schema):
        return PackedReader(self.options, self._summary())

    def writer(self, schema, overwrite):
        return PackedWriter(self.options, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenStreamSource)
    spark.dataSource.register(PackedSource)


def write_token_stream(df, path: str, dtype: str = "uint16", mode: str = "overwrite", part_bytes: int = PART_BYTES) -> None:
    """S3: rows (split, start, ids) -> part files and a manifest."""
    register(df.sparkSession)
    rows = df.select("split", "start", "ids").repartitionByRange("split", "start").sortWithinPartitions("split", "start")
    rows.write.format("tokenstream").mode(mode).option("path", path).option("dtype", dtype).option("part_bytes", part_bytes).save()


def read_token_stream(spark, path: str, dtype: str = "uint16", tokens_per_row: int = 4096):
    """(split, start, ids) rows of a token stream folder or file."""
    register(spark)
    return spark.read.format("tokenstream").option("path", path).option("dtype", dtype) \
        .option("tokens_per_row", tokens_per_row).load()


def read_token_range(spark, path: str, split: str, lo: int, hi: int, dtype: str = "uint16", tokens_per_row: int = 4096):
    """Rows (start, ids) of the tokens [lo, hi) of a split; only parts that hold them are opened."""
    rows = read_token_stream(spark, path, dtype, tokens_per_row)
    # a row starts at a multiple of tokens_per_row or where its part starts, so at most that far before ``lo``
    rows = rows.where((F.col("split") == split) & (F.col("start") > lo - tokens_per_row) & (F.col("start") < hi) & (F.col("start") + F.size("ids") > lo))
    a, b = F.greatest("start", F.lit(lo)), F.least(F.col("start") + F.size("ids"), F.lit(hi))
    return rows.select(a.cast("bigint").alias("start"), F.slice("ids", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")).alias("ids"))


def write_packed(df, path: str, chunk_size: int, dtype: str = "auto", vocab_size: int | None = None, mode: str = "append") -> None:
    """Rows (prefix, chunk_id, ids) -> ``{prefix}_{chunk:010d}.bin`` files."""
    register(df.sparkSession)
    w = df.select("prefix", "chunk_id", "ids").write.format("packedchunks").mode(mode) \
        .option("path", path).option("dtype", dtype).option("chunk_size", chunk_size)
    if vocab_size is not None:
        w = w.option("vocab_size", vocab_size)
    w.save()


def read_packed(spark, path: str, prefix: str | None = None):
    """Every chunk file, header validated."""
    register(spark)
    r = spark.read.format("packedchunks").option("path", path)
    if prefix:
        r = r.option("prefix", prefix)
    return r.load()
