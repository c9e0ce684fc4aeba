"""Streaming tokenise + pack (X1) and streaming run metrics.

Sinks are written by ``foreachBatch`` into ``{out}/batch={id}`` (a retried batch
overwrites its own folder).  Closed chunks are appended once and never written again;
provisional rows (tails, windows, rates) are versions of which readers keep the last.
Keyed state is kept by ``transformWithStateInPandas`` in RocksDB; restart is from the
checkpoint location.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tokenloom.operators.tokenize import Tokenizer
from tokenloom.session import bounded_batches

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """Keyed list and value state needs the RocksDB store; the session's own setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before is not None else spark.conf.unset(_STORE)


def _folder_sink(out: str, by: list[str] | None = None):
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        (rows.partitionBy(*by) if by else rows).parquet(f"{out}/batch={batch_id}")
    return write


def _run(rows: DataFrame, out: str, checkpoint: str, by: list[str] | None = None) -> None:
    """All input that is there now, in update mode, to the folder sink."""
    q = (rows.writeStream.foreachBatch(_folder_sink(out, by)).option("checkpointLocation", checkpoint)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()


def _versions(spark: SparkSession, out: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", out)
    return (reader.schema(schema) if schema else reader).parquet(f"{out}/batch=*")


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Read a sink of versions: the row of the last batch for every key (one version per key and
    batch), by a partial aggregation."""
    d = _versions(spark, out).drop("batch")
    rest = [c for c in d.columns if c not in (*keys, "batch_id")]
    best = d.groupBy(*keys).agg(F.max_by(F.struct("batch_id", *rest), "batch_id").alias("_v"))
    return best.select(*keys, "_v.*")


# ---------------------------------------------------------------- X1 pack --

PACK_OUT = "source string, lane int, chunk_id bigint, n_tokens int, ids array<int>, closed boolean"
#: Closed chunks that a task hands over at a time.
PACK_ROWS = 64
#: Tokens of a lane's micro-batch up to this size wait in memory, more of them in a temporary file.
SPOOL_BYTES = 4 << 20


def _entry(ids: np.ndarray) -> tuple[bytes]:
    return (ids.astype("<i4").tobytes(),)


class Packer(StatefulProcessor):
    """Packs one (source, lane): the tail is list state, one entry per document's tokens, to which
    new documents are appended; it is replaced only when a chunk closes."""

    def __init__(self, chunk_size: int, sep: int):
        self.chunk_size, self.sep = chunk_size, sep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next_chunk bigint, held int")
        self.tail = handle.getListState("tail", "ids binary")  # little-endian 32-bit ids

    def _rows(self, key, first: int, chunks: np.ndarray) -> pd.DataFrame:
        n = len(chunks)
        return pd.DataFrame({"source": [key[0]] * n, "lane": np.full(n, key[1], np.int32), "chunk_id": np.arange(first, first + n),
                             "n_tokens": np.full(n, self.chunk_size, np.int32), "ids": list(chunks), "closed": [True] * n})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size = self.chunk_size
        nxt, held = self.at.get() if self.at.exists() else (0, 0)
        kept = [np.frombuffer(t[0], "<i4") for t in self.tail.get()] if held else []
        buffer, have, old = list(kept), held, len(kept)
        # the lane's documents wait in a temporary file, so memory holds places and at most PACK_ROWS chunks of tokens
        with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as waiting:
            docs = []
            for pdf in rows:
                for d, x in zip(pdf["doc_id"], pdf["ids"], strict=True):
                    docs.append((d, waiting.tell(), len(x)))
                    waiting.write(np.asarray(x, "<i4").tobytes())
            docs.sort(key=lambda d: (d[0] is not None and d[0] == d[0], d[0]))  # arrival order inside a batch
            closes = held + sum(d[2] for d in docs) >= size
            for i, (_, at, n) in enumerate(docs):
                waiting.seek(at)
                while n:  # a long document in parts
                    x = np.frombuffer(waiting.read(4 * min(n, size * PACK_ROWS)), "<i4")
                    n -= len(x)
                    buffer.append(x)
                    have += len(x)
                    if have >= size * PACK_ROWS or (i + 1 == len(docs) and not n and have >= size):
                        stream = np.concatenate(buffer)
                        full = len(stream) // size
                        yield self._rows(key, nxt, stream[:full * size].reshape(full, size))
                        nxt, buffer = nxt + full, [stream[full * size:]]
                        have = len(buffer[0])
        if closes:
            self.tail.put([_entry(x) for x in buffer if len(x)]) if have else self.tail.clear()
        else:
            self.tail.appendList([_entry(x) for x in buffer[old:] if len(x)])
        self.at.update((nxt, have))
        # the tail so far: this version replaces the one before; an empty one takes it back
        ids = np.concatenate([*buffer, np.full(size - have, self.sep, np.int32)]) if have else np.zeros(0, np.int32)
        yield pd.DataFrame({"source": [key[0]], "lane": np.array([key[1]], np.int32), "chunk_id": [nxt], "n_tokens": np.array([have], np.int32), "ids": [ids], "closed": [False]})


def stream_pack(sdf: DataFrame, key: str, tok: Tokenizer, chunk_size: int, sep: int, out: str, checkpoint: str, lanes: int = 1,
                lane: Column | None = None) -> None:
    """Per (``key``, lane) concatenate tokenised rows in arrival order (doc_id order inside a
    micro-batch) and emit fixed-size chunks.  ``lanes`` sub-streams per source (by a hash of the id
    unless ``lane`` says otherwise) spread a hot source over as many tasks, each of which orders its own
    lane's part of one micro-batch in a temporary file (memory holds an id and a place per document)."""
    where = lane if lane is not None else F.pmod(F.xxhash64("doc_id"), F.lit(lanes))
    t = sdf.select(F.col(key).alias("source"), where.cast("int").alias("lane"), "doc_id",
                   F.concat(tok.encode(F.col("text")), F.array(F.lit(tok.eos_id))).alias("ids"))
    bounded_batches(sdf.sparkSession)
    with _rocksdb(sdf.sparkSession):
        packed = t.groupBy("source", "lane").transformWithStateInPandas(Packer(chunk_size, sep), PACK_OUT, "Update", "None")
        _run(packed, out, checkpoint, ["closed"])


def packed_chunks(spark: SparkSession, out: str) -> DataFrame:
    """(source, lane, chunk_id, n_tokens, ids) of a stream_pack sink: closed chunks as they are, and the last
    version of each lane's tail; only the tails are grouped."""
    d = _versions(spark, out, PACK_OUT + ", batch bigint")
    tails = d.where("NOT closed").groupBy("source", "lane").agg(F.max_by(F.struct("chunk_id", "n_tokens", "ids"), "batch").alias("t"))
    return d.where("closed").select("source", "lane", "chunk_id", "n_tokens", "ids").unionByName(
        tails.where("t.n_tokens > 0").select("source", "lane", "t.*"))


# ------------------------------------------------------------- X2 metrics --

def stream_metrics(sdf: DataFrame, ts: str, keys: list[str], value: str, window: str, slide: str | None,
                   watermark: str, out: str, checkpoint: str) -> None:
    """Windowed count, total, mean and records per second per key with a watermark; rows later than the
    watermark are dropped (Spark's rule).  Update mode into the upsert sink."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    agg = (sdf.withWatermark(ts, watermark).groupBy(w.alias("w"), *keys)
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value)).alias("total"), F.avg(F.col(value)).alias("mean")))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    flat = agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *keys, "n", "total", "mean",
                      (F.col("n") / seconds).alias("per_sec"))
    _run(flat, out, checkpoint)


#: Groups of runs that share one state entry, fixed for a checkpoint's life.
RUN_GROUPS = 1024
#: Records of one state entry's part, and of one batch handed over.
STATE_ROWS, RATE_ROWS = 1 << 13, 1 << 13


class RateWindow(StatefulProcessor):
    """Rates of each run of a group over its last ``window`` records, from a ring buffer of records in time order per run.

    A buffer keeps ``window - 1`` records more than the ``late`` newest ones, so a record that comes
    up to ``late`` records late finds its place and its whole window; the rates from there on
    are emitted again.  Records that come later than that are marked as dropped.  The state calls of
    a micro-batch are made once per group, whatever the number of its runs.
    """

    def __init__(self, counters: list[str], window: int, late: int):
        self.counters, self.window, self.late = counters, window, late
        self.record = np.dtype([("none", "?"), ("run", "<i8"), ("t", "<f8"), ("tie", "<i8"), ("add", "<f8", (len(counters),)), ("cut", "?")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rings = handle.getListState("rings", "records binary")  # of all runs of the group, one after the other

    def _records(self, pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(pdf), self.record)
        for c in ("none", "run", "tie"):
            out[c] = pdf[c].astype(self.record[c])
        out["t"] = pdf["t"].astype("f8")
        out["add"] = pdf[self.counters].to_numpy("f8")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [np.frombuffer(r[0], self.record) for r in self.rings.get()] if self.rings.exists() else []
        new = [self._records(pdf) for pdf in rows]
        came = np.repeat([False, True], [sum(map(len, old)), sum(map(len, new))])
        all_ = np.concatenate(old + new)
        order = np.lexsort((came, *all_["add"].T[::-1], all_["tie"], all_["t"], all_["run"], all_["none"]))
        all_, came = all_[order], came[order]
        edge = np.flatnonzero((all_["run"][1:] != all_["run"][:-1]) | (all_["none"][1:] != all_["none"][:-1])) + 1
        kept, out, n = [], [], 0
        for a, b in zip([0, *edge], [*edge, len(all_)], strict=True):
            ring, made = self._run(all_[a:b], came[a:b])
            kept.append(ring)
            out += made
            n += sum(len(r) for r, _, _ in made)
            if n >= RATE_ROWS:
                yield self._frame(out)
                out, n = [], 0
        if out:
            yield self._frame(out)
        rings = np.concatenate(kept)
        self.rings.put([(rings[i:i + STATE_ROWS].tobytes(),) for i in range(0, len(rings), STATE_ROWS)])

    def _run(self, r: np.ndarray, came: np.ndarray) -> tuple[np.ndarray, list]:
        """One run's records, old and new in order -> (its ring buffer, [(records, rates, dropped)])."""
        cut, made = bool(r["cut"].any()), []
        if cut and came.any():
            # with records already let go, a place before the first whole window comes too late
            limit = r[~came][self.window - 1]
            late = came & ((r["t"] < limit["t"]) | ((r["t"] == limit["t"]) & (r["tie"] < limit["tie"])))
            if late.any():
                made.append((r[late], np.full((late.sum(), len(self.counters)), np.nan), True))
                r, came = r[~late], came[~late]
        if not came.any():
            return r, made
        first = int(came.argmax())
        total = np.cumsum(r["add"], axis=0)
        at = np.arange(first, len(r))
        back = np.maximum(at - self.window + 1, 0)
        dt = r["t"][at] - r["t"][back]
        made.append((r[first:], (total[at] - total[back]) / np.where(dt > 0, dt, np.nan)[:, None], False))
        keep = self.window - 1 + self.late
        ring = r[-keep:].copy()
        ring["cut"] = cut or len(r) > keep
        return ring, made

    def _frame(self, made: list) -> pd.DataFrame:
        r, rates = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        out = pd.DataFrame({"run": pd.Series(r["run"]).astype("Int64").mask(r["none"]), "t": r["t"], "tie": r["tie"]})
        for i, c in enumerate(self.counters):
            out[f"{c}_per_sec"] = rates[:, i]
        out["dropped"] = np.repeat([m[2] for m in made], [len(m[0]) for m in made])
        return out


def stream_throughput(sdf: DataFrame, run: str, t: Column, tie: str, counters: dict[str, Column], out: str, checkpoint: str, window: int = 50,
                      late: int = 50) -> None:
    """X2 by records: W1 on a log as it arrives.  ``t`` is in seconds, ``tie`` (unique in a run) orders
    records of one time, ``counters`` are what each record adds; rates are (last - first) / (t_last -
    t_first) over the last ``window`` records, NULL while no time has passed."""
    d = sdf.select(F.col(run).cast("bigint").alias("run"), t.cast("double").alias("t"), F.col(tie).cast("bigint").alias("tie"),
                   *[c.cast("double").alias(k) for k, c in counters.items()])
    d = d.select(F.pmod(F.xxhash64("run"), F.lit(RUN_GROUPS)).alias("group"), F.col("run").isNull().alias("none"),
                 F.coalesce("run", F.lit(0)).alias("run"), "t", "tie", *counters)
    schema = "run bigint, t double, tie bigint, " + ", ".join(f"{c}_per_sec double" for c in counters) + ", dropped boolean"
    with _rocksdb(sdf.sparkSession):
        rates = d.groupBy("group").transformWithStateInPandas(RateWindow(list(counters), window, late), schema, "Update", "None")
        _run(rates, out, checkpoint)


# -------------------------------------------------------- S8 stream sink --

def stream_metric_log(sdf: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """S8 (streaming form): append metric rows ``(run, step, ts, metric,
    value)`` to a CSV log with a header.  The file sink's metadata log makes
    the output exactly-once across restarts; ``read_metrics`` reads it."""
    w = (sdf.select("run", "step", "ts", "metric", "value").writeStream.format("csv")
         .option("header", True).option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    q = w.trigger(availableNow=True).start() if trigger_once else w.start()
    if trigger_once:
        q.awaitTermination()
    return q
