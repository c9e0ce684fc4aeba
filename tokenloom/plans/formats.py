"""Source/sink round trips derived from ``documents``: gzipped JSON lines,
token stream part files, packed chunk files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators.tokenize import ByteTokenizer
from tokenloom.plans.common import CHUNK, SEP, STREAM_CTE, ids_md5, table
from tokenloom.plans.corpus import ORACLE as CORPUS_ORACLE
from tokenloom.plans.corpus import packed_chunks
from tokenloom.session import scratch_path
from tokenloom.sources.binary import read_packed, read_token_range, read_token_stream, write_packed, write_token_stream
from tokenloom.sources.tables import read_corpus, write_corpus_jsonl_gz

RANGE = (30_000, 50_000)  # S4 range


def q_s2_corpus_jsonl_gz(spark, sf):
    path = scratch_path(spark, "corpus-jsonl")
    write_corpus_jsonl_gz(table(spark, sf, "documents").select("doc_id", "text"), path)
    d = read_corpus(spark, f"{path}/*.json.gz", "json", "text", "doc_id", min_partitions=8)
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"))


def q_s1_row_ids(spark, sf):
    """JSON lines without ids, as a web corpus has them: rows are numbered by file and position."""
    path = scratch_path(spark, "corpus-bare")
    d = table(spark, sf, "documents").select("doc_id", "text", "source").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    d.select("text", F.col("source").alias("url")).write.json(path)
    r = read_corpus(spark, path, "json")
    return r.select("doc_id", F.md5("text").alias("text_md5"))


def _stream(spark, sf):
    path = scratch_path(spark, "tokenstream")
    ch = packed_chunks(spark, sf)
    real = F.slice("ids", 1, F.col("n_tokens"))  # the stream holds real tokens only
    write_token_stream(ch.select("split", (F.col("chunk_id") * CHUNK).alias("start"), real.alias("ids")), path)
    return path


def q_s3_token_stream_sink(spark, sf):
    s = read_token_stream(spark, _stream(spark, sf), tokens_per_row=CHUNK)
    return s.groupBy("split").agg(F.sum(F.size("ids")).cast("bigint").alias("n_tokens"))


def q_s4_token_stream_source(spark, sf):
    s = read_token_stream(spark, _stream(spark, sf), tokens_per_row=CHUNK)
    fill = F.array_repeat(F.lit(SEP), F.lit(CHUNK) - F.size("ids"))
    return s.select("split", (F.col("start") / CHUNK).cast("bigint").alias("chunk_id"),
                    F.size("ids").cast("bigint").alias("n_tokens"), ids_md5(F.concat("ids", fill)).alias("ids_md5"))


def q_s4_token_range(spark, sf):
    """Twenty thousand tokens of the train split from position 30,000 on: only the parts that hold them are read."""
    rows = read_token_range(spark, _stream(spark, sf), "train", *RANGE, tokens_per_row=CHUNK)
    return rows.select((F.col("start") / CHUNK).cast("bigint").alias("chunk_id"), "start", F.size("ids").cast("bigint").alias("n_tokens"), ids_md5("ids").alias("ids_md5"))


def _packed(spark, sf):
    path = scratch_path(spark, "packed")
    ch = packed_chunks(spark, sf)
    write_packed(ch.select(F.col("split").alias("prefix"), "chunk_id", "ids"), path, CHUNK, "auto",
                 vocab_size=ByteTokenizer.vocab_size)
    return path


def q_s5_packed_sink(spark, sf):
    p = read_packed(spark, _packed(spark, sf))
    return p.select(F.col("prefix").alias("split"), "chunk_id", F.col("dtype_code").cast("bigint").alias("dtype_code"),
                    "chunk_size")


def q_s6_packed_source(spark, sf):
    p = read_packed(spark, _packed(spark, sf))
    return p.select(F.col("prefix").alias("split"), "chunk_id", ids_md5("ids").alias("ids_md5"))


QUERIES = {
    "s1_row_ids": q_s1_row_ids,
    "s2_corpus_jsonl_gz": q_s2_corpus_jsonl_gz,
    "s3_token_stream_sink": q_s3_token_stream_sink,
    "s4_token_stream_source": q_s4_token_stream_source,
    "s4_token_range": q_s4_token_range,
    "s5_packed_sink": q_s5_packed_sink,
    "s6_packed_source": q_s6_packed_source,
}

_K4 = CORPUS_ORACLE["k4_pack"]
_CH = _K4[:_K4.rindex("SELECT")]
ORACLE = {
    "s1_row_ids": "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS doc_id, md5(text) AS text_md5 FROM documents",
    "s2_corpus_jsonl_gz": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "s3_token_stream_sink": _CH + "SELECT split, CAST(sum(n) AS BIGINT) AS n_tokens FROM chunkf GROUP BY split",
    "s4_token_stream_source": _K4,
    "s4_token_range": f"""WITH {STREAM_CTE}, t AS (SELECT pos, id FROM tokens WHERE split = 'train' AND pos >= {RANGE[0]} AND pos < {RANGE[1]})
        SELECT CAST(pos // {CHUNK} AS BIGINT) AS chunk_id, CAST(min(pos) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n_tokens,
               md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)) AS ids_md5 FROM t GROUP BY pos // {CHUNK}""",
    "s5_packed_sink": _CH + f"SELECT split, chunk_id, CAST(8 AS BIGINT) AS dtype_code, CAST({CHUNK} AS BIGINT) AS chunk_size FROM chunkf",
    "s6_packed_source": _CH + "SELECT split, chunk_id, md5(a) AS ids_md5 FROM chunkf",
}
