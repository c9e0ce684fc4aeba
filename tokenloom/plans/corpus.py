"""Corpus preparation and token layout plans over ``documents``:
scan, split, sample, tokenise, offsets, shards, pack, blocks, groups,
windows, mixture and calibration blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.hashing import h48
from tokenloom.operators.metrics import observe_totals
from tokenloom.operators.offsets import bucket_plan, contiguous_shards, hash_bucket, input_bytes, running_offset
from tokenloom.operators.packing import assign_shards, blocks, calibration_blocks, chunk_groups, pack, token_totals
from tokenloom.operators.sampling import mix, sample_rows, sample_windows_by_offset, shuffle_blocks, split
from tokenloom.operators.bpe import BytePairTokenizer
from tokenloom.operators.tokenize import ByteTokenizer, drop_null_text, tokenize
from tokenloom.plans.common import (CHUNK, SEED, SEP, SPLIT_CTE, STREAM_CTE, VAL_SIZE, byte_ids_sql,
                                    documents, h_sql, ids_md5, list_md5_sql, table, u_sql)
from tokenloom.session import scratch_path
from tokenloom.sources.tables import read_corpus

TOK = ByteTokenizer()
BLOCK = 1000          # K5 block size: 4 blocks per 4096 chunk, 96 tokens dropped
WORKERS, PROCS = 3, 2  # K6
N_CHUNKS, EPOCHS = 4, 2  # K7
WINDOWS, WINDOW_BLOCK = 256, 2048  # R3
MIX_DRAWS = 3000  # R5
SAMPLE_ROWS = 150  # R2
CAL_DOCS, CAL_SAMPLES, CAL_BLOCK = 2000, 32, 2048  # K8
N_SHARDS = 16  # K3


def corpus_buckets(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Bucket bits and window partitions sized from the corpus files."""
    files = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return bucket_plan(input_bytes(files), min_partitions=int(spark.conf.get("spark.sql.shuffle.partitions")))


def split_docs(spark: SparkSession, sf_dir: str, seed: int = SEED, val_size: float = VAL_SIZE) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return split(docs, "doc_id", val_size, seed).withColumn("h", h48(seed, F.col("doc_id")))


def tokenized_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(split_docs(spark, sf_dir), TOK, keep=["split", "doc_id", "h"])


def packed_chunks(spark: SparkSession, sf_dir: str, chunk_size: int = CHUNK) -> DataFrame:
    s = drop_null_text(split_docs(spark, sf_dir)).withColumn("len", TOK.length(F.col("text")) + 1)
    ids = F.concat(TOK.encode(F.col("text")), F.array(F.lit(TOK.eos_id)))
    bits, parts = corpus_buckets(spark, sf_dir)
    return pack(s, chunk_size, SEP, order=["h", "doc_id"], bucket=hash_bucket(F.col("h"), bits), part="split",
                ids=ids, length="len", num_partitions=parts)


def pack_corpus(spark: SparkSession, sf_dir: str, chunk_size: int = CHUNK) -> DataFrame:
    """Flagship: documents -> seeded split -> byte tokens + eos -> ordered
    concat in shuffled order -> fixed-size chunks with separator fill."""
    chunks = packed_chunks(spark, sf_dir, chunk_size)
    return chunks.select("split", "chunk_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                         ids_md5("ids").alias("ids_md5"))


def q_s1_corpus_scan(spark, sf):
    d = read_corpus(spark, f"{sf}/documents.parquet", "parquet", "text", "doc_id")
    return d.select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n_chars"),
                    F.md5("text").alias("text_md5"))


def q_r1_split(spark, sf):
    return split_docs(spark, sf).select("doc_id", "split")


def q_r2_sample_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    s = sample_rows(d, "doc_id", SAMPLE_ROWS, SEED)
    # rank inside the k sampled rows (k is the feature's bound)
    return s.withColumn("rank", (F.row_number().over(Window.orderBy(h48(SEED, F.col("doc_id")), "doc_id")) - 1)
                        .cast("bigint"))


def q_t5_tokenize(spark, sf):
    t = tokenized_splits(spark, sf)
    return t.select("doc_id", F.col("len").cast("bigint").alias("len"), ids_md5("ids").alias("ids_md5"))


def q_p1_drop_columns(spark, sf):
    t = tokenize(documents(spark, sf), TOK, keep=["doc_id", "text", "lang"])
    return t.select("doc_id", "lang", F.col("len").cast("bigint").alias("len"))


def q_t1_encode(spark, sf):
    d = documents(spark, sf)
    ids = TOK.encode(F.col("text"), bos=True, eos=True)
    return d.select("doc_id", F.size(ids).cast("bigint").alias("len"), ids_md5(ids).alias("ids_md5"))


def bpe_file() -> str:
    """The public byte-level BPE file that the registered query encodes with (never copied, any path Spark reads will do)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def q_t1_encode_bpe(spark, sf):
    tok = BytePairTokenizer(spark, bpe_file(), eos_token="<|endoftext|>")
    ids = documents(spark, sf).select("doc_id", tok.encode(F.col("text"), eos=True).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("len"), ids_md5("ids").alias("ids_md5"))


def q_f3_observe(spark, sf):
    """Tokenise and write the corpus once; the numbers of rows, dropped rows and tokens are observed on the way."""
    read, made = Observation("read"), Observation("made")
    d = drop_null_text(documents(spark, sf).select("doc_id", "text"), metric=read)
    observe_totals(tokenize(d, TOK), made).write.parquet(scratch_path(spark, "observed"))
    row = {**read.get, **{f"out_{k}": v for k, v in made.get.items()}}
    return spark.createDataFrame([(row["rows"], row["dropped"], row["out_rows"], row["out_tokens"], row["out_longest"])],
                                 "rows_read bigint, dropped bigint, rows bigint, tokens bigint, longest bigint")


def q_t2_decode(spark, sf):
    d = documents(spark, sf)
    dec = TOK.decode(TOK.encode(F.col("text"), bos=True, eos=True))
    return d.select("doc_id", F.md5(dec).alias("text_md5"), (dec == F.col("text")).alias("roundtrip"))


def q_k1_token_totals(spark, sf):
    # token counts without materialising ids (exact for the byte tokenizer)
    s = split_docs(spark, sf).select("split", (TOK.length(F.col("text")) + 1).alias("len"))
    return token_totals(s, "split", "len")


def q_k2_running_offset(spark, sf):
    t = split_docs(spark, sf).select("split", "doc_id", "h", (TOK.length(F.col("text")) + 1).alias("len"))
    bits, parts = corpus_buckets(spark, sf)
    o = running_offset(t, ["h", "doc_id"], hash_bucket(F.col("h"), bits), "len", "split", out="start",
                       num_partitions=parts)
    return o.select("split", "doc_id", "start", F.col("len").cast("bigint").alias("len"))


def q_k3_contiguous_shards(spark, sf):
    s = split_docs(spark, sf).select("split", "doc_id", "h")
    bits, _ = corpus_buckets(spark, sf)
    return contiguous_shards(s, ["h", "doc_id"], hash_bucket(F.col("h"), bits), N_SHARDS, "split") \
        .select("split", "doc_id", "shard")


def q_k5_blocks(spark, sf):
    b = blocks(packed_chunks(spark, sf), BLOCK, CHUNK, keys=["split", "chunk_id"])
    return b.select("split", "chunk_id", "block_id", ids_md5("ids").alias("ids_md5"))


def _train_files(spark, sf):
    return packed_chunks(spark, sf).filter(F.col("split") == "train")


def _train_file_ids(spark, sf):
    """The chunk ids of the train split from its token total alone: nothing is packed."""
    t = split_docs(spark, sf).filter(F.col("split") == "train")
    n = t.agg(F.ceil(F.sum(TOK.length(F.col("text")) + 1) / CHUNK).alias("n"))
    return n.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("chunk_id"))


def q_k6_assign_shards(spark, sf):
    f = _train_file_ids(spark, sf)
    return assign_shards(f, "chunk_id", WORKERS, PROCS).select("chunk_id", "shard", "worker", "rank")


def q_k7_chunk_groups(spark, sf):
    f = _train_file_ids(spark, sf)
    return chunk_groups(f, "chunk_id", N_CHUNKS, EPOCHS, wrap=True).select("chunk_id", "group_id", "epoch")


def q_r6_shuffle_blocks(spark, sf):
    g = chunk_groups(_train_file_ids(spark, sf), "chunk_id", N_CHUNKS, EPOCHS, wrap=True)
    g = _train_files(spark, sf).drop("split").join(g, "chunk_id")
    b = blocks(g, BLOCK, CHUNK, keys=["epoch", "group_id", "chunk_id"])
    s = shuffle_blocks(b, ["epoch", "group_id"], ["chunk_id", "block_id"], SEED)
    return s.select("epoch", "group_id", "chunk_id", "block_id", "pos", ids_md5("ids").alias("ids_md5"))


def train_offsets(spark, sf):
    """(doc_id, start, len) of the train split's byte tokens in shuffled order, written once: no text, no ids."""
    t = drop_null_text(split_docs(spark, sf).filter(F.col("split") == "train")).select("doc_id", "h", (TOK.length(F.col("text")) + 1).cast("bigint").alias("len"))
    bits, parts = corpus_buckets(spark, sf)
    path = scratch_path(spark, "train-offsets")
    running_offset(t, ["h", "doc_id"], hash_bucket(F.col("h"), bits), "len", out="start", num_partitions=parts).select("doc_id", "start", "len").write.parquet(path)
    return spark.read.parquet(path)


def q_r3_sample_windows(spark, sf):
    def tokens(keys):
        return tokenize(documents(spark, sf).select("doc_id", "text").join(keys, "doc_id"), TOK, keep=["doc_id"])

    w = sample_windows_by_offset(train_offsets(spark, sf), "doc_id", tokens, WINDOWS, WINDOW_BLOCK - 1, SEED)
    return w.select("draw", "i", ids_md5("x").alias("x_md5"), ids_md5("y").alias("y_md5"))


def _mix_weights():
    return {f"src{k}": float(k + 1) for k in range(20)}


def q_r5_mix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    m = mix(d, "source", "doc_id", _mix_weights(), MIX_DRAWS, SEED)
    return m.select("draw", "source", F.col("rank").cast("bigint").alias("rank"), "doc_id")


def q_k8_calibration_blocks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    s = sample_rows(d, "doc_id", CAL_DOCS, SEED)
    ch = calibration_blocks(s.withColumn("h", h48(SEED, F.col("doc_id"))), TOK, CAL_SAMPLES, CAL_BLOCK,
                            order=["h", "doc_id"], bucket=hash_bucket(F.col("h"), 6))
    return ch.select("sample", ids_md5("ids").alias("ids_md5"))


QUERIES = {
    "s1_corpus_scan": q_s1_corpus_scan,
    "r1_split": q_r1_split,
    "r2_sample_rows": q_r2_sample_rows,
    "t5_tokenize": q_t5_tokenize,
    "p1_drop_columns": q_p1_drop_columns,
    "t1_encode": q_t1_encode,
    "t1_encode_bpe": q_t1_encode_bpe,
    "f3_observe": q_f3_observe,
    "t2_decode": q_t2_decode,
    "k1_token_totals": q_k1_token_totals,
    "k2_running_offset": q_k2_running_offset,
    "k3_contiguous_shards": q_k3_contiguous_shards,
    "k4_pack": pack_corpus,
    "k5_blocks": q_k5_blocks,
    "k6_assign_shards": q_k6_assign_shards,
    "k7_chunk_groups": q_k7_chunk_groups,
    "r6_shuffle_blocks": q_r6_shuffle_blocks,
    "r3_sample_windows": q_r3_sample_windows,
    "r5_mix": q_r5_mix,
    "k8_calibration_blocks": q_k8_calibration_blocks,
}

_DOC_BYTES = "(SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS l FROM documents)"
_CHUNKS = STREAM_CTE + f""",
chunks AS (SELECT split, pos // {CHUNK} AS chunk_id, count(*) AS n,
                  string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS a
           FROM tokens GROUP BY split, pos // {CHUNK}),
chunkf AS (SELECT split, CAST(chunk_id AS BIGINT) AS chunk_id, n,
                  a || repeat(',0', CAST({CHUNK} - n AS INTEGER)) AS a FROM chunks)"""
_TRAIN_FILES = _CHUNKS + """,
files AS (SELECT chunk_id, count(*) OVER () AS nf FROM chunkf WHERE split = 'train')"""
_GROUPS = _TRAIN_FILES + f""",
groups AS (SELECT chunk_id, CAST(chunk_id // {N_CHUNKS} AS BIGINT) AS group_id, CAST(e AS BIGINT) AS epoch
           FROM files, range(0, {EPOCHS}) t(e) WHERE chunk_id // {N_CHUNKS} < nf // {N_CHUNKS})"""


def _mix_case() -> str:
    w = _mix_weights()
    names = sorted(w)
    tot = float(sum(w.values()))
    cum, parts = 0.0, []
    for nm in names:
        cum += w[nm] / tot
        parts.append(f"WHEN u < {cum!r} THEN '{nm}'")
    return "CASE " + " ".join(parts) + f" ELSE '{names[-1]}' END"


ORACLE = {
    "s1_corpus_scan": """SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5
                         FROM documents""",
    "r1_split": f"WITH {SPLIT_CTE} SELECT doc_id, split FROM ds",
    "r2_sample_rows": f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY {h_sql('doc_id')}, doc_id) - 1 AS BIGINT) AS rank
                          FROM documents ORDER BY {h_sql('doc_id')}, doc_id LIMIT {SAMPLE_ROWS}""",
    "t5_tokenize": f"""SELECT doc_id, CAST(l + 1 AS BIGINT) AS len, {list_md5_sql(byte_ids_sql('text'))} AS ids_md5
                       FROM {_DOC_BYTES}""",
    "p1_drop_columns": "SELECT doc_id, lang, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS len FROM documents",
    "t1_encode": f"""SELECT doc_id, CAST(l + 2 AS BIGINT) AS len,
                            {list_md5_sql(byte_ids_sql('text', eos=True, bos=True))} AS ids_md5 FROM {_DOC_BYTES}""",
    "f3_observe": """SELECT CAST(count(*) AS BIGINT) AS rows_read, CAST(count(*) - count(text) AS BIGINT) AS dropped, CAST(count(text) AS BIGINT) AS rows,
        CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS tokens, CAST(max(octet_length(encode(text)) + 1) AS BIGINT) AS longest FROM documents""",
    "t2_decode": "SELECT doc_id, md5(text) AS text_md5, true AS roundtrip FROM documents",
    "k1_token_totals": f"""WITH {SPLIT_CTE} SELECT split, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_tokens
                           FROM ds GROUP BY split""",
    "k2_running_offset": f"""WITH {SPLIT_CTE} SELECT split, doc_id,
           CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY split ORDER BY h, doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
           CAST(octet_length(encode(text)) + 1 AS BIGINT) AS len FROM ds""",
    "k3_contiguous_shards": f"""WITH {SPLIT_CTE} SELECT split, doc_id,
           CAST(ntile({N_SHARDS}) OVER (PARTITION BY split ORDER BY h, doc_id) - 1 AS BIGINT) AS shard FROM ds""",
    "k5_blocks": f"""WITH {_CHUNKS}
        SELECT split, chunk_id, CAST(b AS BIGINT) AS block_id,
               md5(array_to_string(list_slice(string_split(a, ','), b * {BLOCK} + 1, (b + 1) * {BLOCK}), ',')) AS ids_md5
        FROM chunkf, range(0, {CHUNK // BLOCK}) t(b)""",
    "k6_assign_shards": f"""WITH {_TRAIN_FILES}
        SELECT chunk_id, CAST(chunk_id % {WORKERS * PROCS} AS BIGINT) AS shard,
               CAST((chunk_id % {WORKERS * PROCS}) % {WORKERS} AS BIGINT) AS worker,
               CAST((chunk_id % {WORKERS * PROCS}) // {WORKERS} AS BIGINT) AS rank
        FROM files WHERE chunk_id < nf // {WORKERS * PROCS} * {WORKERS * PROCS}""",
    "k7_chunk_groups": f"WITH {_GROUPS} SELECT chunk_id, group_id, epoch FROM groups",
    "r6_shuffle_blocks": f"""WITH {_GROUPS},
        bl AS (SELECT g.epoch, g.group_id, g.chunk_id, CAST(b AS BIGINT) AS block_id,
                 md5(array_to_string(list_slice(string_split(c.a, ','), b * {BLOCK} + 1, (b + 1) * {BLOCK}), ',')) AS ids_md5
               FROM groups g JOIN chunkf c ON c.split = 'train' AND c.chunk_id = g.chunk_id, range(0, {CHUNK // BLOCK}) t(b))
        SELECT epoch, group_id, chunk_id, block_id,
               CAST(row_number() OVER (PARTITION BY epoch, group_id
                    ORDER BY {h_sql('epoch', 'group_id', 'chunk_id', 'block_id')}, chunk_id, block_id) - 1 AS BIGINT) AS pos,
               ids_md5 FROM bl""",
    "r3_sample_windows": f"""WITH {STREAM_CTE},
        tr AS (SELECT pos, id FROM tokens WHERE split = 'train'),
        n AS (SELECT count(*) AS n FROM tr),
        dr AS (SELECT d AS draw, CAST(({h_sql('d')}) % (n - {WINDOW_BLOCK - 1}) AS BIGINT) AS i
               FROM range(0, {WINDOWS}) t(d), n)
        SELECT draw, i,
               md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos < i + {WINDOW_BLOCK - 1})) AS x_md5,
               md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos > i)) AS y_md5
        FROM dr JOIN tr ON tr.pos BETWEEN dr.i AND dr.i + {WINDOW_BLOCK - 1}
        GROUP BY draw, i""",
    "r5_mix": f"""WITH dr AS (SELECT d AS draw, {u_sql('d')} AS u FROM range(0, {MIX_DRAWS}) t(d)),
        ds AS (SELECT draw, {_mix_case()} AS source FROM dr),
        dk AS (SELECT draw, source, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS rank FROM ds),
        cnt AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
        dc AS (SELECT dk.*, coalesce(cnt.c, 0) AS c FROM dk LEFT JOIN cnt USING (source)),
        stop AS (SELECT min(draw) AS s FROM dc WHERE rank >= c),
        rows AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM documents)
        SELECT dc.draw, dc.source, CAST(dc.rank AS BIGINT) AS rank, rows.doc_id
        FROM dc, stop, rows WHERE (stop.s IS NULL OR dc.draw < stop.s) AND rows.source = dc.source AND rows.rank = dc.rank""",
    "k8_calibration_blocks": f"""WITH s AS (
          SELECT doc_id, text, row_number() OVER (ORDER BY {h_sql('doc_id')}, doc_id) - 1 AS rank
          FROM documents ORDER BY {h_sql('doc_id')}, doc_id LIMIT {CAL_DOCS}),
        sx AS (SELECT rank, hex(encode(text)) AS hx, octet_length(encode(text)) AS l, max(rank) OVER () AS last FROM s),
        so AS (SELECT *, coalesce(sum(l + 1) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM sx),
        t1 AS (SELECT st, l, hx, rank, last, unnest(range(1, l + 2)) AS i FROM so),
        tk AS (SELECT st + i - 1 AS pos, CASE WHEN i = l + 1 THEN (CASE WHEN rank < last THEN 13 ELSE 2 END)
                 ELSE CAST(('0x' || substr(hx, 2 * i - 1, 2)) AS INTEGER) + 3 END AS id FROM t1)
        SELECT CAST(pos // {CAL_BLOCK} AS BIGINT) AS sample, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)) AS ids_md5
        FROM tk WHERE pos < {CAL_SAMPLES * CAL_BLOCK} GROUP BY pos // {CAL_BLOCK}""",
}
ORACLE["k4_pack"] = f"""WITH {_CHUNKS}
SELECT split, chunk_id, CAST(n AS BIGINT) AS n_tokens, md5(a) AS ids_md5 FROM chunkf"""
