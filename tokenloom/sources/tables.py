"""Corpus, samples, metric logs, eval results and vocabulary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


def first_line(spark: SparkSession, path: str) -> str:
    """The first line with any text of a text source ('' if there is none): the scan stops there."""
    row = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return row[0]["value"] if row else ""


def number_rows(scan: DataFrame, out: str, probe: str) -> DataFrame:
    """Dense row numbers from 0 in the order of (file, position in it), whatever the splits of the scan.

    Rows of one split (file, first byte) are consecutive in a task, so a row's number is its split's
    first number plus its distance from the split's first row.  A narrow pass over ``probe`` counts the rows
    of each split; splits are added up per file and files in their order (no more rows than the file
    listing that the scan plan holds).  The texts are not shuffled.  ``scan`` must be a file scan.
    """
    at = F.monotonically_increasing_id()
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), at.alias("_at")]
    # the column is read, so that lines without it are counted as the scan itself counts them
    splits = scan.select(*where, F.col(probe).isNull().alias("_null")).groupBy("_file", "_block").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count("_null"))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    before = lambda c, order, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("_file", before("_rows", "_file").alias("_base"))
    starts = splits.withColumn("_in", before("_n", "_block", "_file")).join(files, "_file").select("_file", "_block", (F.col("_base") + F.col("_in") - F.col("_first")).alias("_shift"))
    rows = scan.select(*scan.columns, *where)
    return rows.join(starts, ["_file", "_block"]).select(*scan.columns, (F.col("_shift") + F.col("_at")).alias(out))


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text",
                id_col: str | None = "doc_id", min_partitions: int | None = None, schema: str | None = None) -> DataFrame:
    """Read a text corpus.  parquet/json/text; JSON lines are read with a
    schema (id and text unless given), never by a pass that infers one: the first line says whether
    they carry the id.  ``.json.gz`` shards are not splittable, so they are repartitioned after the
    scan when asked.  Rows without an id column are numbered from 0 by file and position, so that
    equal rows have different ids and any partitioning gives the same ones."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        if schema is None:
            carried = id_col and spark.range(1).select(F.array_contains(F.json_object_keys(F.lit(first_line(spark, path))), id_col)).first()[0]
            schema = f"{id_col} bigint, {text_col} string" if carried else f"{text_col} string"
        df = spark.read.schema(schema).json(path)
    elif fmt == "text":
        df = spark.read.text(path).withColumnRenamed("value", text_col)
    else:
        raise ValueError(f"unknown corpus format {fmt}")
    if id_col and id_col not in df.columns:
        df = number_rows(df, id_col, text_col)
    if min_partitions:
        df = df.repartition(min_partitions)
    return df.withColumnRenamed(text_col, "text") if text_col != "text" else df


def write_corpus_jsonl_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


SAMPLE_SCHEMA = "sample_id bigint, input_ids array<int>, labels array<int>"


def write_samples(df: DataFrame, path: str) -> None:
    """S7 sink: instruction samples as parquet (two aligned int arrays)."""
    df.select("sample_id", "input_ids", "labels").write.mode("overwrite").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Load instruction samples ``(sample_id, input_ids, labels)``."""
    return spark.read.schema(SAMPLE_SCHEMA).parquet(path)


METRIC_SCHEMA = "run bigint, step bigint, ts timestamp, metric string, value double"


def write_metrics(df: DataFrame, path: str) -> None:
    """S8 sink: append per-step metric rows as CSV with a header."""
    df.select("run", "step", "ts", "metric", "value").write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """S8 source: the metric CSV log with its fixed schema."""
    return spark.read.schema(METRIC_SCHEMA).option("header", True).csv(path)


def write_eval(df: DataFrame, path: str | None, config: dict) -> DataFrame:
    """One JSON document ``{"results": {task: {...}}, "config": {...}}`` (a
    roll-up has one row per task); without a path the JSON row is returned for printing."""
    values = F.struct(*[c for c in df.columns if c != "task"])
    results = df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("task"), values)))).alias("results"))
    fields = F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())])
    doc = results.select(F.to_json(F.struct("results", fields.alias("config"))).alias("json"))
    if path:
        doc.write.mode("overwrite").text(path)
    return doc


VOCAB_SCHEMA = "model struct<vocab: map<string, int>>, added_tokens array<struct<id: int, content: string>>"


def read_small(spark: SparkSession, path: str) -> bytes | None:
    """One small configuration file, or folder of one part, by any path Spark reads; None if absent."""
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(
            ~F.element_at(F.split("path", "/"), -1).rlike("^[._]")).orderBy("path").select("content").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return b"".join(bytes(r.content) for r in rows) if rows else None


def write_vocab(vocab: DataFrame, checkpoint_dir: str) -> None:
    """A vocabulary table as ``tokenizer.json`` (one JSON document, as the format wants)."""
    pieces = vocab.agg(
        F.map_from_entries(F.collect_list(F.when(~F.col("is_special"), F.struct("token", "id")))).alias("vocab"),
        F.array_sort(F.collect_list(F.when(F.col("is_special"), F.struct("id", F.col("token").alias("content"))))).alias("added_tokens"))
    doc = pieces.select(F.to_json(F.struct(F.struct("vocab").alias("model"), "added_tokens")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(f"{checkpoint_dir.rstrip('/')}/tokenizer.json")


def read_vocab(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """``(token, id, is_special)`` from the tokenizer files of a
    checkpoint folder.  ``tokenizer.json`` pieces come from ``model.vocab``
    (a map) and ``added_tokens`` (special).  ``tokenizer.model`` (sentencepiece)
    wins when present.  Tokenizer files are small configuration files."""
    d = checkpoint_dir.rstrip("/")
    model = read_small(spark, f"{d}/tokenizer.model")
    if model is not None:
        import sentencepiece as spm
        sp = spm.SentencePieceProcessor(model_proto=model)
        specials = {sp.bos_id(), sp.eos_id(), sp.pad_id(), sp.unk_id()}
        rows = [(sp.id_to_piece(i), i, i in specials) for i in range(sp.vocab_size())]
        return spark.createDataFrame(rows, "token string, id int, is_special boolean")
    raw = spark.read.schema(VOCAB_SCHEMA).option("multiLine", True).json(f"{d}/tokenizer.json")
    vocab = raw.select(F.explode("model.vocab").alias("token", "id")).withColumn("is_special", F.lit(False))
    added = raw.select(F.explode("added_tokens").alias("t")).select(
        F.col("t.content").alias("token"), F.col("t.id").alias("id"), F.lit(True).alias("is_special"))
    return vocab.join(added.select("token"), "token", "left_anti").unionByName(added)


BPE_SCHEMA = ("model struct<type: string, dropout: double, unk_token: string, continuing_subword_prefix: string, end_of_word_suffix: string, byte_fallback: boolean, "
              "ignore_merges: boolean, vocab: map<string, int>, merges: array<string>>, normalizer string, pre_tokenizer string, "
              "added_tokens array<struct<id: int, content: string, single_word: boolean, lstrip: boolean, rstrip: boolean, normalized: boolean>>")


def read_bpe(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """S11 of a byte-pair model: (settings, (token, id, is_special), (rank, left, right)) of a ``tokenizer.json``.
    Merges are pairs, or in older files two tokens with a space between."""
    raw = spark.read.schema(BPE_SCHEMA).option("multiLine", True).json(path)
    parts = [f for f in raw.schema["model"].dataType.fieldNames() if f not in ("vocab", "merges")]
    row = raw.select(*[F.col(f"model.{f}").alias(f) for f in parts], "normalizer", "pre_tokenizer", "added_tokens").first()
    spec = {"model": {f: row[f] for f in parts}, "added_tokens": [t.asDict() for t in row["added_tokens"] or []],
            **{k: json.loads(row[k]) if row[k] else None for k in ("normalizer", "pre_tokenizer")}}
    added = raw.select(F.explode("added_tokens").alias("t")).select(F.col("t.content").alias("token"), F.col("t.id").alias("id"), F.lit(True).alias("is_special"))
    vocab = raw.select(F.explode("model.vocab").alias("token", "id")).withColumn("is_special", F.lit(False))
    vocab = vocab.join(added.select("token"), "token", "left_anti").unionByName(added)
    merge = raw.select(F.posexplode("model.merges").alias("rank", "m"))
    pair = F.when(F.instr("m", " ") > 0, F.split("m", " ")).otherwise(F.from_json("m", "array<string>"))
    return spec, vocab, merge.select("rank", pair.alias("p")).select("rank", F.col("p")[0].alias("left"), F.col("p")[1].alias("right"))


def special_ids(spark: SparkSession, checkpoint_dir: str, vocab: dict[str, int]) -> dict[str, int | bool | None]:
    """bos/eos ids (tokenizer_config tokens first, generation_config as fallback) and the BOS policy."""
    from tokenloom.operators.tokenize import use_bos_policy
    d = checkpoint_dir.rstrip("/")
    cfg, gen = (json.loads(raw) if (raw := read_small(spark, f"{d}/{name}.json")) else {} for name in ("tokenizer_config", "generation_config"))
    out: dict[str, int | bool | None] = {"bos_id": None, "eos_id": None, "use_bos": use_bos_policy(cfg)}
    for k in ("bos", "eos"):
        tok = cfg.get(f"{k}_token")
        tok = tok.get("content") if isinstance(tok, dict) else tok
        if tok is not None:
            out[f"{k}_id"] = vocab.get(tok)
        if out[f"{k}_id"] is None and gen.get(f"{k}_token_id") is not None:
            out[f"{k}_id"] = int(gen[f"{k}_token_id"])
    return out
