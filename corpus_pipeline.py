"""Training-data pipeline: five stages over ``documents``, each written as Parquet and reread.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
the documents that go on (same columns), the last one the packed pieces.  Null texts
count as empty, an empty table passes through every stage, and further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import best_fit_packing, decontamination, ngram_jaccard, substring_dedup, toxicity
from tokenloom.llm.common import MADE, bounded_batches, clear, documents, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents predicted toxic go (null ids are scored like others)."""
    scored = toxicity.score(docs.withColumnsRenamed(_aside(docs)), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").drop("held_out", "score", "predicted").withColumnsRenamed({v: k for k, v in _aside(docs).items()}).select(*docs.columns)


def _aside(docs: DataFrame) -> dict[str, str]:
    """Names for further columns that clash with those of the scores."""
    return {c: f"__kept_{c}" for c in docs.columns if c in ("held_out", "score", "predicted")}


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (5-word shingles, similarity 0.8): of each group of linked documents the one with the smallest id stays.

    A row is decided by its own text, not by its id: rows that share an id, or have none,
    stay or go one by one.  Rows that repeat the id and the text of the one that stays become
    one row; documents without an id stay unless they link with one that has an id.
    """
    bounded_batches(spark)
    keyed = docs.withColumn("__tl_text", F.xxhash64("text"))
    classes = ngram_jaccard.classes_of(keyed, n=5, num=80, den=100, carry="__tl_text").where("doc_id = component_id OR component_id IS NULL")
    classes = classes.select(F.col("doc_id").alias("__tl_id"), F.col("__tl_text").alias("__tl_key")).distinct()
    kept = keyed.join(classes, keyed["doc_id"].eqNullSafe(classes["__tl_id"]) & (keyed["__tl_text"] == classes["__tl_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__tl_text"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated 13-word passages are cut from the later documents' texts."""
    bounded_batches(spark)
    cut = substring_dedup.cut_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that overlap an item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all documents with their sequences."""
    bounded_batches(spark)
    return best_fit_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: Language models, tokenizers and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table.  Once a stage is written, its working tables and the table it read are removed."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        first = len(MADE)
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        clear(spark, before + MADE[first:-1])
        before = MADE[-1:]
    return docs
