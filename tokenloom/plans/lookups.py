"""Name globbing, per-group limits, vocabulary lookups, request cache,
keyed overlay, evaluation roll-up, bootstrap error and eval JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.hashing import h48
from tokenloom.operators.joins import lookup_tokens, overlay, with_cache
from tokenloom.operators.metrics import POISSON1, bootstrap_se, eval_rollup, score_examples
from tokenloom.operators.text import glob_filter, glob_to_regex, glob_union, limit_per_group
from tokenloom.operators.offsets import running_offset
from tokenloom.operators.tokenize import encode_words, token_to_id, vocab_size
from tokenloom.plans.common import SEED, h_sql, r, table
from tokenloom.session import scratch_path
from tokenloom.sources.cache import AnswerCache
from tokenloom.sources.tables import read_vocab, write_eval, write_vocab

GLOBS = ["*ring", "red *", "s?all*", "[bg]lue*", "[!a-m]*widget"]
PER_GROUP = 5
BOOT_ITERS = 100000  # what is run is what the roll-up records; the reference's default
TASK_CONFIG = {"num_fewshot": 0, "bootstrap_iters": BOOT_ITERS}


def word_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """(token, id, is_special): the distinct words of part names ranked
    alphabetically after three special pieces."""
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    # rank by token in two levels: the bucket is the token's first three bytes
    lead = F.conv(F.substring(F.rpad(F.hex("token"), 6, "0"), 1, 6), 16, 10).cast("bigint")
    ranked = running_offset(words, "token", lead, None, out="_r").select(
        "token", (F.col("_r") + 3).cast("int").alias("id"), F.lit(False).alias("is_special"))
    specials = spark.createDataFrame([("<pad>", 0, True), ("<s>", 1, True), ("</s>", 2, True)],
                                     "token string, id int, is_special boolean")
    return specials.unionByName(ranked)


def q_p2_glob_filter(spark, sf):
    return glob_filter(table(spark, sf, "part"), "p_name", GLOBS)


def q_u1_glob_union(spark, sf):
    return glob_union(table(spark, sf, "part"), "p_name", GLOBS)


def q_p3_limit_per_group(spark, sf):
    lb = table(spark, sf, "labels")
    return limit_per_group(lb, ["quality", "toxic"], ["doc_id"], PER_GROUP).select("quality", "toxic", "doc_id")


def q_t3_token_to_id(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "token"))
    t = token_to_id(p, "token", word_vocab(spark, sf))
    return t.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "token", F.col("id").cast("bigint").alias("id"))


def q_t1_encode_vocab(spark, sf):
    """T1 over a vocabulary table: part name + type encoded with the
    vocabulary of part-name words; type words are unknown -> the id after the last."""
    v = word_vocab(spark, sf)
    unk = v.agg((F.max("id") + 1).cast("int")).scalar()
    e = encode_words(table(spark, sf, "part"), "p_partkey", F.concat_ws(" ", "p_name", "p_type"), v, unk, bos_id=1, eos_id=2)
    return e.select("p_partkey", F.size("ids").cast("bigint").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def q_j1_vocab_lookup(spark, sf):
    v = word_vocab(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("token"))
    j = lookup_tokens(d, v, "token")
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_words"),
                                   F.count("id").cast("bigint").alias("n_known"))


def q_t4_vocab_size(spark, sf):
    v = word_vocab(spark, sf)
    return vocab_size(v, False).select(F.col("vocab_size").alias("n_pieces"),
                                       vocab_size(v, True).scalar().alias("n_with_special"))


def q_s11_read_vocab(spark, sf):
    """Write the derived vocabulary as tokenizer files, read them back."""
    d = scratch_path(spark, "vocab")
    write_vocab(word_vocab(spark, sf), d)
    return read_vocab(spark, d).select("token", F.col("id").cast("bigint").alias("id"), "is_special")


def q_j5_with_cache(spark, sf):
    b = table(spark, sf, "benchmark")
    cache = b.filter(F.pmod(h48(SEED, F.col("item_id")), F.lit(2)) == 0).select(
        "item_id", F.octet_length("text").cast("bigint").alias("score"))
    out = with_cache(b.select("item_id", "text"), cache, "item_id",
                     lambda m: m.withColumn("score", F.length("text").cast("bigint")))
    return out.select("item_id", "score", "from_cache")


def q_j5_persistent_cache(spark, sf):
    """Two runs over the benchmark's items with one stored cache: the first asks for half of them, the
    second for all; then the cache is compacted and a third run must find everything there."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    cache = AnswerCache(spark, scratch_path(spark, "answers"), "item_id", "score bigint")
    score = lambda m: m.select("item_id", F.length("text").cast("bigint").alias("score"))
    cache.lookup(b.where(F.pmod(h48(SEED, F.col("item_id")), F.lit(2)) == 0), score)
    second = cache.lookup(b, score).select(F.lit(2).cast("bigint").alias("run"), "item_id", "score", "from_cache")
    cache.compact()
    third = cache.lookup(b, score).select(F.lit(3).cast("bigint").alias("run"), "item_id", "score", "from_cache")
    return second.unionByName(third)


def q_j6_overlay(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    patch = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return overlay(base, patch, "key", "value")


def task_scores(spark, sf):
    lb = table(spark, sf, "labels")
    return lb.select("doc_id", F.explode(F.array(
        F.struct(F.lit("quality").alias("task"), F.col("quality").cast("double").alias("score")),
        F.struct(F.lit("toxic").alias("task"), F.col("toxic").cast("double").alias("score")))).alias("s")) \
        .select("doc_id", "s.task", "s.score")


def q_a18_eval_rollup(spark, sf):
    e = eval_rollup(task_scores(spark, sf), "task", "score", TASK_CONFIG)
    return e.select("task", r("acc").alias("acc"), "n", F.col("num_fewshot").cast("bigint").alias("num_fewshot"),
                    F.col("bootstrap_iters").cast("bigint").alias("bootstrap_iters"))


def q_a19_bootstrap_se(spark, sf):
    b = bootstrap_se(task_scores(spark, sf), "task", "score", BOOT_ITERS, SEED, key="doc_id")
    return b.select("task", r("stderr", 9).alias("stderr"), "iters")


def q_s10_eval_json(spark, sf):
    path = scratch_path(spark, "eval")
    e = eval_rollup(task_scores(spark, sf), "task", "score", {})
    write_eval(e, path, TASK_CONFIG)
    back = spark.read.schema("results map<string, struct<acc: double, n: bigint>>, config map<string, bigint>").json(path)
    return (back.select(F.explode("results").alias("task", "v"), "config")
            .select("task", r("v.acc").alias("acc"), F.col("v.n").alias("n"), F.col("config")["num_fewshot"].alias("num_fewshot"),
                    F.col("config")["bootstrap_iters"].alias("bootstrap_iters")))


def word_count_scorer(texts):
    """A stand-in model for the plug-in: 1.0 when the item has >= 10 words."""
    return texts.fillna("").map(lambda t: 1.0 if len(t.split(" ")) >= 10 else 0.0)


def q_f4_score_plugin(spark, sf):
    b = table(spark, sf, "benchmark")
    s = score_examples(b, word_count_scorer, "item_id", "text", task="benchmark")
    e = eval_rollup(s, "task", "score", TASK_CONFIG)
    return e.select("task", r("acc").alias("acc"), "n")


QUERIES = {
    "t1_encode_vocab": q_t1_encode_vocab,
    "f4_score_plugin": q_f4_score_plugin,
    "p2_glob_filter": q_p2_glob_filter,
    "u1_glob_union": q_u1_glob_union,
    "p3_limit_per_group": q_p3_limit_per_group,
    "t3_token_to_id": q_t3_token_to_id,
    "j1_vocab_lookup": q_j1_vocab_lookup,
    "t4_vocab_size": q_t4_vocab_size,
    "s11_read_vocab": q_s11_read_vocab,
    "j5_with_cache": q_j5_with_cache,
    "j5_persistent_cache": q_j5_persistent_cache,
    "j6_overlay": q_j6_overlay,
    "a18_eval_rollup": q_a18_eval_rollup,
    "a19_bootstrap_se": q_a19_bootstrap_se,
    "s10_eval_json": q_s10_eval_json,
}

_GLOB_SQL = " OR ".join(f"regexp_matches(p_name, '{glob_to_regex(g)}')" for g in GLOBS)
_VOCAB = """wv AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 2 AS INTEGER) AS id, false AS is_special FROM wv
          UNION ALL SELECT * FROM (VALUES ('<pad>', 0, true), ('<s>', 1, true), ('</s>', 2, true)) v(token, id, is_special))"""
_SCORES = """ts AS (SELECT doc_id, 'quality' AS task, CAST(quality AS DOUBLE) AS score FROM labels
       UNION ALL SELECT doc_id, 'toxic' AS task, CAST(toxic AS DOUBLE) AS score FROM labels)"""


def _poisson_sql(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {p!r} THEN {k}" for k, p in enumerate(POISSON1)) + f" ELSE {len(POISSON1)} END"


def _counter_sql(i: str) -> str:
    """The multiple of a counter that is added to a key, modulo 2**64."""
    return f"CAST((CAST({i} + 1 AS UHUGEINT) * {0x9E3779B97F4A7C15}) % 18446744073709551616 AS UBIGINT)"


def _uniform_sql() -> str:
    """The counter-based uniform of the bootstrap from ``ex`` (key k, counter's multiple g): sums and products modulo
    2**64 by halves of 32 bits."""
    low = lambda x: f"({x} & 4294967295::UBIGINT)"
    join = lambda hi, lo: f"(({low(hi)} << 32) | {low(lo)})"

    def mul(n: int, c: int, new: str) -> str:
        """Stage ``n``: z times ``c``, with z = xor(z, z >> ``new``) before."""
        h, l = f"{c >> 32}::UBIGINT", f"{c & 0xFFFFFFFF}::UBIGINT"
        return f"""x{n} AS (SELECT * REPLACE (xor(z, z >> {new}) AS z) FROM z{n - 1}),
        p{n} AS (SELECT *, {low('z')} * {l} AS lo, {low(f"(z >> 32) * {l}")} + {low(f"{low('z')} * {h}")} AS mid FROM x{n}),
        z{n} AS (SELECT * EXCLUDE (lo, mid) REPLACE ({join('((lo >> 32) + mid)', 'lo')} AS z) FROM p{n})"""

    return f"""s AS (SELECT *, {low('k')} + {low('g')} AS lo FROM ex),
        z0 AS (SELECT * EXCLUDE (lo, k, g), {join('((k >> 32) + (g >> 32) + (lo >> 32))', 'lo')} AS z FROM s),
        {mul(1, 0xBF58476D1CE4E5B9, '30')}, {mul(2, 0x94D049BB133111EB, '27')},
        u AS (SELECT *, CAST(xor(z, z >> 31) >> 16 AS DOUBLE) / 281474976710656.0 + 1.0 / 562949953421312.0 AS u FROM z2)"""


ORACLE = {
    "t1_encode_vocab": f"""WITH {_VOCAB},
        w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS token,
                     unnest(range(0, len(string_split(p_name || ' ' || p_type, ' ')))) AS pos FROM part),
        j AS (SELECT p_partkey, pos, coalesce(vocab.id, (SELECT max(id) + 1 FROM vocab)) AS id FROM w LEFT JOIN vocab USING (token))
        SELECT p_partkey, CAST(count(*) + 2 AS BIGINT) AS n,
               md5('1,' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) || ',2') AS ids_md5 FROM j GROUP BY p_partkey""",
    "f4_score_plugin": """SELECT 'benchmark' AS task, round(avg(CASE WHEN len(string_split(coalesce(text, ''), ' ')) >= 10 THEN 1.0 ELSE 0.0 END), 6)
        AS acc, CAST(count(*) AS BIGINT) AS n FROM benchmark""",
    "p2_glob_filter": f"SELECT DISTINCT p_name FROM part WHERE {_GLOB_SQL}",
    "u1_glob_union": f"SELECT DISTINCT p_name FROM part WHERE {_GLOB_SQL}",
    "p3_limit_per_group": f"""SELECT quality, toxic, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) AS rn
        FROM labels) WHERE rn <= {PER_GROUP}""",
    "t3_token_to_id": f"""WITH {_VOCAB}, pw AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token,
        unnest(range(0, len(string_split(p_name, ' ')))) AS pos FROM part)
        SELECT p_partkey, CAST(pos AS BIGINT) AS pos, pw.token, CAST(id AS BIGINT) AS id FROM pw JOIN vocab USING (token)""",
    "j1_vocab_lookup": f"""WITH {_VOCAB}, dw AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS token FROM documents)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(count(id) AS BIGINT) AS n_known
        FROM dw LEFT JOIN vocab USING (token) GROUP BY doc_id""",
    "t4_vocab_size": f"""WITH {_VOCAB} SELECT CAST(count(*) FILTER (WHERE NOT is_special) AS BIGINT) AS n_pieces,
        CAST(count(*) AS BIGINT) AS n_with_special FROM vocab""",
    "s11_read_vocab": f"WITH {_VOCAB} SELECT token, CAST(id AS BIGINT) AS id, is_special FROM vocab",
    "j5_with_cache": f"""SELECT item_id, CAST(CASE WHEN {h_sql('item_id')} % 2 = 0 THEN octet_length(encode(text)) ELSE length(text) END AS BIGINT)
        AS score, {h_sql('item_id')} % 2 = 0 AS from_cache FROM benchmark""",
    "j5_persistent_cache": f"""SELECT CAST(run AS BIGINT) AS run, item_id, CAST(length(text) AS BIGINT) AS score,
        run = 3 OR {h_sql('item_id')} % 2 = 0 AS from_cache FROM benchmark, range(2, 4) t(run)""",
    "j6_overlay": """SELECT coalesce(c.c_custkey, s.s_suppkey) AS key, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_acctbal ELSE c.c_acctbal END
        AS value, s.s_suppkey IS NOT NULL AS patched FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey""",
    "a18_eval_rollup": f"""WITH {_SCORES} SELECT task, round(avg(score), 6) AS acc, CAST(count(*) AS BIGINT) AS n,
        CAST({TASK_CONFIG['num_fewshot']} AS BIGINT) AS num_fewshot, CAST({TASK_CONFIG['bootstrap_iters']} AS BIGINT) AS bootstrap_iters
        FROM ts GROUP BY task""",
    "a19_bootstrap_se": f"""WITH {_SCORES}, kx AS (SELECT task, score, CAST({h_sql('doc_id')} AS UBIGINT) AS k FROM ts WHERE score IS NOT NULL),
        its AS MATERIALIZED (SELECT it, {_counter_sql('it')} AS g FROM range(0, {BOOT_ITERS}) r(it)),
        ex AS (SELECT task, score, it, k, g FROM kx, its), {_uniform_sql()},
        w AS (SELECT task, it, score, {_poisson_sql('u')} AS w FROM u),
        m AS (SELECT task, it, sum(w * score) / nullif(sum(w), 0) AS mean FROM w GROUP BY task, it)
        SELECT task, round(stddev_samp(mean), 9) AS stderr, CAST(count(mean) AS BIGINT) AS iters FROM m GROUP BY task""",
    "s10_eval_json": f"""WITH {_SCORES} SELECT task, round(avg(score), 6) AS acc, CAST(count(*) AS BIGINT) AS n,
        CAST({TASK_CONFIG['num_fewshot']} AS BIGINT) AS num_fewshot, CAST({TASK_CONFIG['bootstrap_iters']} AS BIGINT) AS bootstrap_iters
        FROM ts GROUP BY task""",
}
