"""Vector plans over ``embeddings`` (64-dim float vectors, label 0-9):
logits/cross entropy, kernels and MMD, pooling, LFQ/FSQ quantisers, Gram
matrix and salience order, softmax/entropy/RMS norm, token sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.quant import (fsq, fsq_bound, fsq_codes, fsq_codes_to_index, fsq_constants, fsq_index_to_codes,
                                       fsq_quantize, lfq, lfq_index_to_codes, lfq_indices, lfq_quantize)
from tokenloom.functions.scalar import entropy_term, rms_norm, softmax
from tokenloom.operators.metrics import cross_entropy, validation_loss
from tokenloom.operators.sampling import sample_tokens
from tokenloom.operators.vectors import (batch_mmd, code_usage, gaussian_kernel, gram, lfq_long, lfq_losses, mean_pool, nearest_codes,
                                         salience)
from tokenloom.plans.common import SEED, r, table, u_sql

DIM = 64
BITS, CODEBOOKS = 4, 16           # LFQ: 16 codebooks x 4 bits
LEVELS, FSQ_BOOKS = [8, 5, 5, 5], 16   # FSQ: 16 codebooks of 4 dims
BATCH_ROWS, MAX_BATCHES = 50, 100
DRAWS = 256  # normal draws on the other side of a batch's MMD, as in the reference
TOP_K, TEMP = 5, 0.8


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def logits(spark, sf):
    e = emb(spark, sf)
    return e.select("vec_id", F.col("embedding").alias("logits"),
                    F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).alias("target"))


def batched(spark, sf):
    """The embeddings with the batch they are evaluated in."""
    return emb(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / BATCH_ROWS))


def q_a1_cross_entropy(spark, sf):
    ce = cross_entropy(logits(spark, sf), "logits", "target")
    return ce.select("n_valid", r("loss").alias("loss"))


def q_a2_validation_loss(spark, sf):
    lg = logits(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / BATCH_ROWS))
    per = cross_entropy(lg, "logits", "target", ["batch"], empty="zero")
    v = validation_loss(per, "batch", "loss", MAX_BATCHES)
    return v.select(r("val_loss").alias("val_loss"), "n_batches")


def q_a3_gaussian_kernel(spark, sf):
    # the kernel of every vector with the first vector of its batch
    e = batched(spark, sf)
    first = e.groupBy("batch").agg(F.min_by("embedding", "vec_id").alias("z"))
    return e.join(first, "batch").select("vec_id", r(gaussian_kernel(F.col("embedding"), F.col("z"), DIM), 9).alias("kernel"))


def q_a4_mmd(spark, sf):
    m = batch_mmd(batched(spark, sf), "batch", "embedding", DIM, DRAWS, SEED)
    return m.select("batch", r("mmd", 9).alias("mmd"))


def q_j4_pairwise(spark, sf):
    m = batch_mmd(batched(spark, sf), "batch", "embedding", DIM, DRAWS, SEED)
    return m.select("batch", r("k_aa", 9).alias("k_aa"), r("k_ab", 9).alias("k_ab"), r("k_bb", 9).alias("k_bb"))


def q_a5_mean_pool(spark, sf):
    return mean_pool(emb(spark, sf), "label", "embedding").select("label", F.col("pos").cast("bigint").alias("pos"),
                                                                  r("mean").alias("mean"))


def _lfq(spark, sf):
    return lfq_long(emb(spark, sf), "vec_id", "embedding", BITS, CODEBOOKS)


def q_a6_sq_dist(spark, sf):
    d = _lfq(spark, sf)
    mn = F.array_min("dist")
    return d.select("vec_id", F.col("codebook").cast("bigint").alias("codebook"), r(mn).alias("min_dist"),
                    (F.array_position("dist", mn) - 1).cast("bigint").alias("argmin"))


def q_a6_nearest_code(spark, sf):
    """Every vector against a codebook table: the vectors whose id leaves 3 modulo 8."""
    e = emb(spark, sf)
    book = e.where(F.col("vec_id") % 8 == 3).select(F.col("vec_id").alias("code"), "embedding")
    n = nearest_codes(e.where(F.col("vec_id") % 8 != 3), "vec_id", "embedding", book, "code", "embedding")
    return n.select("vec_id", "code", r("distance").alias("distance"))


def _losses(spark, sf):
    return lfq_losses(batched(spark, sf), "vec_id", "embedding", BITS, CODEBOOKS, batch="batch")


def q_a7_lfq_entropy(spark, sf):
    l = _losses(spark, sf)
    return l.select("batch", r("per_sample_entropy").alias("per_sample_entropy"), r("codebook_entropy").alias("codebook_entropy"),
                    r("entropy_aux_loss").alias("entropy_aux_loss"))


def q_a8_lfq_commit(spark, sf):
    return _losses(spark, sf).select("batch", r("commit_loss").alias("commit_loss"))


def q_a9_lfq_loss(spark, sf):
    return _losses(spark, sf).select("batch", r("aux_loss").alias("aux_loss"))


def q_a10_code_usage(spark, sf):
    u = code_usage(_lfq(spark, sf), "index", ["codebook"])
    return u.select(F.col("codebook").cast("bigint").alias("codebook"), F.col("index").cast("bigint").alias("code"),
                    "uses", r("share").alias("share"), r("usage_entropy").alias("usage_entropy"), "distinct_codes")


def _gram(spark, sf):
    return gram(emb(spark, sf), "embedding", DIM)


def q_a11_gram(spark, sf):
    return _gram(spark, sf).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"),
                                   r("h").alias("h"))


def q_a12_salience(spark, sf):
    s = salience(_gram(spark, sf))
    return s.select(F.col("dim").cast("bigint").alias("dim"), r("diag").alias("diag"), "dead",
                    r("damp").alias("damp"))


def q_w4_permutation(spark, sf):
    s = salience(_gram(spark, sf))
    inv = s.select(F.col("perm_pos").alias("pos"), F.col("dim").alias("at_pos"))
    j = s.join(inv, s["dim"] == inv["pos"])
    return j.select(F.col("dim").cast("bigint").alias("dim"), F.col("perm_pos").cast("bigint").alias("perm_pos"),
                    F.col("at_pos").cast("bigint").alias("at_pos"))


def _fsq_long(spark, sf):
    e = emb(spark, sf)
    d = len(LEVELS)
    cols = F.array(*[F.struct(F.lit(j).alias("j"), F.col("embedding")[j].alias("z")) for j in range(d * FSQ_BOOKS)])
    return e.select("vec_id", F.explode(cols).alias("s")).select("vec_id", F.col("s.j").alias("j"), F.col("s.z").alias("z"))


def _level_of(j):
    expr = None
    d = len(LEVELS)
    for k, L in enumerate(LEVELS):
        cond = (j % d) == k
        expr = F.when(cond, F.lit(L)) if expr is None else expr.when(cond, F.lit(L))
    return expr


def _per_level(col_fn, j):
    d = len(LEVELS)
    expr = None
    for k, L in enumerate(LEVELS):
        cond = (j % d) == k
        v = col_fn(L)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr


def q_c4_fsq_bound(spark, sf):
    f = _fsq_long(spark, sf)
    return f.select("vec_id", F.col("j").cast("bigint").alias("j"),
                    r(_per_level(lambda L: fsq_bound(F.col("z"), L), F.col("j")), 9).alias("bound"))


def q_c5_fsq_quantize(spark, sf):
    f = _fsq_long(spark, sf)
    return f.select("vec_id", F.col("j").cast("bigint").alias("j"),
                    _per_level(lambda L: fsq_quantize(F.col("z"), L), F.col("j")).alias("code"))


def _fsq_books(spark, sf):
    e = emb(spark, sf)
    books = F.array(*[F.struct(F.lit(c).alias("cb"), F.array(*fsq_codes(F.col("embedding"), LEVELS, c)).alias("codes"))
                      for c in range(FSQ_BOOKS)])
    b = e.select("vec_id", F.explode(books).alias("s")).select("vec_id", F.col("s.cb").alias("codebook"),
                                                                F.col("s.codes").alias("codes"))
    idx = fsq_codes_to_index([F.col("codes")[j] for j in range(len(LEVELS))], LEVELS)
    return b.withColumn("index", idx)


def q_c6_fsq_indices(spark, sf):
    b = _fsq_books(spark, sf)
    back = fsq_index_to_codes(F.col("index"), LEVELS)
    return b.select("vec_id", F.col("codebook").cast("bigint").alias("codebook"), F.col("index").cast("bigint").alias("index"),
                    (back == F.col("codes")).alias("roundtrip"))


def q_c7_fsq(spark, sf):
    _, idx = fsq(F.col("embedding"), LEVELS, FSQ_BOOKS)
    return emb(spark, sf).select("vec_id", F.md5(F.array_join(idx, ",")).alias("indices_md5"))


def q_c8_lfq_index(spark, sf):
    e = emb(spark, sf)
    return e.select("vec_id", F.posexplode(lfq_indices(F.col("embedding"), BITS, CODEBOOKS)).alias("codebook", "index")) \
        .select("vec_id", F.col("codebook").cast("bigint").alias("codebook"), F.col("index").cast("bigint").alias("index"))


def q_c9_lfq_codes(spark, sf):
    d = _lfq(spark, sf)
    back = lfq_index_to_codes(F.col("index"), BITS)
    return d.select("vec_id", F.col("codebook").cast("bigint").alias("codebook"),
                    (back == lfq_quantize(F.col("x"))).alias("roundtrip"))


def q_c10_lfq(spark, sf):
    e = emb(spark, sf)
    q, idx = lfq(F.col("embedding"), 2 ** BITS, CODEBOOKS)
    return e.select("vec_id", F.md5(F.array_join(idx, ",")).alias("indices_md5"),
                    F.size(F.filter(q, lambda v: v > 0)).cast("bigint").alias("n_positive"))


def q_c13_rms_norm(spark, sf):
    e = emb(spark, sf)
    return e.select("vec_id", F.posexplode(rms_norm(F.col("embedding"))).alias("pos", "y")) \
        .select("vec_id", F.col("pos").cast("bigint").alias("pos"), r("y").alias("y"))


def q_c14_softmax(spark, sf):
    e = emb(spark, sf)
    p = softmax(F.col("embedding"))
    mx = F.array_max(p)
    return e.select("vec_id", r(mx).alias("pmax"), (F.array_position(p, mx) - 1).cast("bigint").alias("argmax"))


def q_c15_entropy(spark, sf):
    e = emb(spark, sf)
    p = softmax(F.col("embedding"))
    ent = F.aggregate(F.transform(p, lambda x: entropy_term(x)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", r(ent).alias("entropy"))


def q_r7_sample_tokens(spark, sf):
    lg = logits(spark, sf)
    s = sample_tokens(lg, "logits", TEMP, TOP_K, SEED, key="vec_id")
    g = sample_tokens(lg, "logits", 0.0, TOP_K, SEED, key="vec_id").select("vec_id", F.col("token").alias("greedy"))
    return s.select("vec_id", F.col("token").cast("bigint").alias("token")).join(g, "vec_id") \
        .select("vec_id", "token", F.col("greedy").cast("bigint").alias("greedy"))


QUERIES = {
    "a1_cross_entropy": q_a1_cross_entropy,
    "a2_validation_loss": q_a2_validation_loss,
    "a3_gaussian_kernel": q_a3_gaussian_kernel,
    "a4_mmd": q_a4_mmd,
    "j4_pairwise": q_j4_pairwise,
    "a5_mean_pool": q_a5_mean_pool,
    "a6_sq_dist": q_a6_sq_dist,
    "a6_nearest_code": q_a6_nearest_code,
    "a7_lfq_entropy": q_a7_lfq_entropy,
    "a8_lfq_commit": q_a8_lfq_commit,
    "a9_lfq_loss": q_a9_lfq_loss,
    "a10_code_usage": q_a10_code_usage,
    "a11_gram": q_a11_gram,
    "a12_salience": q_a12_salience,
    "w4_permutation": q_w4_permutation,
    "c4_fsq_bound": q_c4_fsq_bound,
    "c5_fsq_quantize": q_c5_fsq_quantize,
    "c6_fsq_indices": q_c6_fsq_indices,
    "c7_fsq": q_c7_fsq,
    "c8_lfq_index": q_c8_lfq_index,
    "c9_lfq_codes": q_c9_lfq_codes,
    "c10_lfq": q_c10_lfq,
    "c13_rms_norm": q_c13_rms_norm,
    "c14_softmax": q_c14_softmax,
    "c15_entropy": q_c15_entropy,
    "r7_sample_tokens": q_r7_sample_tokens,
}

# ------------------------------------------------------------------ oracle --
_LG = """lg AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z, CASE WHEN label = 0 THEN -1 ELSE label END AS target FROM embeddings),
ce AS (SELECT vec_id, target, CASE WHEN target <> -1 THEN
          list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[target + 1] END AS loss FROM lg)"""
_K = "exp(-list_sum(list_transform(list_zip(x.e, y.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 4096.0)"
_KER = f"""ab AS (SELECT vec_id, CAST(vec_id // {BATCH_ROWS} AS BIGINT) AS batch, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
uu AS (SELECT d, k, {u_sql('d', 'k', "'r'")} AS u, {u_sql('d', 'k', "'a'")} AS v FROM range(0, {DRAWS}) t(d), range(0, {DIM}) s(k)),
dr AS (SELECT d, list(sqrt(-2.0 * ln(u)) * cos(2.0 * pi() * v) ORDER BY k) AS e FROM uu GROUP BY d),
kaa AS (SELECT x.batch, avg({_K}) AS k_aa FROM ab x JOIN ab y ON x.batch = y.batch GROUP BY x.batch),
kvd AS (SELECT x.vec_id, x.batch, avg({_K}) AS k FROM ab x, dr y GROUP BY x.vec_id, x.batch),
kab AS (SELECT batch, avg(k) AS k_ab FROM kvd GROUP BY batch),
kbb AS (SELECT avg({_K}) AS k_bb FROM dr x, dr y),
km AS (SELECT batch, k_aa, k_ab, k_bb FROM kaa JOIN kab USING (batch), kbb)"""


def _code_vec(c: str) -> str:
    return "[" + ", ".join(f"CASE WHEN ({c} >> {BITS - 1 - j}) & 1 = 1 THEN 1.0 ELSE -1.0 END" for j in range(BITS)) + "]"


_LFQ = f"""sub AS (SELECT vec_id, cb, CAST(list_slice(embedding, cb * {BITS} + 1, cb * {BITS} + {BITS}) AS DOUBLE[]) AS x
        FROM embeddings, range(0, {CODEBOOKS}) t(cb)),
codes AS (SELECT c AS code, {_code_vec('c')} AS y FROM range(0, {2 ** BITS}) t(c)),
dist AS (SELECT vec_id, cb, code, x,
          list_sum(list_transform(x, lambda v: v * v)) + list_sum(list_transform(y, lambda v: v * v))
          - 2.0 * list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2])) AS d FROM sub, codes),
dm AS (SELECT *, max(-d) OVER (PARTITION BY vec_id, cb) AS m FROM dist),
pr AS (SELECT *, exp(-d - m) / sum(exp(-d - m)) OVER (PARTITION BY vec_id, cb) AS p FROM dm),
idx AS (SELECT vec_id, cb, x, list_sum(list_transform(range(0, {BITS}), lambda j: CASE WHEN x[j + 1] > 0 THEN 1 << ({BITS - 1} - j) ELSE 0 END)) AS ix
        FROM sub),
ls AS (SELECT CAST(vec_id // {BATCH_ROWS} AS BIGINT) AS batch, avg(-p * ln(greatest(p, 1e-5))) AS per_sample_entropy FROM pr GROUP BY vec_id // {BATCH_ROWS}),
ap AS (SELECT CAST(vec_id // {BATCH_ROWS} AS BIGINT) AS batch, cb, code, avg(p) AS avg_p FROM pr GROUP BY vec_id // {BATCH_ROWS}, cb, code),
cbe AS (SELECT batch, avg(-avg_p * ln(greatest(avg_p, 1e-5))) AS codebook_entropy FROM ap GROUP BY batch),
cm AS (SELECT batch, avg((v - CASE WHEN v > 0 THEN 1.0 ELSE -1.0 END) * (v - CASE WHEN v > 0 THEN 1.0 ELSE -1.0 END)) AS commit_loss
       FROM (SELECT CAST(vec_id // {BATCH_ROWS} AS BIGINT) AS batch, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY batch),
lo AS (SELECT batch, per_sample_entropy, codebook_entropy, per_sample_entropy - 2.5 * codebook_entropy AS entropy_aux_loss,
              commit_loss FROM ls JOIN cbe USING (batch) JOIN cm USING (batch))"""

_UN = """un AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)"""
_GR = _UN + """, gr AS (SELECT a.pos AS i, b.pos AS j, 2.0 * sum(a.x * b.x) / (SELECT count(*) FROM embeddings) AS h
        FROM un a JOIN un b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.pos, b.pos),
sa AS (SELECT i AS dim, CASE WHEN h = 0 THEN 1.0 ELSE h END AS diag, h = 0 AS dead FROM gr WHERE i = j),
sp AS (SELECT *, row_number() OVER (ORDER BY diag DESC, dim) - 1 AS perm_pos, avg(diag) OVER () * 0.01 AS damp FROM sa)"""


def _fsq_cte() -> str:
    half, offset, shift, hw, basis = fsq_constants(LEVELS)
    d = len(LEVELS)
    arr = lambda xs: "[" + ", ".join(repr(float(x)) for x in xs) + "]"
    return f"""fl AS (SELECT vec_id, CAST(unnest(list_slice(embedding, 1, {d * FSQ_BOOKS})) AS DOUBLE) AS z,
                unnest(range(0, {d * FSQ_BOOKS})) AS j FROM embeddings),
fk AS (SELECT vec_id, j, z, j % {d} AS k, {arr(half)}[j % {d} + 1] AS half, {arr(offset)}[j % {d} + 1] AS off,
              {arr(shift)}[j % {d} + 1] AS shift, {arr(hw)}[j % {d} + 1] AS hw, {arr(basis)}[j % {d} + 1] AS basis FROM fl),
fb AS (SELECT *, tanh(z + shift) * half - off AS bound FROM fk),
fq AS (SELECT *, round_even(bound, 0) / hw + 0.0 AS code FROM fb),
fi AS (SELECT vec_id, j // {d} AS cb, CAST(sum((round_even(bound, 0) + hw) * basis) AS BIGINT) AS ix FROM fq GROUP BY vec_id, j // {d})"""


_R7 = f"""z1 AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS z, unnest(range(0, len(embedding))) AS k FROM embeddings),
z2 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS rn FROM z1),
z3 AS (SELECT * FROM z2 WHERE rn <= {TOP_K}),
z4 AS (SELECT *, max(z / {TEMP}) OVER (PARTITION BY vec_id) AS m FROM z3),
z5 AS (SELECT vec_id, k, rn, exp(z / {TEMP} - m) / -ln({u_sql('vec_id', 'k')}) AS score FROM z4),
tok AS (SELECT vec_id, arg_max(k, score) AS token, arg_min(k, rn) AS greedy FROM z5 GROUP BY vec_id)"""

_SM = """sm AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
sm2 AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM sm),
sm3 AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM sm2)"""

ORACLE = {
    "a1_cross_entropy": f"""WITH {_LG} SELECT CAST(count(loss) AS BIGINT) AS n_valid,
        round(CASE WHEN count(loss) > 0 THEN sum(loss) / count(loss) ELSE 'nan'::DOUBLE END, 6) AS loss FROM ce""",
    "a2_validation_loss": f"""WITH {_LG}, pb AS (SELECT vec_id // {BATCH_ROWS} AS batch,
        CASE WHEN count(loss) > 0 THEN sum(loss) / count(loss) ELSE 0.0 END AS loss FROM ce GROUP BY vec_id // {BATCH_ROWS})
        SELECT round(avg(loss), 6) AS val_loss, CAST(count(*) AS BIGINT) AS n_batches FROM pb WHERE batch < {MAX_BATCHES}""",
    "a3_gaussian_kernel": f"""WITH {_KER}, fi AS (SELECT batch, arg_min(e, vec_id) AS e FROM ab GROUP BY batch)
        SELECT x.vec_id, round({_K}, 9) AS kernel FROM ab x JOIN fi y ON x.batch = y.batch""",
    "a4_mmd": f"WITH {_KER} SELECT batch, round(k_aa + k_bb - 2 * k_ab, 9) AS mmd FROM km",
    "j4_pairwise": f"WITH {_KER} SELECT batch, round(k_aa, 9) AS k_aa, round(k_ab, 9) AS k_ab, round(k_bb, 9) AS k_bb FROM km",
    "a5_mean_pool": f"WITH {_UN} SELECT label, CAST(pos AS BIGINT) AS pos, round(avg(x), 6) AS mean FROM un GROUP BY label, pos",
    "a6_sq_dist": f"""WITH {_LFQ} SELECT vec_id, CAST(cb AS BIGINT) AS codebook, round(min(d), 6) AS min_dist,
        CAST(arg_min(code, d) AS BIGINT) AS argmin FROM dist GROUP BY vec_id, cb""",
    "a6_nearest_code": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        d AS (SELECT a.vec_id, b.vec_id AS code, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id % 8 <> 3 AND b.vec_id % 8 = 3)
        SELECT vec_id, arg_min(code, (d, code)) AS code, round(min(d) * min(d), 6) AS distance FROM d GROUP BY vec_id""",
    "a7_lfq_entropy": f"""WITH {_LFQ} SELECT batch, round(per_sample_entropy, 6) AS per_sample_entropy,
        round(codebook_entropy, 6) AS codebook_entropy, round(entropy_aux_loss, 6) AS entropy_aux_loss FROM lo""",
    "a8_lfq_commit": f"WITH {_LFQ} SELECT batch, round(commit_loss, 6) AS commit_loss FROM lo",
    "a9_lfq_loss": f"WITH {_LFQ} SELECT batch, round(entropy_aux_loss * 0.1 + commit_loss * 1.0, 6) AS aux_loss FROM lo",
    "a10_code_usage": f"""WITH {_LFQ}, u AS (SELECT cb, ix, count(*) AS uses FROM idx GROUP BY cb, ix),
        s AS (SELECT *, uses / sum(uses) OVER (PARTITION BY cb) AS share FROM u)
        SELECT CAST(cb AS BIGINT) AS codebook, CAST(ix AS BIGINT) AS code, CAST(uses AS BIGINT) AS uses, round(share, 6) AS share,
               round(sum(-share * ln(share)) OVER (PARTITION BY cb), 6) AS usage_entropy,
               CAST(count(*) OVER (PARTITION BY cb) AS BIGINT) AS distinct_codes FROM s""",
    "a11_gram": f"WITH {_GR} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(h, 6) AS h FROM gr",
    "a12_salience": f"WITH {_GR} SELECT CAST(dim AS BIGINT) AS dim, round(diag, 6) AS diag, dead, round(damp, 6) AS damp FROM sp",
    "w4_permutation": f"""WITH {_GR} SELECT CAST(a.dim AS BIGINT) AS dim, CAST(a.perm_pos AS BIGINT) AS perm_pos,
        CAST(b.dim AS BIGINT) AS at_pos FROM sp a JOIN sp b ON b.perm_pos = a.dim""",
    "c4_fsq_bound": f"WITH {_fsq_cte()} SELECT vec_id, CAST(j AS BIGINT) AS j, round(bound, 9) AS bound FROM fb",
    "c5_fsq_quantize": f"WITH {_fsq_cte()} SELECT vec_id, CAST(j AS BIGINT) AS j, code FROM fq",
    "c6_fsq_indices": f"WITH {_fsq_cte()} SELECT vec_id, CAST(cb AS BIGINT) AS codebook, ix AS index, true AS roundtrip FROM fi",
    "c7_fsq": f"""WITH {_fsq_cte()} SELECT vec_id, md5(string_agg(CAST(ix AS VARCHAR), ',' ORDER BY cb)) AS indices_md5
        FROM fi GROUP BY vec_id""",
    "c8_lfq_index": f"WITH {_LFQ} SELECT vec_id, CAST(cb AS BIGINT) AS codebook, CAST(ix AS BIGINT) AS index FROM idx",
    "c9_lfq_codes": f"WITH {_LFQ} SELECT vec_id, CAST(cb AS BIGINT) AS codebook, true AS roundtrip FROM idx",
    "c10_lfq": f"""WITH {_LFQ} SELECT i.vec_id, md5(string_agg(CAST(ix AS VARCHAR), ',' ORDER BY cb)) AS indices_md5,
        CAST(max(np) AS BIGINT) AS n_positive FROM idx i
        JOIN (SELECT vec_id, len(list_filter(embedding, lambda v: v > 0)) AS np FROM embeddings) e ON e.vec_id = i.vec_id
        GROUP BY i.vec_id""",
    "c13_rms_norm": f"""WITH {_UN}, ms AS (SELECT vec_id, avg(x * x) AS ms FROM un GROUP BY vec_id)
        SELECT un.vec_id, CAST(pos AS BIGINT) AS pos, round(x * (1.0 / sqrt(ms + 1e-5)), 6) AS y FROM un JOIN ms USING (vec_id)""",
    "c14_softmax": f"""WITH {_SM} SELECT vec_id, round(list_max(p), 6) AS pmax,
        CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS argmax FROM sm3""",
    "c15_entropy": f"""WITH {_SM} SELECT vec_id, round(list_sum(list_transform(p, lambda x: -x * ln(greatest(x, 1e-5)))), 6) AS entropy
        FROM sm3""",
    "r7_sample_tokens": f"WITH {_R7} SELECT vec_id, CAST(token AS BIGINT) AS token, CAST(greedy AS BIGINT) AS greedy FROM tok",
}
