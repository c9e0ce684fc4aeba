"""Instruction-sample plans over ``conversations``: prompts, masking,
shifting, batching, padding, stop cuts, response extraction, dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.operators.batches import longest, mask_labels, pad_batch, shift_targets, truncate_at_stop
from tokenloom.operators.joins import fetch_draws
from tokenloom.operators.offsets import running_offset
from tokenloom.operators.sampling import sample_batches
from tokenloom.operators.text import (PROMPT_NO_INPUT, PROMPT_RULES, PROMPT_WITH_INPUT, RESPONSE_MARKER, dispatch,
                                      extract_response, format_prompt, instruction_prompt, rule_stops, rule_table,
                                      rule_template, stops_text)
from tokenloom.operators.stops import truncate_at_stops
from tokenloom.operators.tokenize import ByteTokenizer
from tokenloom.functions.hashing import h48
from tokenloom.plans.common import SEED, h_sql, ids_md5, table
from tokenloom.session import scratch_path
from tokenloom.sources.tables import read_samples, write_samples

TOK = ByteTokenizer()
N_BATCHES, MICRO_BATCH = 8, 5
STOPS = [[ord(".") + 3, ord(" ") + 3], [TOK.eos_id]]
TURN_BITS = 20  # turns per conversation in a sample id
#: Names that reach every prompt rule and the default; rows take them in turn.
NAMES = ["stabilityai/stablelm-tuned-alpha-3b", "togethercomputer/RedPajama-3B-Chat", "togethercomputer/RedPajama-3B-Instruct",
         "tiiuae/falcon-7b-instruct", "lmsys/vicuna-7b", "lmsys/longchat-7b", "meta-llama/Llama-2-7b-chat", "NousResearch/Llama-2-7b-chat",
         "stabilityai/FreeWilly2", "garage/Platypus-30B", "NousResearch/Nous-Hermes-13b", "stabilityai/stablecode-instruct",
         "codellama/CodeLlama-7b", "mistralai/Mistral-7B-Instruct", "microsoft/phi-1_5", "eleuther/pythia-70m"]


def _name_of(key):
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod(key, F.lit(len(NAMES))) + 1).cast("int"))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, instruction, context, response): every user turn with the next
    assistant turn after it; the context is the text of the turn before, if any."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    answer = F.when(F.col("role") == "assistant", F.col("text"))
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("instruction"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("context"),
        F.first(answer, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("response"))
    return c.filter((F.col("role") == "user") & F.col("response").isNotNull()).drop("role")


def sample_id():
    """One number per (conversation, turn); ids and turns that do not fit raise."""
    fits = F.col("conv_id").between(0, (1 << (63 - TURN_BITS)) - 1) & F.col("turn").between(0, (1 << TURN_BITS) - 1)
    return F.when(fits, F.shiftleft(F.col("conv_id"), TURN_BITS) + F.col("turn")).otherwise(F.raise_error(F.lit("conversation or turn beyond the sample id")).cast("bigint"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, input_ids, labels): prompt + response + eos, prompt masked."""
    e = examples(spark, sf).withColumn("prompt", instruction_prompt(F.col("instruction")))
    ids = TOK.encode(F.concat("prompt", "response"), eos=True)
    return e.select(sample_id().alias("sample_id"), ids.alias("input_ids"),
                    TOK.length(F.col("prompt")).alias("prompt_len")) \
        .withColumn("labels", mask_labels(F.col("input_ids"), F.col("prompt_len")))


def indexed_samples(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf)
    return running_offset(s, "sample_id", F.shiftright(F.col("sample_id"), TURN_BITS + 10), None, out="idx")


def q_p6_instruction_prompt(spark, sf):
    e = examples(spark, sf).withColumn("prompt", instruction_prompt(F.col("instruction"), F.col("context")))
    return e.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("n_chars"))


def q_k12_mask_labels(spark, sf):
    s = samples(spark, sf)
    return s.select("sample_id", F.size("input_ids").cast("bigint").alias("n"), ids_md5("input_ids").alias("input_md5"),
                    ids_md5("labels").alias("labels_md5"),
                    F.size(F.filter("labels", lambda x: x == -1)).cast("bigint").alias("n_masked"))


def q_s7_read_samples(spark, sf):
    path = scratch_path(spark, "samples")
    write_samples(samples(spark, sf), path)
    s = read_samples(spark, path)
    return s.select("sample_id", F.size("input_ids").cast("bigint").alias("n"), ids_md5("input_ids").alias("input_md5"),
                    ids_md5("labels").alias("labels_md5"))


def q_k9_shift_targets(spark, sf):
    s = samples(spark, sf)
    x, y = shift_targets(F.col("input_ids"))
    return s.select("sample_id", ids_md5(x).alias("x_md5"), ids_md5(y).alias("y_md5"))


def q_k11_longest(spark, sf):
    return longest(indexed_samples(spark, sf), "idx")


def _batches(spark, sf):
    s = indexed_samples(spark, sf)
    # count and longest row from one small written frame of lengths, not from the samples again
    path = scratch_path(spark, "lengths")
    s.select("idx", F.size("input_ids").alias("n")).write.parquet(path)
    narrow = spark.read.parquet(path)
    li = longest(narrow, "idx", size=F.col("n")).select("longest_idx").scalar()
    return sample_batches(s, "idx", N_BATCHES, MICRO_BATCH, SEED, longest_idx=li, counted=narrow)


def q_r4_sample_batches(spark, sf):
    b = _batches(spark, sf)
    return b.select("batch", "slot", "idx", "sample_id", F.size("input_ids").cast("bigint").alias("n"))


def q_j3_fetch_draws(spark, sf):
    # the rows' ids and numbers once, without prompts and tokens; count and join read that table
    path = scratch_path(spark, "sample-index")
    ids = examples(spark, sf).select(sample_id().alias("sample_id"))
    running_offset(ids, "sample_id", F.shiftright(F.col("sample_id"), TURN_BITS + 10), None, out="idx").write.parquet(path)
    s = spark.read.parquet(path)
    n = s.agg(F.count(F.lit(1))).scalar()
    draws = spark.range(N_BATCHES * MICRO_BATCH).select(F.col("id").alias("draw"),
                                                        F.pmod(h48(SEED, F.col("id")), n).alias("idx"))
    return fetch_draws(draws, s, ["idx"]).select("draw", "idx", "sample_id")


def q_k10_pad_batch(spark, sf):
    p = pad_batch(_batches(spark, sf), "batch")
    return p.select("batch", "slot", F.size("x").cast("bigint").alias("width"), ids_md5("x").alias("x_md5"),
                    ids_md5("y").alias("y_md5"))


def q_k13_truncate_at_stop(spark, sf):
    e = examples(spark, sf)
    ids = TOK.encode(F.col("response"), eos=True)
    cut = truncate_at_stop(ids, STOPS)
    return e.select("conv_id", "turn", F.size(cut).cast("bigint").alias("n"), ids_md5(cut).alias("ids_md5"))


def stop_words(spark, sf) -> list[list[int]]:
    """Many stop sequences: the byte ids of the words of six letters or more of the benchmark (a list of
    settings, as wide as the benchmark)."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where(F.length("w") >= 6).distinct()
    return [list(r["ids"]) for r in words.select(TOK.encode(F.col("w")).alias("ids")).collect()]


def q_k13_truncate_many(spark, sf):
    e = examples(spark, sf)
    cut = truncate_at_stops(TOK.encode(F.col("response"), eos=True), stop_words(spark, sf))
    return e.select("conv_id", "turn", cut.alias("ids")).select("conv_id", "turn", F.size("ids").cast("bigint").alias("n"), ids_md5("ids").alias("ids_md5"))


def q_k13_truncate_compat(spark, sf):
    e = examples(spark, sf)
    ids = TOK.encode(F.col("response"), eos=True)
    cut = truncate_at_stop(ids, STOPS, compat=True)
    return e.select("conv_id", "turn", F.size(cut).cast("bigint").alias("n"), ids_md5(cut).alias("ids_md5"))


def q_p7_extract_response(spark, sf):
    e = examples(spark, sf)
    generated = F.concat(instruction_prompt(F.col("instruction")), F.lit(" "), F.col("response"))
    return e.select("conv_id", "turn", extract_response(generated).alias("response"))


def q_p5_format_prompt(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    rid = dispatch(_name_of(F.col("conv_id") + F.col("turn")))
    out = format_prompt(rule_template(rid), F.col("text"))
    return c.select("conv_id", "turn", rid.alias("rule_id"), F.md5(out).alias("prompt_md5"),
                    F.length(out).cast("bigint").alias("n_chars"))


def q_p4_dispatch(spark, sf):
    p = table(spark, sf, "part")
    rid = dispatch(F.concat_ws("/", _name_of(F.col("p_partkey")), F.col("p_name")))
    return p.select("p_partkey", rid.alias("rule_id"), F.md5(rule_template(rid)).alias("template_md5"),
                    rule_stops(rid).alias("stops"))


def q_j2_template_dispatch(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", dispatch(_name_of(F.col("doc_id"))).alias("rule_id"))
    j = d.join(rule_table(spark), "rule_id")
    return j.select("doc_id", "rule_id", F.md5("template").alias("template_md5"), "stops")


QUERIES = {
    "p6_instruction_prompt": q_p6_instruction_prompt,
    "k12_mask_labels": q_k12_mask_labels,
    "s7_read_samples": q_s7_read_samples,
    "k9_shift_targets": q_k9_shift_targets,
    "k11_longest": q_k11_longest,
    "r4_sample_batches": q_r4_sample_batches,
    "j3_fetch_draws": q_j3_fetch_draws,
    "k10_pad_batch": q_k10_pad_batch,
    "k13_truncate_at_stop": q_k13_truncate_at_stop,
    "k13_truncate_many": q_k13_truncate_many,
    "k13_truncate_compat": q_k13_truncate_compat,
    "p7_extract_response": q_p7_extract_response,
    "p5_format_prompt": q_p5_format_prompt,
    "p4_dispatch": q_p4_dispatch,
    "j2_template_dispatch": q_j2_template_dispatch,
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PROMPT = f"replace({lit(PROMPT_NO_INPUT)}, '{{instruction}}', instruction)"
_CONTEXT = (f"CASE WHEN length(context) > 0 THEN replace(replace({lit(PROMPT_WITH_INPUT)}, '{{instruction}}', instruction), '{{input}}', context) "
            f"ELSE {_PROMPT} END")
_EX = f"""
nx AS (SELECT u.conv_id, u.turn, min(a.turn) AS at FROM conversations u JOIN conversations a
       ON a.conv_id = u.conv_id AND a.turn > u.turn AND a.role = 'assistant' AND a.text IS NOT NULL WHERE u.role = 'user' GROUP BY u.conv_id, u.turn),
ex AS (SELECT nx.conv_id, nx.turn, ci.text AS instruction, ca.text AS response, coalesce(
         (SELECT arg_max(p.text, p.turn) FROM conversations p WHERE p.conv_id = nx.conv_id AND p.turn < nx.turn), '') AS context
       FROM nx JOIN conversations ci ON ci.conv_id = nx.conv_id AND ci.turn = nx.turn
       JOIN conversations ca ON ca.conv_id = nx.conv_id AND ca.turn = nx.at),
ep AS (SELECT conv_id, turn, instruction, response, {_PROMPT} AS prompt, {_CONTEXT} AS full_prompt FROM ex),
eb AS (SELECT (CAST(conv_id AS BIGINT) << {TURN_BITS}) + turn AS sample_id, hex(encode(prompt || response)) AS hx, octet_length(encode(prompt || response)) AS l,
              octet_length(encode(prompt)) AS p FROM ep),
sm AS (SELECT sample_id, p, list_concat(list_transform(range(0, l), lambda i: CAST(('0x' || substr(hx, 2 * i + 1, 2)) AS INTEGER) + 3), [2]) AS ids
       FROM eb),
sl AS (SELECT sample_id, ids, list_concat(list_transform(range(0, least(p, len(ids))), lambda i: -1),
                                   list_slice(ids, least(p, len(ids)) + 1, len(ids))) AS labels FROM sm),
si AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS idx, count(*) OVER () AS n FROM sl),
lg AS (SELECT max(len(ids)) AS longest, min(idx) FILTER (WHERE len(ids) = (SELECT max(len(ids)) FROM si)) AS longest_idx FROM si),
dr AS (SELECT d // {MICRO_BATCH} AS batch, d % {MICRO_BATCH} AS slot,
              CASE WHEN d = 0 THEN (SELECT longest_idx FROM lg) ELSE {h_sql('d')} % (SELECT max(n) FROM si) END AS idx
       FROM range(0, {N_BATCHES * MICRO_BATCH}) t(d)),
bt AS (SELECT dr.batch, dr.slot, si.* EXCLUDE (idx), dr.idx FROM dr JOIN si ON dr.idx = si.idx)"""


def _md5(lst: str) -> str:
    return f"md5(array_to_string({lst}, ','))"


def _dispatch_sql(col: str) -> str:
    parts = " ".join(f"WHEN regexp_matches({col}, {lit(p)}) THEN {rid}" for rid, p, _, _ in PROMPT_RULES)
    return f"CASE {parts} ELSE 0 END"


def _template_sql(rid: str) -> str:
    parts = " ".join(f"WHEN {rid} = {i} THEN {lit(t)}" for i, _, t, _ in PROMPT_RULES)
    return f"CASE {parts} ELSE '{{prompt}}' END"


def _stops_sql(rid: str) -> str:
    parts = " ".join(f"WHEN {rid} = {i} THEN {lit(stops_text(s))}" for i, _, _, s in PROMPT_RULES)
    return f"CASE {parts} ELSE {lit(stops_text([]))} END"


def _name_sql(key: str) -> str:
    return f"[{', '.join(lit(n) for n in NAMES)}][CAST(({key}) % {len(NAMES)} AS INTEGER) + 1]"


_RESP_IDS = "list_concat(list_transform(range(0, l), lambda i: CAST(('0x' || substr(hx, 2 * i + 1, 2)) AS INTEGER) + 3), [2])"
_STOP1 = f",{STOPS[0][0]},{STOPS[0][1]},"

ORACLE = {
    "p6_instruction_prompt": f"WITH {_EX} SELECT conv_id, turn, md5(full_prompt) AS prompt_md5, CAST(length(full_prompt) AS BIGINT) AS n_chars FROM ep",
    "k12_mask_labels": f"""WITH {_EX} SELECT sample_id, CAST(len(ids) AS BIGINT) AS n, {_md5('ids')} AS input_md5,
        {_md5('labels')} AS labels_md5, CAST(len(list_filter(labels, lambda x: x = -1)) AS BIGINT) AS n_masked FROM sl""",
    "s7_read_samples": f"""WITH {_EX} SELECT sample_id, CAST(len(ids) AS BIGINT) AS n, {_md5('ids')} AS input_md5,
        {_md5('labels')} AS labels_md5 FROM sl""",
    "k9_shift_targets": f"""WITH {_EX} SELECT sample_id, {_md5('list_slice(ids, 1, len(ids) - 1)')} AS x_md5,
        {_md5('list_slice(ids, 2, len(ids))')} AS y_md5 FROM sl""",
    "k11_longest": f"WITH {_EX} SELECT CAST(longest AS BIGINT) AS longest, CAST(longest_idx AS BIGINT) AS longest_idx FROM lg",
    "r4_sample_batches": f"""WITH {_EX} SELECT CAST(batch AS BIGINT) AS batch, CAST(slot AS BIGINT) AS slot,
        CAST(idx AS BIGINT) AS idx, sample_id, CAST(len(ids) AS BIGINT) AS n FROM bt""",
    "j3_fetch_draws": f"""WITH {_EX}, d2 AS (SELECT d AS draw, {h_sql('d')} % (SELECT max(n) FROM si) AS idx
        FROM range(0, {N_BATCHES * MICRO_BATCH}) t(d))
        SELECT CAST(draw AS BIGINT) AS draw, CAST(d2.idx AS BIGINT) AS idx, si.sample_id FROM d2 JOIN si ON d2.idx = si.idx""",
    "k10_pad_batch": f"""WITH {_EX}, pw AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM bt)
        SELECT CAST(batch AS BIGINT) AS batch, CAST(slot AS BIGINT) AS slot, CAST(m AS BIGINT) AS width,
               {_md5("list_concat(ids, list_transform(range(0, m - len(ids)), lambda i: 0))")} AS x_md5,
               {_md5("list_concat(labels, list_transform(range(0, m - len(labels)), lambda i: -1))")} AS y_md5 FROM pw""",
    "k13_truncate_at_stop": f"""WITH {_EX},
        rb AS (SELECT conv_id, turn, hex(encode(response)) AS hx, octet_length(encode(response)) AS l FROM ex),
        ri AS (SELECT conv_id, turn, {_RESP_IDS} AS ids FROM rb),
        rs AS (SELECT conv_id, turn, ids, ',' || array_to_string(ids, ',') || ',' AS s FROM ri),
        rp AS (SELECT conv_id, turn, ids, s, strpos(s, '{_STOP1}') AS p1, strpos(s, ',{STOPS[1][0]},') AS p2 FROM rs),
        rk AS (SELECT conv_id, turn, ids, least(
                 CASE WHEN p1 > 0 THEN length(substr(s, 1, p1)) - length(replace(substr(s, 1, p1), ',', '')) - 1 ELSE 1000000000 END,
                 CASE WHEN p2 > 0 THEN length(substr(s, 1, p2)) - length(replace(substr(s, 1, p2), ',', '')) - 1 ELSE 1000000000 END,
                 len(ids)) AS k FROM rp)
        SELECT conv_id, turn, CAST(k AS BIGINT) AS n, {_md5('list_slice(ids, 1, k)')} AS ids_md5 FROM rk""",
    "k13_truncate_many": f"""WITH {_EX},
        w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 6),
        rb AS (SELECT conv_id, turn, hex(encode(response)) AS hx, octet_length(encode(response)) AS l FROM ex),
        ri AS (SELECT conv_id, turn, {_RESP_IDS} AS ids FROM rb),
        m AS (SELECT conv_id, turn, octet_length(encode(substr(response, 1, strpos(response, w) - 1))) AS st, octet_length(encode(w)) AS n
              FROM ex, w WHERE strpos(response, w) > 0),
        f AS (SELECT conv_id, turn, arg_min(st, (st + n) * 1000000 - n) AS st FROM m GROUP BY conv_id, turn),
        rk AS (SELECT ri.conv_id, ri.turn, ids, coalesce(f.st, len(ids)) AS k FROM ri LEFT JOIN f ON f.conv_id = ri.conv_id AND f.turn = ri.turn)
        SELECT conv_id, turn, CAST(k AS BIGINT) AS n, {_md5('list_slice(ids, 1, k)')} AS ids_md5 FROM rk""",
    "k13_truncate_compat": f"""WITH {_EX},
        rb AS (SELECT conv_id, turn, hex(encode(response)) AS hx, octet_length(encode(response)) AS l FROM ex),
        ri AS (SELECT conv_id, turn, {_RESP_IDS} AS ids FROM rb),
        rs AS (SELECT conv_id, turn, ids, ',' || array_to_string(ids, ',') || ',' AS s FROM ri),
        rp AS (SELECT conv_id, turn, ids, s, strpos(s, '{_STOP1}') AS p1, strpos(s, ',{STOPS[1][0]},') AS p2 FROM rs),
        re AS (SELECT conv_id, turn, ids, least(
                 CASE WHEN p1 > 0 THEN length(substr(s, 1, p1)) - length(replace(substr(s, 1, p1), ',', '')) + 1 ELSE 1000000000 END,
                 CASE WHEN p2 > 0 THEN length(substr(s, 1, p2)) - length(replace(substr(s, 1, p2), ',', '')) ELSE 1000000000 END) AS t
               FROM rp),
        rk AS (SELECT conv_id, turn, ids, CASE WHEN t < 1000000000 THEN 2 * ((t - 1) // 2) ELSE 2 * (len(ids) // 2) END AS k FROM re)
        SELECT conv_id, turn, CAST(k AS BIGINT) AS n, {_md5('list_slice(ids, 1, k)')} AS ids_md5 FROM rk""",
    "p7_extract_response": f"""WITH {_EX} SELECT conv_id, turn,
        regexp_replace(regexp_replace(split_part(prompt || ' ' || response, {lit(RESPONSE_MARKER)}, 2), '^\\s+', ''), '\\s+$', '') AS response
        FROM ep""",
    "p5_format_prompt": f"""WITH c0 AS (SELECT conv_id, turn, text, {_name_sql('conv_id + turn')} AS name FROM conversations WHERE role = 'user'),
        c AS (SELECT conv_id, turn, text, {_dispatch_sql('name')} AS rule_id FROM c0),
        f AS (SELECT *, replace({_template_sql('rule_id')}, '{{prompt}}', text) AS o FROM c)
        SELECT conv_id, turn, rule_id, md5(o) AS prompt_md5, CAST(length(o) AS BIGINT) AS n_chars FROM f""",
    "p4_dispatch": f"""WITH n AS (SELECT p_partkey, {_name_sql('p_partkey')} || '/' || p_name AS name FROM part),
        d AS (SELECT p_partkey, {_dispatch_sql('name')} AS rule_id FROM n)
        SELECT p_partkey, rule_id, md5({_template_sql('rule_id')}) AS template_md5, {_stops_sql('rule_id')} AS stops FROM d""",
    "j2_template_dispatch": f"""WITH n AS (SELECT doc_id, {_name_sql('doc_id')} AS name FROM documents),
        d AS (SELECT doc_id, {_dispatch_sql('name')} AS rule_id FROM n)
        SELECT doc_id, rule_id, md5({_template_sql('rule_id')}) AS template_md5, {_stops_sql('rule_id')} AS stops FROM d""",
}
