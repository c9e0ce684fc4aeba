"""Name globbing, per-group limits, prompt dispatch and formatting,
response extraction (P2-P7, J2, U1)."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ordered prompt rules (pattern searched anywhere in the model
# name, template with a {prompt} placeholder, stop sequences besides eos: pieces
# to look up, or ids that are fixed for that family's vocabulary).
# The first matching rule wins; no match -> the default "{prompt}".
LLAMA2_SYSTEM = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe."
    "  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content."
    " Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make"
    " any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't"
    " know the answer to a question, please don't share false information."
)
PROMPT_RULES = [
    (1, r"stabilityai.*tuned-alpha",
     "<|SYSTEM|># StableLM Tuned (Alpha version)\n- StableLM is a helpful and harmless open-source AI language model"
     " developed by StabilityAI.\n- StableLM is excited to be able to help the user, but will refuse to do anything"
     " that could be considered harmful to the user.\n- StableLM is more than just an information source, StableLM"
     " is also able to write poetry, short stories, and make jokes.\n- StableLM will refuse to participate in"
     " anything that could harm a human.<|USER|>{prompt}<|ASSISTANT|>",
     [["<|SYSTEM|>"], ["<|ASSISTANT|>"], ["<|USER|>"]]),
    (2, r"togethercomputer.*Chat", "<human>: {prompt}\n<bot>:", [["<", "human", ">:"], ["<", "bot", ">:"]]),
    (3, r"togethercomputer.*Instruct", "Q: {prompt}\nA:",
     [["Q", ":"], ["Question"], ["A", ":"], ["Label", ":"], [187, 187], [535], [2756]]),
    (4, r"falcon.*-instruct", "Do not prefix your replies with 'Bot: '\nUser: {prompt}\n",
     [["User", ":"], [193, "User"]]),
    (5, r"vicuna|longchat",
     "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed,"
     " and polite answers to the user's questions. USER: {prompt} ASSISTANT:", []),
    (6, r"Llama-2.*-chat", "[INST] <<SYS>>\n" + LLAMA2_SYSTEM + "\n<</SYS>>\n\n {prompt} [/INST] ", []),
    (7, r"FreeWilly2",
     "### System:\nThis is a system prompt, please behave and help the user.\n\n### User:\n{prompt}\n\n### Assistant:\n",
     []),
    (8, r"Platypus", "### Instruction:\n\n{prompt}\n\n### Response:\n", []),
    (9, r"NousResearch", "### Instruction:\n{prompt}\n\n### Response:\n", []),
    (10, r"stablecode-instruct", "###Instruction\n{prompt}###Response\n", []),
    (11, r"CodeLlama|Mistral.*Instruct", "<s>[INST] {prompt} [/INST]", []),
    (12, r"phi", "{prompt}\n\nAnswer:", [["Answer", ":"], [198, "Answer", ":"]]),
]
DEFAULT_RULE = (0, "", "{prompt}", [])

# Instruction prompt with and without an input (public
# instruction-tuning format); generation output is split at RESPONSE_MARKER.
RESPONSE_MARKER = "### Response:"
PROMPT_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:"
)
PROMPT_NO_INPUT = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Response:"
)


def glob_to_regex(pattern: str) -> str:
    """fnmatch pattern -> anchored Java/RE2 regex (``*``, ``?``, ``[..]``, ``[!..]``)."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append("\\[")
            else:
                body = pattern[i:j].replace("\\", "\\\\")
                i = j + 1
                if body.startswith("!"):
                    body = "^" + body[1:]
                elif body.startswith("^"):
                    body = "\\" + body
                out.append(f"[{body}]")
        else:
            out.append(re.escape(c) if c not in " " else c)
    return "^(?s:" + "".join(out) + ")$"


def glob_match(col: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.rlike(glob_to_regex(p)) for p in patterns])


def glob_filter(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Distinct names matching any pattern (single pass)."""
    return df.select(col).filter(glob_match(F.col(col), patterns)).distinct()


def glob_union(df: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Union of the per-pattern matches, de-duplicated."""
    parts = [df.select(col).filter(F.col(col).rlike(glob_to_regex(p))) for p in patterns]
    return reduce(lambda a, b: a.union(b), parts).distinct()


def limit_per_group(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """At most ``n`` rows per group (Spark plans a group limit below the window)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def dispatch(name: Column, rules=PROMPT_RULES) -> Column:
    """Rule id of the first pattern found in ``name`` (0 = default).
    The rule list is fixed and short, so it is a CASE chain evaluated per row
    (no join)."""
    expr = None
    for rid, pat, _, _ in rules:
        cond = name.rlike(pat)
        expr = F.when(cond, F.lit(rid)) if expr is None else expr.when(cond, F.lit(rid))
    return expr.otherwise(F.lit(0))


def rule_template(rule_id: Column, rules=PROMPT_RULES) -> Column:
    expr = None
    for rid, _, tpl, _ in rules:
        expr = F.when(rule_id == rid, F.lit(tpl)) if expr is None else expr.when(rule_id == rid, F.lit(tpl))
    return expr.otherwise(F.lit(DEFAULT_RULE[2]))


def stops_text(stops: list[list]) -> str:
    """A rule's stop sequences as JSON, the end token first (``"<eos>"``); numbers are fixed ids."""
    return json.dumps([["<eos>"], *stops], separators=(",", ":"))


def rule_stops(rule_id: Column, rules=PROMPT_RULES) -> Column:
    """Stop sequences of a rule, as JSON."""
    expr = None
    for rid, _, _, stops in rules:
        text = F.lit(stops_text(stops))
        expr = F.when(rule_id == rid, text) if expr is None else expr.when(rule_id == rid, text)
    return expr.otherwise(F.lit(stops_text(DEFAULT_RULE[3])))


def rule_table(spark, rules=PROMPT_RULES) -> DataFrame:
    """The rules as a table (rule_id, pattern, template, stops), default included."""
    return spark.createDataFrame([(rid, pat, tpl, stops_text(stops)) for rid, pat, tpl, stops in [*rules, DEFAULT_RULE]],
                                 "rule_id int, pattern string, template string, stops string")


def format_prompt(template: Column, prompt: Column) -> Column:
    """P5: literal substitution of ``{prompt}`` (never a regex)."""
    return F.replace(template, F.lit("{prompt}"), prompt)


def instruction_prompt(instruction: Column, inp: Column | None = None) -> Column:
    """Instruction prompt with/without input, ending in the response marker."""
    no_in = F.replace(F.lit(PROMPT_NO_INPUT), F.lit("{instruction}"), instruction)
    if inp is None:
        return no_in
    with_in = F.replace(F.replace(F.lit(PROMPT_WITH_INPUT), F.lit("{instruction}"), instruction),
                        F.lit("{input}"), inp)
    return F.when(F.coalesce(F.length(inp), F.lit(0)) > 0, with_in).otherwise(no_in)


def extract_response(text: Column, marker: str = RESPONSE_MARKER, on_missing: str = "error") -> Column:
    """The text between the first and second marker, whitespace-stripped.
    No marker -> error (or NULL with ``on_missing='null'``)."""
    parts = F.split(text, re.escape(marker), -1)
    body = F.get(parts, 1)
    stripped = F.regexp_replace(F.regexp_replace(body, r"^\s+", ""), r"\s+$", "")
    if on_missing == "null":
        return stripped
    return F.when(body.isNotNull(), stripped).otherwise(
        F.raise_error(F.lit(f"no '{marker}' marker in generated text")))
