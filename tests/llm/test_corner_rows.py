"""All operators on documents alike: clashing column names change nothing, and odd rows pass through."""
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tokenloom.llm import best_fit_packing, decontamination, license_scan, mixing, ngram_jaccard, quality_crf, quality_rules, source_divergence, substring_dedup, token_files, toxicity, warc
from tokenloom.llm.common import documents, table

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, and those of their results.
NAMES = ["id", "n", "key", "size", "piece", "bucket", "score", "label", "words", "h", "count", "value", "part", "rank", "a", "b", "doc", "hash", "hashes", "codes", "start", "length", "token", "kind",
         "predicted", "held_out", "kept", "digest", "row", "item", "item_id", "block", "term", "total", "target", "taken", "crc", "ids", "w", "x", "class", "component_id", "n_words", "quality", "toxic", "payload"]

OPERATORS = {
    "op1": lambda s, d: decontamination.contaminated(d, table(s, SF, "benchmark")),
    "op2": lambda s, d: quality_rules.assess(d).select("doc_id", "n_words", "kept", "log_perplexity"),
    "op3": lambda s, d: license_scan.scan(d).drop("matches"),
    "op4": lambda s, d: best_fit_packing.pack(d).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "op5": lambda s, d: quality_crf.score(d, table(s, SF, "labels")).select("doc_id", "held_out", "score", "predicted"),
    "op6": lambda s, d: token_files.round_trip(d).drop("ids"),
    "op8": lambda s, d: toxicity.score(d.select("doc_id", "text"), table(s, SF, "labels")).select("doc_id", "held_out", "score", "predicted"),
    "op9": lambda s, d: ngram_jaccard.classes_of(d),
    "op10": lambda s, d: substring_dedup.removals(d).select("doc_id", "n_words", "n_removed", "kept_sha256"),
    "op11": lambda s, d: source_divergence.audit(d),
    "op12": lambda s, d: mixing.plan(d),
}
PER_ROW = ("op2", "op3", "op5", "op6", "op8", "op9", "op10", "op12")


def rows(df):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_change_no_value(spark, name):
    docs = documents(spark, SF).where("doc_id % 2 = 0")
    clash = docs.withColumns({c: F.lit(f"clash {i}") for i, c in enumerate(NAMES)})
    assert rows(OPERATORS[name](spark, clash)) == rows(OPERATORS[name](spark, docs))


def odd_documents(spark):
    docs = documents(spark, SF).where("doc_id < 40")
    long = " ".join(f"w{i % 997}" for i in range(60000))
    extra = [(None, "no id here", "en", "s", 10), (None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "xx", None, None), (9003, long, "en", "s", len(long)),
             (9004, "twice the same row", "en", "s", 5), (9004, "twice the same row", "en", "s", 5), (9005, " \n\t ", "", "", 4)]
    return docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(3), 40 + len(extra)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    docs, n = odd_documents(spark)
    got = OPERATORS[name](spark, docs).collect()
    if name in PER_ROW:  # a row for every document, those without an id and the repeated ones too
        assert len(got) == n and sum(r["doc_id"] is None for r in got) == 2 and sum(r["doc_id"] == 9004 for r in got) == 2
    elif name == "op4":
        assert sum(r["piece"] == 0 for r in got) == n
    else:
        assert all(r["doc_id"] in (None, 9001, 9002, 9003, 9004, 9005) or r["doc_id"] < 40 for r in got) if name == "op1" else got


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, documents(spark, SF).limit(0)).collect() == []


def test_word_counts_of_odd_rows(spark):
    docs, _ = odd_documents(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((len(brute.SPACED.findall(t or "")) for _, t in texts))
    for name in ("op2", "op10"):
        assert sorted(r["n_words"] for r in OPERATORS[name](spark, docs).collect()) == want


def test_pages_with_clashing_columns(spark):
    pages = table(spark, SF, "pages")
    clash = pages.withColumns({c: F.lit(f"clash {i}") for i, c in enumerate(NAMES)})
    pick = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(warc.archive(clash).select(*pick)) == rows(warc.archive(pages).select(*pick))
