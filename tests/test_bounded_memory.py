"""What a Python worker holds at a time follows batches, not the input."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.operators.tokenize import ByteTokenizer
from tokenloom.session import BATCH_BYTES, BATCH_ROWS, bounded_batches

KEYS = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]


@pytest.fixture
def fresh(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    for k in KEYS:
        spark.conf.unset(k)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_byte_tokens_come_in_bounded_batches(fresh):
    @F.arrow_udf(T.LongType())
    def held(s: pa.Array) -> pa.Array:
        return pa.array([len(s)] * len(s))

    ids = ByteTokenizer().encode(F.col("text"), eos=True)
    d = fresh.range(0, 5000, 1, 1).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    assert d.select(held("text").alias("n"), F.size(ids).alias("l")).agg(F.max("n")).first()[0] <= BATCH_ROWS
    long = d.limit(40).select(F.repeat("text", 200000).alias("text"))
    assert long.select(held("text").alias("n")).agg(F.max(F.col("n") * F.octet_length(F.repeat(F.lit("é1"), 200000)))).first()[0] <= 2 * BATCH_BYTES


def test_smaller_settings_stay(fresh):
    fresh.conf.set(KEYS[0], "7")
    fresh.conf.set(KEYS[1], "64k")
    bounded_batches(fresh)
    assert [fresh.conf.get(k) for k in KEYS] == ["7", "64k"]
    fresh.conf.set(KEYS[0], "0")  # no limit
    bounded_batches(fresh)
    assert int(fresh.conf.get(KEYS[0])) == BATCH_ROWS


class _State:
    """One state variable of a processor, kept in a list."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows

    def put(self, rows):
        self.rows = list(rows)

    appendList = lambda self, rows: self.rows.extend(rows)
    clear = lambda self: self.rows.clear()


class _Value(_State):
    def update(self, row):
        self.rows = row


def test_a_lane_packs_with_little_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tokenloom.streaming.jobs import Packer
    p = Packer(512, 0)
    p.at, p.tail = _Value(), _State()

    def rows():  # 800 documents of 20,000 tokens, the newest first: 64 MB
        for i in reversed(range(100)):
            yield pd.DataFrame({"doc_id": range(8 * i, 8 * i + 8), "ids": [np.full(20000, 8 * i + k, np.int32) for k in range(8)]})

    tracemalloc.start()
    n, seen = 0, []
    for pdf in p.handleInputRows(("a", 0), rows(), None):
        n += int(pdf["n_tokens"].sum())
        seen += [int(x[0]) for x in pdf["ids"] if len(x)]  # the last tail is empty
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 800 * 20000 and seen == sorted(seen)
    assert peak < 24 << 20
