"""Filters on position columns are settled by the binary readers: other files are never opened."""
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringContains

from tokenloom.sources import binary


def stream(spark, path, rows=60, step=10, part_bytes=100):
    """600 tokens a split in parts of 50; the id is the position."""
    df = spark.range(rows).select("id", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split")).selectExpr(
        "split", f"id * {step} AS start", f"transform(sequence(0, {step - 1}), k -> CAST(id * {step} + k AS INT)) AS ids")
    binary.write_token_stream(df.coalesce(2), path, part_bytes=part_bytes)


def files_planned(path, filters, **options):
    reader = binary.TokenStreamReader({"path": path, "tokens_per_row": "20", **options})
    rest = reader.pushFilters(filters)
    return {s[1].rsplit("/", 2)[1] + "/" + s[1].rsplit("/", 1)[1] for p in reader.partitions() for s in p.segments}, rest


def test_token_stream_plans_only_the_parts_it_needs(spark, tmp_path):
    p = str(tmp_path / "s")
    stream(spark, p)
    everything, _ = files_planned(p, [])
    assert len(everything) == 24
    got, rest = files_planned(p, [EqualTo(("split",), "val"), IsNotNull(("start",)), GreaterThanOrEqual(("start",), 100), LessThan(("start",), 160), StringContains(("split",), "v")])
    assert rest == [StringContains(("split",), "v")]
    assert got == {"val/part-000000000000100.bin", "val/part-000000000000150.bin"}
    assert files_planned(p, [In(("split",), ("nothing",))])[0] == set()
    assert files_planned(p, [GreaterThan(("start",), 10 ** 9)])[0] == set()
    assert len(files_planned(p, [LessThanOrEqual(("start",), 0)])[0]) == 2


@pytest.mark.parametrize("condition", ["split = 'val'", "start >= 120 AND start < 300", "split = 'train' AND start IN (0, 100, 420)", "start > 300", "start <= 41 AND split <> 'val'",
                                       "start = 140", "start = 141", "start > 100 OR split = 'val'", "start < 0", "size(ids) > 5 AND start <= 100"])
def test_filtered_rows_equal_filtering_afterwards(spark, tmp_path, condition):
    p = str(tmp_path / "s")
    stream(spark, p)
    rows = binary.read_token_stream(spark, p, tokens_per_row=20)
    key = lambda r: (r["split"], r["start"], tuple(r["ids"]))
    all_ = spark.createDataFrame(sorted(map(key, rows.collect())), "split string, start bigint, ids array<int>")
    assert sorted(map(key, rows.where(condition).collect())) == sorted(map(key, all_.where(condition).collect()))


def test_other_parts_are_not_opened(spark, tmp_path):
    p = str(tmp_path / "s")
    stream(spark, p)
    for name in os.listdir(f"{p}/train"):
        if name.endswith(".bin") and not 100 <= int(name[5:-4]) < 200:
            os.remove(f"{p}/train/{name}")
    got = binary.read_token_range(spark, p, "train", 113, 187, tokens_per_row=20).orderBy("start").collect()
    assert [x for r in got for x in r["ids"]] == list(range(113, 187)) and got[0]["start"] == 113
    plan = binary.read_token_stream(spark, p, tokens_per_row=20).where("split = 'train' AND start >= 120 AND start < 180")._jdf.queryExecution().executedPlan().toString()
    assert "- Filter " not in plan and ") Filter " not in plan and "BatchScan tokenstream" in plan  # settled by the reader


def test_packed_chunks_by_manifest(spark, tmp_path):
    p = str(tmp_path / "c")
    df = spark.range(40).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b_c' END AS prefix", "id div 2 AS chunk_id", "array(CAST(id AS INT), 7) AS ids")
    binary.write_packed(df, p, 2, "uint16")
    with open(f"{p}/{binary.MANIFEST}") as f:
        manifest = json.load(f)
    assert manifest == {"dtype_code": 8, "chunk_size": 2, "runs": [["a", 0, 19], ["b_c", 0, 19]]}
    # appended chunks join the runs; the manifest's header stays, so a chunk of another dtype raises when it is read
    binary.write_packed(spark.createDataFrame([("a", 20, [1, 2]), ("a", 30, [3, 4])], "prefix string, chunk_id bigint, ids array<int>"), p, 2, "uint16")
    assert binary.packed_summary(p)[1] == [("a", 0, 20), ("a", 30, 30), ("b_c", 0, 19)]
    binary.write_packed(spark.createDataFrame([("z", 0, [1, 2])], "prefix string, chunk_id bigint, ids array<int>"), p, 2, "int32")
    with pytest.raises(Exception, match="disagree"):
        binary.read_packed(spark, p).where("prefix = 'z'").collect()
    # only planned files are opened
    for c in range(5, 20):
        os.remove(f"{p}/{binary.chunk_file('a', c)}")
    rows = binary.read_packed(spark, p).where("prefix = 'a' AND chunk_id < 5 OR prefix = 'x'")
    got = binary.read_packed(spark, p).where((F.col("prefix") == "a") & F.col("chunk_id").between(1, 4)).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == [1, 2, 3, 4] and [list(r["ids"]) for r in got] == [[2 * c, 7] for c in range(1, 5)]
    with pytest.raises(Exception):
        rows.collect()  # a disjunction can't be pushed, so every file is read
    # an overwrite removes what it does not write again; a folder without a manifest is listed
    binary.write_packed(spark.createDataFrame([("b_c", 3, [9, 9])], "prefix string, chunk_id bigint, ids array<int>"), str(tmp_path / "d"), 2, "uint16")
    binary.write_packed(spark.createDataFrame([("b_c", 4, [8, 8])], "prefix string, chunk_id bigint, ids array<int>"), str(tmp_path / "d"), 2, "uint16", mode="overwrite")
    assert sorted(f for f in os.listdir(tmp_path / "d") if f.endswith(".bin") and not f.startswith(".")) == ["b_c_0000000004.bin"]
    os.remove(f"{tmp_path}/d/{binary.MANIFEST}")
    assert [r["chunk_id"] for r in binary.read_packed(spark, str(tmp_path / "d")).collect()] == [4]
