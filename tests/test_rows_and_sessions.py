"""Row numbers of files without ids, and sessions without a configured folder."""
import gzip
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tokenloom.sources.tables import read_corpus

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def lines(path, rows, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    with (gzip.open(path, "wt") if zipped else open(path, "w")) as f:
        f.writelines((json.dumps(r) if r is not None else "") + "\n" for r in rows)


@pytest.mark.parametrize("split", ["134217728", "300"])
def test_json_lines_without_ids_are_numbered_in_file_order(spark, tmp_path, split):
    texts = [f"text {i}" if i % 7 else "the same" for i in range(90)]
    rows = [{"text": t, "url": f"u{i}"} for i, t in enumerate(texts)]
    lines(tmp_path / "c" / "b.json", rows[40:70])
    lines(tmp_path / "c" / "a.json", rows[:40])
    lines(tmp_path / "c" / "c.json.gz", rows[70:], zipped=True)
    (tmp_path / "c" / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = read_corpus(spark, str(tmp_path / "c"), "json", min_partitions=3)
        got = {r["doc_id"]: r["text"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(texts))


def test_ids_of_the_file_are_kept(spark, tmp_path):
    lines(tmp_path / "d.json", [None, {"doc_id": 7, "text": "x"}, {"doc_id": 3, "text": None}])
    assert sorted((r["doc_id"], r["text"]) for r in read_corpus(spark, str(tmp_path / "d.json"), "json").collect()) == [(3, None), (7, "x")]


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_other_formats_are_numbered_too(spark, tmp_path, fmt):
    p = str(tmp_path / fmt)
    df = spark.range(50).select(F.concat(F.lit("line "), (F.col("id") % 5).cast("string")).alias("text"), "id").repartitionByRange(4, "id").sortWithinPartitions("id").select("text")
    getattr(df.write, fmt)(p)
    got = {r["doc_id"]: r["text"] for r in read_corpus(spark, p, fmt, id_col="doc_id").collect()}
    assert got == {i: f"line {i % 5}" for i in range(50)}
    empty = str(tmp_path / "none")
    getattr(df.limit(0).write, fmt)(empty)
    assert read_corpus(spark, empty, fmt).count() == 0


def test_session_without_a_configured_folder(tmp_path):
    """A local session of an empty configuration makes its own folder."""
    code = ("from tokenloom.session import build_session, ensure_checkpoint_dir\n"
            "s = build_session('local[1]', 2)\n"
            "d = ensure_checkpoint_dir(s)\n"
            "assert d and d == s.conf.get('spark.checkpoint.dir')\n"
            "print('rows', s.range(3).count())\n"
            "s.stop()\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert ensure_checkpoint_dir(s) == ensure_checkpoint_dir(s)\n"
            "print('other', s.range(4).count())\n")
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240, cwd=tmp_path)
    assert "rows 3" in out.stdout and "other 4" in out.stdout, out.stderr[-2000:]
