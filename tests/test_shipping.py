"""The entry point runs from another folder without PYTHONPATH: the package reaches the workers."""

import os
import subprocess
import sys

CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_module", sys.argv[1])
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("ROWS", m.entry(spark).count(), m.queries()["s6_packed_source"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_without_pythonpath(tmp_path):
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE, entry], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    rows = [line for line in out.stdout.splitlines() if line.startswith("ROWS")]
    assert rows and all(int(n) > 0 for n in rows[0].split()[1:]), out.stderr[-2000:]


def test_shared_folder_is_required_off_local(spark):
    import pytest

    from tokenloom.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
