"""A persistent cache of computed answers, as an append-only versioned table.

Layout: ``data/{name}`` are Parquet folders that are written once; ``versions/{n}.json`` names
the folders of version n.  A version file is created only if it does not exist yet, which
is what commits it, so of two writers one comes first and the other starts over
from what is there by then.  Readers hold on to one version.  A job that dies before its commit
leaves a folder that no version names; ``vacuum`` removes such folders and old versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = "cache_version"  # the version that stored an answer


class AnswerCache:
    """Answers by key.  ``schema`` lists the answer columns (SQL types), ``key`` is ``key_type``."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, key_type: str = "bigint"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = f"{key} {key_type}, {schema}, {KEPT} bigint"
        self.columns = spark.createDataFrame([], self.schema).columns
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ versions --

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if not s.getPath().getName().startswith((".", "_")))

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        names = self._names("versions")
        return int(names[-1].split(".")[0]) if names else 0

    def folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        with_text = self.spark.read.text(f"{self.root}/versions/{version:012d}.json", wholetext=True)
        return json.loads(with_text.first()[0])

    def _commit(self, version: int, folders: list[str]) -> bool:
        """Create the version's file; False if another writer was first."""
        try:
            out = self._fs.create(self._path(f"versions/{version:012d}.json"), False)
        except Exception as e:  # noqa: BLE001 - the file system says that the file is there
            if "already exists" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        return True

    def answers(self, version: int | None = None) -> DataFrame:
        """(key, answers, cache_version) of a version, the last one unless given."""
        names = self.folders(self.version() if version is None else version)
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{n}" for n in names])

    # -------------------------------------------------------------- lookups --

    def lookup(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The requests with their answers and ``from_cache``.

        Every key that the cache lacks is computed once, whatever the number of requests for it (the
        first request in the order of its other columns stands for the key), stored, and read back from
        there; nothing is computed or stored when all keys are known.  ``compute`` takes requests and
        returns (key, answers).  Requests without a key are computed each time and not stored.
        """
        known = self.version()
        keyed = requests.where(F.col(self.key).isNotNull())
        rest = [c for c in requests.columns if c != self.key]
        missing = keyed.join(self.answers(known).select(self.key), self.key, "left_anti")
        if rest:
            missing = missing.groupBy(self.key).agg(F.min(F.struct(*rest)).alias("_first")).select(self.key, "_first.*").select(*requests.columns)
        else:
            missing = missing.distinct()
        version = self._store(compute(missing), known)
        stored = self.answers(version).withColumnRenamed(self.key, "_key")
        found = keyed.join(stored, keyed[self.key] == stored["_key"]).drop("_key").withColumn("from_cache", F.col(KEPT) <= known).drop(KEPT)
        bare = requests.where(F.col(self.key).isNull())
        if not bare.take(1):
            return found
        # no key to join by: the answers come with the requests' own rows
        own = compute(bare).withColumn("from_cache", F.lit(False))
        return found.unionByName(own, allowMissingColumns=True)

    def _store(self, computed: DataFrame, known: int) -> int:
        """Write answers and commit them as the next version; the version that holds them."""
        name = uuid.uuid4().hex
        answers = [c for c in self.columns if c not in (self.key, KEPT)]
        version = known + 1
        while True:
            rows = computed.select(self.key, *answers).withColumn(KEPT, F.lit(version).cast("bigint"))
            rows.write.parquet(f"{self.root}/data/{name}")
            if not self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{name}").take(1):
                self._fs.delete(self._path(f"data/{name}"), True)
                return version - 1
            if self._commit(version, [*self.folders(version - 1), name]):
                return version
            # another writer was first: what it stored is not stored again
            staged = self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{name}").drop(KEPT)
            last = self.version()
            computed = staged.join(self.answers(last).select(self.key), self.key, "left_anti")
            name, version = uuid.uuid4().hex, last + 1

    # ------------------------------------------------------------ upkeep --

    def compact(self, files: int | None = None) -> int:
        """Rewrite the last version as one folder in key order (narrow ranges of keys per file), the oldest
        answer of a key; the new version."""
        version = self.version()
        if len(self.folders(version)) < 2:
            return version
        rest = [c for c in self.columns if c != self.key]
        order = [KEPT, *[c for c in rest if c != KEPT]]
        rows = self.answers(version).groupBy(self.key).agg(F.min(F.struct(*order)).alias("_a")).select(self.key, *[F.col(f"_a.{c}").alias(c) for c in rest])
        rows = rows.repartitionByRange(files, self.key) if files else rows.repartitionByRange(self.key)
        name = uuid.uuid4().hex
        rows.sortWithinPartitions(self.key).write.parquet(f"{self.root}/data/{name}")
        if self._commit(version + 1, [name]):
            return version + 1
        self._fs.delete(self._path(f"data/{name}"), True)  # answers came in meanwhile: they stay as they are
        return self.version()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the last ``keep`` versions and every folder that the kept ones do not name; run
        it when no other job writes or reads older versions."""
        names = self._names("versions")
        old, kept = (names[:-keep], names[-keep:])
        live = {f for v in kept for f in self.folders(int(v.split(".")[0]))}
        gone = [f for f in self._names("data") if f not in live]
        for v in old:
            self._fs.delete(self._path(f"versions/{v}"), False)
        for f in gone:
            self._fs.delete(self._path(f"data/{f}"), True)
        return gone
