"""Tables in hash buckets under a manifest: an upsert or a delete rewrites the buckets of its keys and no others.

root/manifest/v=N is a small table (bucket, folder) that names the live folder of each bucket; folders under root/data are
never changed. A change reads the live folders of the buckets that it touches, writes theirs anew and then one new manifest,
which readers see as a whole or not at all. A manifest of a number is written once, so of two writers at once the second
fails and has to begin again. Superseded folders stay for readers under way until vacuum().

The driver holds a row for each bucket. Null keys are one bucket's; they match nothing and are added as new rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sync import latest


@dataclass(frozen=True)
class BucketTable:
    spark: SparkSession
    root: str
    schema: StructType
    key: tuple[str, ...]
    buckets: int = 256

    def _store(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, store = self._store(folder)
        return [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []

    def version(self) -> int:
        """Number of the newest whole manifest, 0 before the first change."""
        numbers = [int(n.split("=")[1]) for n in self._names(f"{self.root}/manifest") if n.startswith("v=")]
        whole = [n for n in numbers if "_SUCCESS" in self._names(f"{self.root}/manifest/v={n}")]
        return max(whole, default=0)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """bucket -> its live folder, as of a version."""
        at = self.version() if version is None else version
        return {r.bucket: r.folder for r in self.spark.read.schema("bucket int, folder string").parquet(f"{self.root}/manifest/v={at}").collect()} if at else {}

    def read(self, version: int | None = None) -> DataFrame:
        live = sorted(self.manifest(version).values())
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in live]) if live else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _change(self, keyed: DataFrame, new_rows: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrite the buckets of keyed's rows; new_rows makes their new rows of the old ones. Returns their numbers."""
        before = self.version()
        live = self.manifest(before)
        touched = sorted(r._bucket for r in keyed.select(self._bucket().alias("_bucket")).distinct().collect())
        if not touched:
            return []
        old = [f"{self.root}/{live[b]}" for b in touched if b in live]
        rows = self.spark.read.schema(self.schema).parquet(*old) if old else self.spark.createDataFrame([], self.schema)
        data = f"data/{uuid.uuid4().hex}"
        new_rows(rows).withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{data}")
        written = {int(n.split("=")[1]): f"{data}/{n}" for n in self._names(f"{self.root}/{data}") if n.startswith("_bucket=")}
        after = {b: f for b, f in live.items() if b not in touched} | written
        self.spark.createDataFrame(sorted(after.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{self.root}/manifest/v={before + 1}")
        return touched

    def upsert(self, updates: DataFrame, sequence: list[Column]) -> list[int]:
        """Insert new rows and replace whole rows of known keys; of several updates of a key the last by sequence counts."""
        known = updates.where(" and ".join(f"`{k}` is not null" for k in self.key))
        last = latest(known, list(self.key), sequence).select(self.schema.names)
        unkeyed = updates.where(" or ".join(f"`{k}` is null" for k in self.key)).select(self.schema.names)
        return self._change(updates, lambda old: old.join(last, list(self.key), "left_anti").select(self.schema.names).unionByName(last).unionByName(unkeyed))

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows of keys go."""
        named = keys.select(*self.key).distinct()
        return self._change(named, lambda old: old.join(named, list(self.key), "left_anti").select(self.schema.names))

    def vacuum(self) -> list[str]:
        """Delete folders that the newest manifest does not name, and older manifests. For times when nobody else reads or writes."""
        at = self.version()
        live = set(self.manifest(at).values())
        gone = [f"data/{run}/{name}" for run in self._names(f"{self.root}/data") for name in self._names(f"{self.root}/data/{run}") if name.startswith("_bucket=") and f"data/{run}/{name}" not in live]
        gone += [f"manifest/{n}" for n in self._names(f"{self.root}/manifest") if n.startswith("v=") and int(n.split("=")[1]) < at]
        for folder in gone:
            path, store = self._store(f"{self.root}/{folder}")
            store.delete(path, True)
        return gone
