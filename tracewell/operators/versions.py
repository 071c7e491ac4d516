"""Tables that change together and as a whole: data is written aside, and one small manifest makes it live.

A store is a folder. Rows lie below ``data/``, in files that are never changed; ``versions/<n>.json`` names the folders of
version n of each table, by bucket of the table's key. A change writes new folders, and then a manifest that
takes the next number, which only one writer can: a reader sees all of a change or nothing, a run that
breaks off leaves the version before, and of two writers from one version the second fails. A change
rewrites only the buckets of the keys it touches.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has taken the version that this one was to write."""


class Store:
    """One version of the tables below ``root``, the newest unless ``version`` names another, and changes to come."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 16, version: int | None = None) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        numbers = self.versions()
        self.version = version if version is not None else max(numbers, default=0)
        self.manifest = self._load(self.version) if self.version else {"tables": {}}
        self._changes: dict[str, dict] = {}

    def _path(self, name: str):
        return self._jvm.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"versions/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def __contains__(self, table: str) -> bool:
        return table in self.manifest["tables"]

    def _rows(self, schema: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of this version, or some of its buckets."""
        t = self.manifest["tables"][table]
        wanted = t["parts"] if buckets is None else {b: t["parts"].get(str(b), []) for b in buckets}
        return self._rows(t["schema"], [f for b in sorted(wanted, key=int) for f in wanted[b]])

    def pending(self, table: str) -> dict | None:
        """A table's entry as it will be after the changes so far, None where there is none."""
        return self._changes.get(table) or self.manifest["tables"].get(table)

    def read_pending(self, table: str) -> DataFrame:
        """A table as it will be after the changes so far."""
        t = self.pending(table)
        return self._rows(t["schema"], [f for b in sorted(t["parts"], key=int) for f in t["parts"][b]])

    def bucket(self, key: str | Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets or self.buckets)).cast("int")

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written below the store, in no version: what a change works with several times."""
        path = f"{self.root}/data/staged-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _written(self, df: DataFrame, table: str, bucket: Column, sort_by: tuple[str, ...] = ()) -> dict[str, list[str]]:
        folder = f"data/{table}-{uuid.uuid4().hex}"
        # Rebalancing gathers small buckets and splits large ones, so that files have a good size whatever the skew.
        dealt = df.withColumn("__bucket", bucket).hint("rebalance", F.col("__bucket")).sortWithinPartitions("__bucket", *sort_by)
        dealt.write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("__bucket=")}

    def _table(self, table: str, df: DataFrame, key: str) -> dict:
        old = self.pending(table)
        # A table that is new to the store, or empty so far, takes the columns of what comes.
        return old if old is not None else {"key": key, "buckets": self.buckets, "schema": df.schema.jsonValue(), "parts": {}}

    def replace(self, table: str, df: DataFrame, key: str, sort_by: tuple[str, ...] = ()) -> None:
        """The whole table will be ``df``; files are sorted by bucket and ``sort_by``."""
        self._changes[table] = {"key": key, "buckets": self.buckets, "schema": df.schema.jsonValue(), "parts": self._written(df, table, self.bucket(key), sort_by)}

    def append(self, table: str, df: DataFrame, key: str, sort_by: tuple[str, ...] = ()) -> None:
        """The rows of ``df`` will be there beside those before."""
        t = self._table(table, df, key)
        new = self._written(df.select(*StructType.fromJson(t["schema"]).fieldNames()), table, self.bucket(key, t["buckets"]), sort_by)
        self._changes[table] = {**t, "parts": {b: t["parts"].get(b, []) + new.get(b, []) for b in {*t["parts"], *new}}}

    def rewrite(self, table: str, df: DataFrame, touched: DataFrame, key: str) -> None:
        """The rows of the ``touched`` keys will be those of ``df``; only buckets of such keys are read and written.

        ``df`` holds no other keys. A null key is touched by a null.
        """
        t = self._table(table, df, key)
        b = self.bucket(key, t["buckets"])
        # As many rows as there are buckets, at most.
        hit = {str(r.b) for r in touched.select(b.alias("b")).distinct().collect()}
        old = self._rows(t["schema"], [f for n in hit for f in t["parts"].get(n, [])])
        gone = touched.select(F.col(key).alias("__gone")).distinct()
        kept = old.join(gone, old[key].eqNullSafe(F.col("__gone")), "left_anti")
        new = self._written(kept.unionByName(df.select(*kept.columns)), table, b)
        self._changes[table] = {**t, "parts": {**{n: f for n, f in t["parts"].items() if n not in hit}, **new}}

    def commit(self, **notes) -> int:
        """Makes all changes live at once, with ``notes`` in the manifest; fails where another writer came first."""
        number = self.version + 1
        manifest = {"tables": {**self.manifest["tables"], **self._changes}, "notes": {**self.manifest.get("notes", {}), **notes}}
        aside = self._path(f"versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        gateway, options = self.spark.sparkContext._gateway, getattr(self._jvm, "Options$Rename")
        context = self._jvm.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path(f"versions/{number}.json"), gateway.new_array(options, 0))
        except Exception as e:
            self._fs.delete(aside, False)
            if number in self.versions():
                raise Conflict(f"version {number} is there already") from e
            raise
        self.version, self.manifest, self._changes = number, manifest, {}
        return number

    def notes(self) -> dict:
        return self.manifest.get("notes", {})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the folders that none of the last ``keep`` versions names, and the manifests before them.

        To be run while nothing else writes: folders of a change under way belong to no version yet.
        """
        numbers = self.versions()
        live = reduce(set.union, ({f.split("/")[1] for t in self._load(n)["tables"].values() for fs in t["parts"].values() for f in fs} for n in numbers[-keep:]), set())
        dead = [n for n in self._names("data") if n not in live]
        for n in dead:
            self._fs.delete(self._path(f"data/{n}"), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"versions/{n}.json"), False)
        return dead
