"""Journal tables in a folder that can be changed: parts by trip, and a manifest that names the current ones.

A change reads and rewrites only the parts it touches, into new folders; nothing is written over. The new manifest
gets its name last and in one step, for all tables that the change concerns. A job that fails before leaves the
version as it was, readers keep the one that they opened, and of two changes to one version the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of each table, and the column that holds the trip: of trips themselves, their id.
PARTS, TRIP = 32, "trip"


class Conflict(RuntimeError):
    """Another change was made since the version was opened."""


class Journal:
    """The tables of one version. ``manifest``: table to schema (JSON) and to its parts (number to path)."""

    def __init__(self, spark: SparkSession, root: str, version: int, manifest: dict):
        self.spark, self.root, self.version, self.manifest = spark, root, version, manifest

    # --- opening

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Journal:
        """The newest version in a folder; an empty one, of no tables, where there is none."""
        root = root.rstrip("/")
        fs, path = _fs(spark, root)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        versions = [int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return cls(spark, root, 0, {})
        v = max(versions)
        return cls(spark, root, v, json.loads(spark.read.text(_named(root, v), wholetext=True).first()[0]))

    def tables(self) -> list[str]:
        return sorted(self.manifest)

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or some of its parts."""
        from pyspark.sql.types import StructType

        entry = self.manifest[table]
        schema = StructType.fromJson(json.loads(entry["schema"]))
        paths = [p for k, p in sorted(entry["parts"].items()) if parts is None or int(k) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- changes: each gives the new version

    def create(self, tables: dict[str, DataFrame]) -> Journal:
        """Adds whole tables, or puts them in the place of what they held."""
        new = {name: {"schema": df.schema.json(), "parts": self._write(name, df)} for name, df in tables.items()}
        return self._commit(self.manifest | new)

    def upsert(self, table: str, rows: DataFrame, key: str) -> Journal:
        """Rows by ``key``: new ones, and others in the place of those that have it. A stored row that would move to
        another trip goes from its old part as well. Of several rows of one key the parts decide nothing: they
        must be one (an error otherwise), since which one is meant can't be told."""
        rows = rows.select(*self.read(table).columns)
        if not rows.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"more than one row of a {key}")
        old = self.read(table).withColumn("_part", _part(table)).join(F.broadcast(rows.select(key)) if rows.count() <= 100_000 else rows.select(key), key, "left_semi")
        touched = self._numbers(rows.select(_part(table).alias("_part")).union(old.select("_part")))
        kept = self.read(table, touched).join(rows.select(key), key, "left_anti").select(*rows.columns)
        return self._replace({table: (kept.unionByName(rows), touched)})

    def delete_trips(self, gone: DataFrame) -> Journal:
        """Removes trips (``id``) from all tables, their own and those that bear a ``trip_id``, in one version."""
        ids = gone.select("id").filter("id is not null").distinct()
        touched = self._numbers(ids.select(F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(PARTS)).cast("int").alias("_part")))
        changed = {}
        for name in self.tables():
            c = _trip_column(name)
            left = self.read(name, touched)
            changed[name] = (left.join(ids.select(F.col("id").alias(c)), c, "left_anti").select(*left.columns), touched)
        return self._replace(changed)

    # --- writing

    def _numbers(self, parts: DataFrame) -> list[int]:
        """The parts concerned, ``PARTS`` at most."""
        return sorted(r["_part"] for r in parts.distinct().collect())

    def _write(self, table: str, df: DataFrame) -> dict[str, str]:
        """Writes rows into new folders and gives those of each part. Every task writes its own files of the parts that it
        has rows of: a shuffle to the parts would move each table once more and leave it to ``PARTS`` tasks at most."""
        path = f"{self.root}/{table}-{uuid.uuid4().hex}"
        df.withColumn("_part", _part(table)).write.partitionBy("_part").parquet(path)
        fs, p = _fs(self.spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {n.removeprefix("_part="): f"{path}/{n}" for n in names if n.startswith("_part=")}

    def _replace(self, changed: dict[str, tuple[DataFrame, list[int]]]) -> Journal:
        new = dict(self.manifest)
        for name, (df, touched) in changed.items():
            kept = {k: v for k, v in self.manifest[name]["parts"].items() if int(k) not in touched}
            new[name] = {"schema": self.manifest[name]["schema"], "parts": kept | self._write(name, df)}
        return self._commit(new)

    def _commit(self, manifest: dict) -> Journal:
        """Gives the manifest its name, unless there is one of that version."""
        fs, target = _fs(self.spark, _named(self.root, self.version + 1))
        fs.mkdirs(target.getParent())
        temp = target.getParent().suffix(f"/.{uuid.uuid4().hex}.tmp")
        out = fs.create(temp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(temp, target):
            fs.delete(temp, False)
            raise Conflict(f"version {self.version + 1} exists")
        return Journal(self.spark, self.root, self.version + 1, manifest)

    def vacuum(self) -> int:
        """Removes folders and manifests that this version doesn't need; how many. Nobody may read older versions then."""
        fs, root = _fs(self.spark, self.root)
        needed = {p.removeprefix(f"{self.root}/").split("/")[0] for t in self.manifest.values() for p in t["parts"].values()}
        gone = 0
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name not in needed and name != _named("", self.version).lstrip("/"):
                gone += fs.delete(s.getPath(), True)
        return gone


def _trip_column(table: str) -> str:
    return "id" if table == TRIP else "trip_id"


def _part(table: str) -> Column:
    """The part of a row; rows of no trip share one."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(_trip_column(table)).cast("long")), F.lit(PARTS)), F.lit(0)).cast("int")


def _named(root: str, version: int) -> str:
    return f"{root}/manifest-{version:09d}.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
