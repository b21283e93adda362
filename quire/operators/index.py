"""The chunk collection: versions, replacement by owner, deletion, counters.

Parquet has no merge, so a write makes new files beside the old ones and then moves a pointer; readers
of the old version are not disturbed, and a job that fails leaves the pointer where it was."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.incremental import changed, stale
from quire.schemas import CHUNKS


def replace_owners(existing: DataFrame, fresh: DataFrame, gone: DataFrame | None = None, key: str = "owner_key") -> DataFrame:
    """``existing`` without the chunks of owners that ``fresh`` holds or ``gone`` lists, and ``fresh``.

    All chunks of a changed owner go, not only those with equal ids.  An owner whose extraction gave
    nothing is not in ``fresh`` and keeps its chunks."""
    out = fresh.select(key) if gone is None else fresh.select(key).unionByName(gone.select(key))
    return existing.join(out.distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert(existing: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``fresh`` in place of those with equal ids."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def plan(listing: DataFrame, manifest: DataFrame, key: str, state: list[str]) -> DataFrame:
    """(key, action) with ``update``, ``skip`` or ``delete`` of every key listed or recorded."""
    todo = changed(listing, manifest, key, state).select(key, F.lit("update").alias("action"))
    same = listing.select(key).join(todo, key, "left_anti").select(key, F.lit("skip").alias("action"))
    return todo.unionByName(same).unionByName(stale(listing, manifest, key).select(key, F.lit("delete").alias("action")))


def counters(plans: dict[str, DataFrame]) -> DataFrame:
    """(source_type, action, n) over plans by source type."""
    parts = [p.groupBy("action").agg(F.count("*").alias("n")).select(F.lit(kind).alias("source_type"), "action", "n") for kind, p in plans.items()]
    return reduce(DataFrame.unionByName, parts)


#: Buckets by owner in which a collection lies; a change rewrites those of the owners it touches.
BUCKETS = 256


class Collection:
    """A named collection of chunks with vectors of one dimension, and the manifests that go with it.

    Chunks lie in buckets by the hash of their owner.  A version is a pointer file that names the folder of
    each bucket, the schema, and the folders of the manifests, so chunks and manifests are committed by one
    rename; the file system must rename files in one step, as HDFS and local disks do."""

    def __init__(self, spark: SparkSession, folder: str, name: str, dim: int, buckets: int = BUCKETS) -> None:
        self.spark, self.dim, self.buckets = spark, dim, buckets
        self.path = f"{folder.rstrip('/')}/{name}_{dim}"
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- pointers

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, text: str, *, replace: bool) -> None:
        """Written aside and renamed; without ``replace`` a file that is there already is an error."""
        part = f"{path}.part"
        self._fs.mkdirs(self._path(path).getParent())
        out = self._fs.create(self._path(part), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE if replace else fs.Options.Rename.NONE
        fs.FileContext.getFileContext(self._path(path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._path(part), self._path(path), options)

    def _versions(self) -> list[int]:
        at = self._path(f"{self.path}/_current")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _pointer(self, version: int | None = None) -> dict:
        versions = self._versions()
        if version is None and not versions:
            return {"schema": None, "buckets": {}, "manifests": {}}
        return json.loads(self._read_text(f"{self.path}/_current/{versions[-1] if version is None else version}"))

    def exists(self) -> bool:
        return bool(self._versions())

    # --- rows

    def _bucket(self, key: str | Column = "owner_key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, keys: DataFrame, key: str | Column = "owner_key") -> list[int]:
        """At most as many rows as there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(key).alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The current version, or some of its buckets; empty where there is none; a vector of another dimension raises ValueError."""
        now = self._pointer()
        schema = StructType.fromJson(now["schema"]) if now["schema"] else StructType.fromDDL(CHUNKS)
        folders = [path for b, path in sorted(now["buckets"].items()) if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))
        sample = out.where("embedding IS NOT NULL").select(F.size("embedding")).limit(1).collect() if "embedding" in out.columns else []
        if sample and sample[0][0] != self.dim:
            raise ValueError(f"collection {self.path} has vectors of {sample[0][0]}, not {self.dim} dimensions")
        return out

    def write(self, chunks: DataFrame, keep: int = 2, *, touched: list[int] | None = None, manifests: dict[str, DataFrame] | None = None) -> int:
        """A new version: ``chunks`` in place of the buckets ``touched``, all by default, and manifests in place of those of
        their kinds; folders that none of the ``keep`` last versions names go.

        The rebalance before the write splits buckets that hold too much and joins tasks that hold little."""
        before = self._pointer()
        version = max(self._versions(), default=0) + 1
        target = f"data/v{version}"
        bucketed = chunks.withColumn("__bucket", self._bucket() if "owner_key" in chunks.columns else F.lit(0))
        bucketed.hint("rebalance", "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{target}")
        fresh = {n.partition("=")[2]: f"{target}/{n}" for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{target}"))) if n.startswith("__bucket=")}
        kept = {} if touched is None else {b: f for b, f in before["buckets"].items() if int(b) not in touched}
        stored = dict(before["manifests"])
        for kind, rows in (manifests or {}).items():
            stored[kind] = {"folder": f"manifests/{kind}/v{version}", "schema": rows.schema.jsonValue()}
            rows.write.mode("overwrite").parquet(f"{self.path}/{stored[kind]['folder']}")
        pointer = {"schema": chunks.schema.jsonValue(), "buckets": kept | fresh, "manifests": stored}
        self._write_text(f"{self.path}/_current/{version}", json.dumps(pointer), replace=False)
        self._forget(keep)
        return version

    def _forget(self, keep: int) -> None:
        folders = lambda p: set(p["buckets"].values()) | {m["folder"] for m in p["manifests"].values()}
        versions = self._versions()
        named = set().union(*(folders(self._pointer(v)) for v in versions[-keep:]))
        for old in versions[:-keep]:
            unnamed = folders(self._pointer(old)) - named
            self._fs.delete(self._path(f"{self.path}/_current/{old}"), False)
            for folder in unnamed:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def replace(self, fresh: DataFrame, gone: DataFrame | None = None, key: str = "owner_key", *, manifests: dict[str, DataFrame] | None = None) -> int:
        """The chunks of ``fresh`` in place of those of their owners, those of ``gone`` dropped: only buckets of such owners are
        read and written.  ``fresh`` is read twice."""
        owners = fresh.select(key) if gone is None else fresh.select(key).unionByName(gone.select(key))
        touched = self._buckets_of(owners, key)
        return self.write(replace_owners(self.read(touched), fresh, gone, key), touched=touched, manifests=manifests)

    def delete(self, keys: DataFrame, key: str = "owner_key") -> int:
        touched = self._buckets_of(keys, key) if key == "owner_key" else None
        return self.write(self.read(touched).join(keys.select(key).distinct(), key, "left_anti"), touched=touched)

    def near(self, ids: DataFrame) -> DataFrame:
        """The rows in the buckets of the owners of chunk ids, which begin with their owners' keys."""
        return self.read(self._buckets_of(ids, F.substring_index("chunk_id", ":", 1)))

    def get(self, ids: DataFrame, columns: list[str]) -> DataFrame:
        """Rows by id: a semi-join within the buckets of their owners."""
        return self.near(ids).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", *columns)

    # --- manifests and settings

    def manifest(self, kind: str, schema: str) -> DataFrame:
        """What the current version records of its inputs; empty with ``schema`` where there is nothing."""
        entry = self._pointer()["manifests"].get(kind)
        if entry is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.path}/{entry['folder']}")

    def save_config(self, config: dict) -> None:
        """What embedded the collection, as JSON beside it: written aside and renamed over the old one."""
        self._write_text(f"{self.path}/_config.json", json.dumps(config), replace=True)

    def load_config(self) -> dict | None:
        at = f"{self.path}/_config.json"
        return json.loads(self._read_text(at)) if self._fs.exists(self._path(at)) else None

    def rebuild(self) -> None:
        """Nothing is left, manifests included, so the next run indexes everything."""
        self._fs.delete(self._path(self.path), True)
