"""Problem 7 and the incremental index: only what is new or changed since the last successful run.

The listing of the current state is anti-joined with the manifest of what successful runs recorded;
what a run writes is addressed by its batch identifier, so a repeated attempt overwrites its own
partial output; the manifest is committed last, by one rename.  A run that breaks off before the
rename leaves no trace in the manifest and its records come out again; one that breaks off after it
has written everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import table


def current_state(listing: DataFrame, key: str, state: list[str], seen: str = "seen_at") -> DataFrame:
    """One row per key: the state of its latest sighting.

    Pre-aggregated before the shuffle, so a key with many sightings costs one row per input partition.
    Sightings of one time with different states (a tie) give the greatest state, nulls lowest.  Rows
    without a key are no records; a null sighting time is earlier than any other."""
    latest = F.max(F.struct(seen, *(F.struct(F.col(c).isNotNull().alias("set"), F.col(c).alias("v")).alias(c) for c in state))).alias("__latest")
    return listing.where(F.col(key).isNotNull()).groupBy(key).agg(latest).select(key, *(F.col(f"__latest.{c}.v").alias(c) for c in state))


def recorded_state(manifest: DataFrame, runs: DataFrame, key: str, state: list[str]) -> DataFrame:
    """One row per key: what the latest successful run recorded.

    The semi join keeps entries of successful runs only; entries without a run are of none."""
    good = runs.where(F.col("status") == "success").select("run_id").distinct()
    kept = manifest.where(F.col(key).isNotNull()).join(good, "run_id", "left_semi")
    return current_state(kept, key, state, seen="run_id")


def changed(current: DataFrame, recorded: DataFrame, key: str, state: list[str]) -> DataFrame:
    """The rows of ``current`` without a recorded state, or with another; null equals only null."""
    there = recorded.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in state))
    same = F.col(key) == F.col("__key")
    for c in state:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return current.join(there, same, "left_anti")


def stale(current: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Keys that a successful run recorded and that are gone."""
    return recorded.select(key).join(current.select(key), key, "left_anti")


FILE_STATE, NOTE_STATE = ["mtime", "size"], ["version"]


def to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner_kind, owner_key) of the files and notes that must be processed."""
    runs = table(spark, sf_dir, "index_runs")
    out = []
    for kind, listing, manifest, key, state in (("file", "file_listing", "manifest_files", "attachmentKey", FILE_STATE), ("note", "notes", "manifest_notes", "noteKey", NOTE_STATE)):
        now = current_state(table(spark, sf_dir, listing), key, state)
        then = recorded_state(table(spark, sf_dir, manifest), runs, key, state)
        out.append(changed(now, then, key, state).select(F.lit(kind).alias("owner_kind"), F.col(key).alias("owner_key")))
    return out[0].unionByName(out[1])


class Ledger:
    """Manifest and outputs of an incremental job in one shared folder.

    ``data/batch=ID`` holds what a batch wrote, ``manifest/batch=ID`` its committed entries: input key, state
    and a checksum over ``content`` columns of the listing (the state alone, where none are named).  The file system must rename
    folders in one step, as HDFS and local disks do."""

    def __init__(self, spark: SparkSession, folder: str, key: str, state: list[str], content: list[str] | None = None) -> None:
        self.spark, self.folder, self.key, self.state = spark, folder.rstrip("/"), key, state
        self.content = [key, *(content or state)]
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.folder}/manifest/batch={batch}")

    def manifest(self, like: DataFrame) -> DataFrame:
        """Committed entries of all batches; empty with the columns of ``like`` before the first.

        A batch shadows earlier ones: identifiers are numbers, or of one length."""
        columns = [self.key, *self.state]
        if not self._exists(f"{self.folder}/manifest"):
            return like.select(*columns).limit(0)
        seen = self.spark.read.option("basePath", f"{self.folder}/manifest").parquet(f"{self.folder}/manifest/batch=*")
        order = F.struct(F.length(F.col("batch").cast("string")).alias("digits"), F.col("batch").cast("string").alias("batch"))
        return current_state(seen.withColumn("batch", order), self.key, self.state, seen="batch")

    def pending(self, listing: DataFrame) -> DataFrame:
        """Rows of the listing (one per key) that no committed batch recorded in this state."""
        return changed(listing, self.manifest(listing), self.key, self.state)

    def run(self, listing: DataFrame, process, batch: str) -> bool:
        """Writes ``process(pending rows)`` under the batch and then commits; False if the batch was committed before.

        The pending rows are written first, so output and manifest come from the same rows even if
        the listing changes meanwhile or an executor is lost."""
        if self.committed(batch):
            return False
        staged = f"{self.folder}/staging/batch={batch}"
        self.pending(listing).write.mode("overwrite").parquet(staged)
        rows = self.spark.read.parquet(staged)
        process(rows).write.mode("overwrite").parquet(f"{self.folder}/data/batch={batch}")
        entries = f"{self.folder}/staging/manifest-{batch}"
        rows.select(self.key, *self.state, F.xxhash64(*self.content).alias("checksum")).write.mode("overwrite").parquet(entries)
        self._fs.mkdirs(self._path(f"{self.folder}/manifest"))
        if not self._fs.rename(self._path(entries), self._path(f"{self.folder}/manifest/batch={batch}")):
            raise RuntimeError(f"batch {batch} could not be committed")
        self._fs.delete(self._path(staged), True)
        return True

    def output(self) -> DataFrame:
        """What committed batches wrote: data without a manifest entry is of a run that broke off."""
        batches = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifest"))]
        return self.spark.read.option("basePath", f"{self.folder}/data").parquet(*(f"{self.folder}/data/{b}" for b in sorted(batches)))
