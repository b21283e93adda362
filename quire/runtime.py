"""What every operator needs from the session: tables, shipped code, checkpoints."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _archive() -> str:
    """The package as a zip on the driver; Spark's file server hands it to every executor, late ones included."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    path = os.path.join(tempfile.mkdtemp(prefix="shipped"), f"{PACKAGE.name}.zip")
    Path(path).write_bytes(data.getvalue())
    return path


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of any executor, once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_quire_shipped", False):
        sc.addPyFile(_archive())
        sc._quire_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master, where none is set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: no lineage, and no loss with an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
