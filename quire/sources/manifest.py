"""Import of a JSON manifest (``files``, ``notes``) into the two manifest tables.

For moving to the tables once; the tables themselves are Parquet and never pass through the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from quire.schemas import MANIFEST_FILES, MANIFEST_NOTES


def read_json(path: str) -> dict:
    """The manifest; an empty one where the file is missing, blank or no object; a corrupt file is set aside as ``.json.bak``."""
    empty = {"files": {}, "notes": {}}
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        return empty
    if not text.strip():
        return empty
    try:
        value = json.loads(text)
    except ValueError:
        os.replace(path, f"{path.removesuffix('.json')}.json.bak")
        return empty
    return empty | {k: v for k, v in value.items() if isinstance(v, dict)} if isinstance(value, dict) else empty


def import_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest_files, manifest_notes); entries that are no objects have null states."""
    m = read_json(path)
    of = lambda e, k: e.get(k) if isinstance(e, dict) else None
    files = [(k, None if of(e, "mtime") is None else float(of(e, "mtime")), of(e, "size"), of(e, "pdf_path")) for k, e in m["files"].items()]
    notes = [(k, of(e, "version")) for k, e in m["notes"].items()]
    return spark.createDataFrame(files, MANIFEST_FILES), spark.createDataFrame(notes, MANIFEST_NOTES)
