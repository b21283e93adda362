"""Incremental processing as a stream: each micro-batch of sightings is one batch of the ledger.

Spark repeats a micro-batch under the same id after a failure; the ledger makes the repetition harmless,
so sightings are processed once although the sink is only at-least-once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.operators.incremental import Ledger, current_state


def sync_stream(spark: SparkSession, source: str, schema: StructType | str, ledger: Ledger, process: Callable[[DataFrame], DataFrame], checkpoint: str, *, seen: str = "seen_at", max_files: int = 64, once: bool = True) -> StreamingQuery:
    """Runs ``process`` over the new or changed keys of every micro-batch of Parquet sightings below ``source``.

    ``once`` takes what is there in batches of ``max_files`` files and stops."""
    sightings = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        ledger.run(current_state(df, ledger.key, ledger.state, seen), process, f"{number:012d}")

    writer = sightings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
