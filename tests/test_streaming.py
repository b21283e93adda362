from datetime import datetime

from pyspark.sql import functions as F

from quire.operators.incremental import Ledger
from quire.streaming.sync import sync_stream


def test_sightings_are_processed_once(spark, tmp_path):
    schema = "attachmentKey string, mtime double, size bigint, seen_at timestamp"
    source = str(tmp_path / "in")
    add = lambda *r: spark.createDataFrame([(k, m, 1, datetime(2024, 1, d)) for k, m, d in r], schema).coalesce(1).write.mode("append").parquet(source)
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", "attachmentKey", ["mtime", "size"])
    run = lambda: sync_stream(spark, source, schema, ledger, lambda df: df.withColumn("done", F.lit(True)), str(tmp_path / "cp")).awaitTermination()
    add(("a", 1.0, 1), ("b", 1.0, 1), ("a", 2.0, 2))
    run()
    add(("a", 2.0, 3), ("c", 1.0, 3), ("b", 5.0, 4))
    run()
    run()
    out = sorted((r.attachmentKey, r.mtime) for r in ledger.output().collect())
    assert out == [("a", 2.0), ("b", 1.0), ("b", 5.0), ("c", 1.0)]
