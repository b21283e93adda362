"""Command line: index a library, search it, show the context of a chunk.

``python -m quire.cli index --items items.json --data-dir DIR`` (``--items`` is a file of one JSON item per line; without it
the HTTP API of the settings is read), ``... search QUERY``, ``... items QUERY``, ``... context CHUNK_ID``."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import DEFAULT
from quire.engine import Engine, response_json
from quire.sources.api import LibrarySource


def _items(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None:
        spark.dataSource.register(LibrarySource)
        headers = {f"header.{k}": v for k, v in DEFAULT.api_headers}
        return spark.read.format("library").options(base=DEFAULT.api_base, prefix=DEFAULT.api_prefix, timeout=str(DEFAULT.http_timeout), **headers).load()
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("json"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire")
    parser.add_argument("--index-dir", default=DEFAULT.index_dir)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("--items")
    one.add_argument("--data-dir", required=True)
    one.add_argument("--collection")
    one.add_argument("--rebuild", action="store_true")
    for name, k in (("search", 5), ("items", 10)):
        sub = commands.add_parser(name)
        sub.add_argument("query", nargs="+")
        sub.add_argument("-k", type=int, default=k)
    around = commands.add_parser("context")
    around.add_argument("chunk_id")
    around.add_argument("--window", type=int, default=2)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    engine = Engine(spark, _items(spark, args.items) if args.command == "index" else None, config=replace(DEFAULT, index_dir=args.index_dir))
    if args.command == "index":
        if args.rebuild:
            engine.rebuild()
        print(json.dumps(engine.index_library(args.data_dir, args.collection)))
    elif args.command == "search":
        print(response_json(engine.rag_search(args.query, args.k)))
    elif args.command == "items":
        print(response_json(engine.search_items(args.query, args.k)))
    else:
        print(json.dumps(engine.get_chunk_context(args.chunk_id, args.window), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
