"""python tests/compare.py SF NAME...: runs queries of __spark_entry__ beside their SQL and prints what differs."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as E

TABLES = "region nation customer supplier part orders lineitem events documents embeddings attachments notes chunks file_listing manifest_files manifest_notes index_runs name_forms pack_capacities".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def main(sf, names):
    d = sf if "/" in sf else f"/root/testdata/{sf}"
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet{'/*.parquet' if Path(f'{d}/{t}.parquet').is_dir() else ''}'")
    queries, sql = E.queries(), E.oracle_sql()
    for name in names or queries:
        began = time.time()
        df = queries[name](spark, d)
        got = [tuple(r.asDict(recursive=True)[c] for c in df.columns) for r in df.collect()]
        took = time.time() - began
        if name not in sql:
            print(f"{name}: {len(got)} rows, {took:.1f} s, no SQL; {str(got[:2])[:200]}", flush=True)
            continue
        try:
            res = con.execute(sql[name])
        except duckdb.Error as e:
            print(f"{name}: the SQL fails: {str(e)[:300]}", flush=True)
            continue
        cols = [c[0] for c in res.description]
        want = rows(cols, res.fetchall())
        have = rows(df.columns, got)
        ok = sorted(cols) == sorted(df.columns) and have == want
        print(f"{name}: {'same' if ok else 'DIFFERENT'}, {len(have)} rows, {took:.1f} s", flush=True)
        if not ok:
            print("  columns", sorted(df.columns), sorted(cols))
            print("  only here", [r for r in have if r not in set(want)][:3] if len(have) < 20000 else "")
            print("  only SQL", [r for r in want if r not in set(have)][:3] if len(want) < 20000 else "")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
