"""Run registered queries next to their SQL twins: ``python tests/compare.py <sf dir> [query ...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


# DuckDB names of the column types the queries may return.
TYPE_NAMES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, build, sql, sf_dir):
    df = build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), None
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    have_cols, have = bag(df.columns, rows)
    want_cols, want = bag(want_cols, cur.fetchall())
    problems = []
    kinds = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    other = [(c, t, kinds[c]) for c, t in df.dtypes if c in kinds and TYPE_NAMES.get(t) != kinds[c]]
    if other:
        problems.append(f"types differ: {other}")
    if have_cols != want_cols:
        problems.append(f"columns: only here {set(have_cols) - set(want_cols)}, only SQL {set(want_cols) - set(have_cols)}")
    elif have != want:
        extra, missing = list((have - want).items())[:3], list((want - have).items())[:3]
        problems.append(f"{sum((have - want).values())} of {len(rows)} rows differ (SQL has {sum(want.values())})")
        for a, b in zip(sorted(extra, key=str), sorted(missing, key=str)):
            diff = [(c, x, y) for c, x, y in zip(have_cols, a[0], b[0]) if x != y]
            problems.append(f"  e.g. {diff[:6]}")
    return len(rows), problems


def main(argv):
    from pyspark.sql import SparkSession

    from catalog import ORACLES, QUERIES

    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, problems = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
            state = "rows-only" if problems is None else "ok" if not problems else "DIFFERS"
        except Exception as e:  # noqa: BLE001
            n, problems, state = -1, [str(e)[:1500]], "FAILED"
        bad += state in ("DIFFERS", "FAILED")
        print(f"{state:10} {name:28} rows={n:<8} {time.time() - start:6.2f}s", flush=True)
        for p in problems or []:
            print("   ", p, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
