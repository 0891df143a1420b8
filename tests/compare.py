"""Run registered queries next to their SQL and compare names, types and values.

    python -m tests.compare [key ...]      (SF_DIR chooses the data)
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else float(f"{value:.9g}"))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


_SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a DuckDB result; empty when equal."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    problems = []
    if names != sorted(relation.columns):
        return [f"columns {names} / {sorted(relation.columns)}"]
    theirs = dict(zip(relation.columns, map(str, relation.types), strict=True))
    for field in df.schema:
        want = _SAME_TYPE.get(field.dataType.simpleString())
        if want != theirs[field.name]:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} / {theirs[field.name]}")
    ours_rows = [tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect()]
    order = [relation.columns.index(n) for n in names]
    their_rows = [tuple(_plain(r[i]) for i in order) for r in relation.fetchall()]
    ours_rows.sort(key=repr)
    their_rows.sort(key=repr)
    if len(ours_rows) != len(their_rows):
        problems.append(f"rows {len(ours_rows)} / {len(their_rows)}")
    if ours_rows != their_rows:
        a, b = set(ours_rows), set(their_rows)
        problems.append(f"only spark ({len(a - b)}): {str(sorted(a - b, key=repr)[:2])[:900]}")
        problems.append(f"only sql ({len(b - a)}): {str(sorted(b - a, key=repr)[:2])[:900]}")
    return problems


def main(keys: list[str]) -> int:
    import __spark_entry__ as entry
    from gatelens.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    con, failed = connect(sf_dir), 0
    for key in keys or queries:
        started = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in sql:
                problems = compare(df, con, sql[key])
            else:
                problems = []
                print(f"{key}: rows only, {df.count()} rows")
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1200]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {key} {time.time() - started:.1f}s")
        for p in problems:
            print("     ", p)
    print(f"{failed} failed of {len(keys or queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
