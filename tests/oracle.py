"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py sf_dir [name...]``."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """Numbers by their value, whatever their type."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if hasattr(value, "is_integer") or hasattr(value, "as_tuple"):
        value = float(value)
        return 0.0 if value == 0 else value
    return float(value) if isinstance(value, int) else str(value)


def rows(columns: list[str], values) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in values)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if the rows agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine != theirs:
        a, b = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
        return f"{sum((mine - theirs).values())} of {sum(mine.values())} rows differ from {sum(theirs.values())}: {a} against {b}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import time

    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    directory, names = sys.argv[1], sys.argv[2:]
    con, queries, sqls = connect(directory), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            said = compare(session, con, directory, queries[name], sqls[name]) if name in sqls else f"(no SQL) {queries[name](session, directory).count()} rows"
        except Exception as e:  # noqa: BLE001  a report of all queries is wanted
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(name, f"{time.time() - began:.1f}", said or "ok", flush=True)
