"""Runs registered queries next to their SQL in DuckDB and compares the rows.

    python tests/oracle.py /root/testdata/sf0.01 [key=value ...] [name ...]

``key=value`` is a session setting; ``spark.sql.autoBroadcastJoinThreshold=-1`` drives every
size-checked join down its shuffled, salted path.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from lorekeep.testbed.bindings import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in data)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    ours = rows(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if ours != theirs:
        return (f"rows {sum(ours.values())} / {sum(theirs.values())}; "
                f"only here {list((ours - theirs).items())[:2]!r:.600}; only there {list((theirs - ours).items())[:2]!r:.600}")
    if not ours:
        return "no rows"
    return None


def main() -> int:
    from lorekeep.session import build_session

    sf_dir = sys.argv[1]
    conf = dict(arg.split("=", 1) for arg in sys.argv[2:] if "=" in arg)
    names = [arg for arg in sys.argv[2:] if "=" not in arg] or list(contract.queries())
    spark = build_session("oracle", "local[8]", **{**conf, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                    "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - began:6.2f}s {name} {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
