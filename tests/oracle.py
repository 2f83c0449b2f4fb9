"""Compare registered queries with their check SQL. Usage: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


TIMES: dict[str, float] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted text tuples over columns in name order."""
    columns = []
    for name in sorted(df.columns):
        columns.append([None if _missing(v) else _text(v) for v in df[name].tolist()])
    return sorted(zip(*columns), key=repr)


def _missing(value) -> bool:
    return value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value)


def _text(value) -> str:
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(pd.Timestamp(value)) if hasattr(value, "isoformat") else str(value)


def differences(spark, con, name: str, sf_dir: str, look=lambda df: None) -> list[str]:
    """Empty if the query and its check agree. ``look`` is given the query's result before it is computed."""
    start = time.time()
    result = entry.queries()[name](spark, sf_dir)
    look(result)
    left = result.toPandas()
    TIMES[name] = time.time() - start
    right = con.execute(entry.oracle_sql()[name]).df()
    if sorted(left.columns) != sorted(right.columns):
        return [f"columns {sorted(left.columns)} != {sorted(right.columns)}"]
    a, b = canonical(left), canonical(right)
    if a == b:
        return [] if a else ["no rows"]
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    found = [f"rows {len(a)} vs {len(b)}, {len(only_a)} only in Spark, {len(only_b)} only in check", str(sorted(left.columns))]
    for x, y in list(zip(only_a, only_b))[:2]:
        found += [f"  spark {str(x)[:600]}", f"  check {str(y)[:600]}"]
    return found


def main() -> None:
    from reviewmill.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("local[8]", 8, spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="reviewmill-"))
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            if name in checks:
                found = differences(spark, con, name, sf_dir)
            else:
                rows = entry.queries()[name](spark, sf_dir).toPandas()
                found = [] if len(rows) else ["no rows"]
        except Exception as error:  # report every query, then fail
            found = [f"{type(error).__name__}: {str(error)[:6000]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name} {time.time() - start:.1f}s (Spark {TIMES.get(name, 0):.1f}s)", *found, sep="\n    " if found else " ", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
