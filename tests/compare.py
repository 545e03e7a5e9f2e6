"""Compare registered queries with their SQL; also a command-line check:

    python tests/compare.py [data folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime()
    return value


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(names), rows


def rows_of_frame(df) -> tuple[list[str], Counter]:
    names = df.columns
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(_plain(r[i]) for i in order) for r in df.collect())
    return sorted(names), rows


def difference(spark, con, folder: str, query, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    names, ours = rows_of_frame(query(spark, folder))
    expected_names, theirs = rows_of_sql(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if ours == theirs:
        return ""
    extra, missing = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; "
        f"only ours {sum(extra.values())}: {[str(r)[:300] for r in list(extra)[:2]]}; "
        f"only SQL {sum(missing.values())}: {[str(r)[:300] for r in list(missing)[:2]]}"
    )


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from primrose.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    registered, checks = queries(), oracle_sql()
    wanted = sys.argv[2:] or list(registered)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in wanted:
        start = time.time()
        try:
            if name in checks:
                result = difference(spark, con, folder, registered[name], checks[name])
            else:
                count = registered[name](spark, folder).count()
                result = "" if count else "no rows"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        print(f"{'ok  ' if not result else 'FAIL'} {name} {took:.1f}s {result}", flush=True)
        if result:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
