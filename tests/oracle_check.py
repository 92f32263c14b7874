"""Compare named queries with their SQL in DuckDB: ``python tests/oracle_check.py [folder] [names]``."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def _rows(table) -> tuple[list[str], Counter]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, Counter(zip(*columns)) if columns else Counter()


def compare(spark_table, duck_table) -> str | None:
    """Why two Arrow tables differ as bags of rows, or None."""
    names, got = _rows(spark_table)
    wanted_names, wanted = _rows(duck_table)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    kinds = [
        (n, str(spark_table.schema.field(n).type), str(duck_table.schema.field(n).type))
        for n in names
    ]
    wrong = [k for k in kinds if k[1] != k[2]]
    if wrong:
        return f"types {wrong}"
    if got != wanted:
        extra, missing = list((got - wanted).items()), list((wanted - got).items())
        return f"{len(extra)} extra, {len(missing)} missing, e.g. {extra[:2]} vs {missing[:2]}"
    return None


def main() -> int:
    import __spark_entry__ as entry

    from corpusflow.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, failures = local_session(8), duck(folder), 0
    for name in names:
        started = time.time()
        try:
            got = entry.queries()[name](spark, folder).toArrow()
        except Exception as e:
            print(f"FAIL {name} {str(e)[:600]}", flush=True)
            failures += 1
            continue
        spark_time, started = time.time() - started, time.time()
        sql = entry.oracle_sql().get(name)
        try:
            problem = compare(got, con.sql(sql).to_arrow_table()) if sql else None
        except duckdb.Error as e:
            problem = str(e)
        failures += problem is not None
        print(
            f"{'FAIL' if problem else 'ok' if sql else 'rows'} {name} {got.num_rows} rows,"
            f" spark {spark_time:.2f}s duckdb {time.time() - started:.2f}s {(problem or '')[:1500]}",
            flush=True,
        )
    return failures


if __name__ == "__main__":
    sys.exit(main())
