"""Compare every named query with its SQL: ``python tests/compare.py [dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(directory: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{directory}/{table}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark_df, relation, exact: bool = True) -> list[str]:
    spark_columns, spark_rows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    sql_columns, sql_rows = rows_of(relation.columns, relation.fetchall())
    if spark_columns != sql_columns:
        return [f"columns {spark_columns} != {sql_columns}"]
    if len(spark_rows) != len(sql_rows):
        return [f"{len(spark_rows)} rows != {len(sql_rows)}"]
    return [f"{dict(zip(spark_columns, a))} != {dict(zip(sql_columns, b))}" for a, b in zip(spark_rows, sql_rows) if a != b][:3]


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from creditgrain.session import session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(directory)
    sql = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = run(spark, directory)
            if name in sql:
                found = differences(df, connection.sql(sql[name]))
                verdict = "ok" if not found else "DIFFERENT " + " | ".join(found)
            else:
                verdict = f"{df.count()} rows (no SQL)"
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        failed += verdict.startswith(("DIFFERENT", "FAILED"))
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)
    print(f"{failed} of {len(queries())} differ")
    return failed


if __name__ == "__main__":
    sys.exit(main())
