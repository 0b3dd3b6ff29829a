"""Run registered queries next to their SQL counterparts: ``python -m tests.compare DIR [NAME ...]``."""

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _sorted_rows(rows):
    return sorted(rows, key=lambda row: tuple((value is not None, str(type(value)), str(value)) for value in row))


def differences(frame, connection, sql):
    """Empty text if both sides hold the same columns and the same rows."""
    names = sorted(frame.columns)
    ours = _sorted_rows([tuple(row) for row in frame.select(*names).collect()])
    result = connection.execute(sql)
    theirs_names = [column[0] for column in result.description]
    if sorted(theirs_names) != names:
        return f"columns {names} != {sorted(theirs_names)}"
    order = [theirs_names.index(name) for name in names]
    theirs = _sorted_rows([tuple(row[i] for i in order) for row in result.fetchall()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    for left, right in zip(ours, theirs):
        if left != right or [type(v) for v in left] != [type(v) for v in right]:
            return f"{names}\n   ours {left}\n theirs {right}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as contract
    from ledgerlark.session import local_session

    directory, chosen = sys.argv[1], sys.argv[2:]
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    database, sql = connect(directory), contract.oracle_sql()
    failed = []
    for name, build in contract.queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            frame = build(spark, directory)
            if name in sql:
                problem = differences(frame, database, sql[name])
            else:
                problem = "" if frame.count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.2f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
