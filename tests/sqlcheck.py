"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def differences(spark_df, connection, sql: str, show: int = 3, counted: list | None = None) -> list[str]:
    left_columns, left = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = connection.execute(sql)
    right_columns, right = _rows([d[0] for d in result.description], result.fetchall())
    if left_columns != right_columns:
        return [f"columns {left_columns} != {right_columns}"]
    if counted is not None:
        counted.append(len(left))
    notes = []
    if len(left) != len(right):
        notes.append(f"rows {len(left)} != {len(right)}")
    kinds_left, kinds_right = ([{type(v).__name__ for v in column} - {"NoneType"} for column in zip(*rows)] for rows in (left, right))
    for name, a, b in zip(left_columns, kinds_left, kinds_right):
        if a != b and a and b:
            notes.append(f"type of {name}: {a} != {b}")
    if left != right:
        only_left, only_right = sorted(set(left) - set(right), key=repr), sorted(set(right) - set(left), key=repr)
        notes.append(f"{len(only_left)} only in Spark, {len(only_right)} only in SQL; {left_columns}")
        notes += [f"  spark {row}" for row in only_left[:show]] + [f"  sql   {row}" for row in only_right[:show]]
    return notes


def main(argv) -> int:
    import __spark_entry__ as entry
    from tests.conftest import session

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or list(entry.queries())
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
    spark, connection, failed = session(), connect(sf_dir), 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in [n for n in queries if any(n.startswith(prefix) for prefix in names)]:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            built = time.time()
            size = []
            notes = differences(df, connection, oracle[name], counted=size) if name in oracle else []
            count = f"({size[0]} rows)" if size else f"(no SQL, {len(df.collect())} rows)" if name not in oracle else ""
        except Exception as error:  # report and go on with the next query
            built, notes, count = time.time(), [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(notes)
        print(f"{'FAIL' if notes else 'ok  '} {name} {count} build {built - start:.1f}s total {time.time() - start:.1f}s", flush=True)
        for note in notes:
            print("     " + note[:1500], flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
