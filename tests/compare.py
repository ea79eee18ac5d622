"""Run registered queries against their SQL twins in DuckDB and report differences.

    python tests/compare.py [--dir FOLDER] [name prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import importlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from grainmill.workloads.registry import ORACLES, QUERIES, SCHEMAS  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9) + 0.0
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(row[i]) for i in order) for row in rows]
    data.sort(key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))
    return [columns[i] for i in order], data


KINDS = {"bigint": "int", "int": "int", "smallint": "int", "double": "float", "string": "str", "boolean": "bool"}
DUCK_KINDS = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}


def compare(name: str, spark, con, folder: str):
    """None when equal, else a description of the first difference."""
    frame = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    if name not in ORACLES:
        return None if frame.columns else "no columns"
    cursor = con.execute(ORACLES[name])
    duck_names = [d[0] for d in cursor.description]
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    duck_rows = cursor.fetchall()
    a_names, a = table(frame.columns, rows)
    b_names, b = table(duck_names, duck_rows)
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}: {a[:2]} / {b[:2]}"
    for field in frame.dtypes:
        if KINDS.get(field[1], field[1]) != DUCK_KINDS.get(duck_types[field[0]], duck_types[field[0]]):
            return f"type of {field[0]}: {field[1]} vs {duck_types[field[0]]}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(n, u, v) for n, u, v in zip(a_names, x, y) if u != v]
            return f"value {bad[:3]} in {x} / {y}"
    return None


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--module", action="append")
    parser.add_argument("prefix", nargs="*")
    args = parser.parse_args()
    if args.module:
        for module in args.module:
            importlib.import_module(f"grainmill.workloads.{module}")
    else:
        from grainmill.workloads import load_all

        load_all()
    from grainmill.session import local_session

    spark = local_session(8)
    con = connect(args.dir)
    failed = 0
    names = [n for n in QUERIES if not args.prefix or any(n.startswith(p) for p in args.prefix)]
    for name in names:
        start = time.time()
        try:
            problem = compare(name, spark, con, args.dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        if problem or time.time() - start > 3:
            print(f"{mark} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
