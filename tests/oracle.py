"""Runs a registered query and its SQL twin on the same tables and compares them."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _cell(value, digits: int):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, digits) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v, digits) for v in value)
    return value


def _rows(names, rows, digits):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(r[i], digits) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def run_spark(frame, digits=9):
    return sorted(frame.columns), _rows(frame.columns, [tuple(r) for r in frame.collect()], digits)


def run_sql(db, sql, digits=9):
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), _rows(names, cursor.fetchall(), digits)


def compare(spark, db, sf_dir, query, sql, digits=9) -> dict:
    start = time.time()
    names, rows = run_spark(query(spark, sf_dir), digits)
    middle = time.time()
    out = {"rows": len(rows), "spark_s": round(middle - start, 2)}
    if sql is None:
        return {**out, "match": None}
    sql_names, sql_rows = run_sql(db, sql, digits)
    out["sql_s"] = round(time.time() - middle, 2)
    differing = [(a, b) for a, b in zip(rows, sql_rows) if a != b]
    out["match"] = names == sql_names and len(rows) == len(sql_rows) and not differing
    if not out["match"]:
        out["why"] = (names, sql_names, len(sql_rows), len(differing), differing[:2])
    return out
