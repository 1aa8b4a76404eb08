"""Compare every named query with its SQL in DuckDB: ``python tests/check_queries.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sparkbi.plans.registry import load  # noqa: E402
from sparkbi.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return str(value) if hasattr(value, "isoformat") else value


def rows_of(records, names) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(record[i]) for i in order) for record in records)


def compare(spark, db, folder: str, name: str, item) -> str | None:
    """``None`` when rows and column names agree, else what differs."""
    made = item.build(spark, folder)
    got = rows_of([tuple(row) for row in made.collect()], made.columns)
    if item.sql is None:
        return None if got else "no rows"
    found = db.execute(item.sql)
    names = [column[0] for column in found.description]
    types = {column[0]: str(column[1]) for column in found.description}
    want = rows_of(found.fetchall(), names)
    if sorted(names) != sorted(made.columns):
        return f"columns {sorted(made.columns)} against {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} against {sum(want.values())} rows; ours {list((got - want).items())[:3]}; SQL {list((want - got).items())[:3]}"
    spelled = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    odd = [(n, t, types[n]) for n, t in made.dtypes if spelled.get(t, t) != types[n]]
    return f"TYPES {odd}" if odd else None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(sys.argv[2:])
    spark, db = build_session(8), connect(folder)
    bad = 0
    for name, item in load().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, db, folder, name, item)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
