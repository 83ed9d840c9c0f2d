"""Compare catalogue queries with their check SQL in DuckDB: python tests/check_catalog.py [sf_dir] [name ...]"""

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from turnloom.plans.catalog import CHECKS, QUERIES  # noqa: E402
from turnloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    found = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in found.collect()]
    if name not in CHECKS:
        return None if rows else "no rows"
    wanted = con.execute(CHECKS[name])
    names = [d[0] for d in wanted.description]
    expected = wanted.fetchall()
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} vs {sorted(names)}"
    left, right = comparable(found.columns, rows), comparable(names, expected)
    if left == right:
        return None if rows else "no rows"
    only_left, only_right = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    return f"{len(left)} vs {len(right)} rows; only spark {only_left[:2]}; only sql {only_right[:2]}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
