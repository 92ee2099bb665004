"""Run registered queries beside their oracle SQL and compare row by row.

    python tests/oracle_check.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(int(value)) if value == int(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canon(r[i]) for i in order) for r in rows)


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    rel = con.sql(sql)
    return rows_of(list(rel.columns), rel.fetchall())


def compare(spark, sf_dir: str, name: str, function, sql: str | None):
    start = time.time()
    df = function(spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return True, f"rows-only {len(rows)} ({seconds:.1f}s)"
    mine = rows_of(df.columns, rows)
    other = oracle(sf_dir, sql)
    if mine == other:
        return True, f"match {len(rows)} ({seconds:.1f}s)"
    if mine[0] != other[0]:
        return False, f"columns {mine[0]} vs {other[0]}"
    a, b = set(mine[1]), set(other[1])
    return False, (f"rows {len(mine[1])} vs {len(other[1])}; only spark {len(a - b)} {sorted(a - b)[:3]}; "
                   f"only oracle {len(b - a)} {sorted(b - a)[:3]}")


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from contestry.session import build_session

    spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, sf_dir, name, function, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - reported, not hidden
            causes = [line.strip()[:200] for line in str(error).splitlines() if "Caused" in line or "Exception" in line or "Error" in line]
            ok, note = False, f"{type(error).__name__}: {str(error)[:200]} {causes[:6]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + "  " + note, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
