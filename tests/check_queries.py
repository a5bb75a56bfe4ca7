"""Run registered queries against their check SQL.

    python tests/check_queries.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return [columns[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in rows)


TIMES = {}
_KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool",
          "timestamp": "ts", "timestamp_ntz": "ts",
          "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool",
          "TIMESTAMP": "ts"}


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    TIMES[name] = time.time() - start
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = canonical(columns, cur.fetchall())
    problems = []
    if got[0] != want[0]:
        return [f"columns {sorted(set(got[0]) ^ set(want[0]))}"], len(got[1])
    for c, t in df.dtypes:
        if _KINDS.get(t, t) != _KINDS.get(types[c], types[c]):
            problems.append(f"type of {c}: {t} / {types[c]}")
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        problems.append(
            f"rows {len(got[1])}/{len(want[1])}, only spark {len(a)} {sorted(a)[:1]}, only sql {len(b)} {sorted(b)[:1]}"
        )
    return problems, len(got[1])


def main(argv):
    from conftest import make_spark

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    names = argv[1:] or list(queries)
    spark, con = make_spark(), oracle_connection(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems, rows = compare(spark, con, sf_dir, name, queries[name], sql[name])
        except Exception as error:
            problems, rows = [f"{type(error).__name__}: {str(error)[:600]}"], -1
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={rows} spark {TIMES.get(name, -1):.1f}s all {time.time() - start:.1f}s {problems or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed; without check SQL: {sorted(set(queries) - set(sql))}")
    return failed


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    sys.exit(1 if main(sys.argv[1:]) else 0)
