"""Compare registered queries with their DuckDB statements.

``python tests/compare.py SF_DIR [query ...]`` prints one line per query.
"""

import math
import sys
import time
from datetime import datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
#: Time that events of the tests are given relative to.
START = datetime(2026, 8, 18, 9, 0, 0)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    return names, types, cursor.fetchall()


def _sort_key(row):
    return [(v is None, str(type(v)), v if v is not None else 0) for v in row]


def differences(spark_df, names, types, rows):
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {spark_df.columns} != {names}"]
    order = sorted(names)
    ours = [tuple(r[c] for c in order) for r in spark_df.collect()]
    theirs = [tuple(r[names.index(c)] for c in order) for r in rows]
    found = []
    kinds = dict(zip(names, types))
    for field in spark_df.schema:
        got, want = field.dataType.simpleString(), kinds[field.name]
        same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN"}.get(got)
        if same != want:
            found.append(f"type of {field.name}: {got} / {want}")
    if len(ours) != len(theirs):
        return found + [f"{len(ours)} rows != {len(theirs)}"]
    for a, b in zip(sorted(ours, key=_sort_key), sorted(theirs, key=_sort_key)):
        for x, y in zip(a, b):
            close = (math.isclose(x, y, rel_tol=0, abs_tol=1e-9)
                     if isinstance(x, float) and isinstance(y, float) else x == y)
            if not close:
                found.append(f"{dict(zip(order, a))} != {dict(zip(order, b))}")
                break
    return found


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            found = differences(df, *oracle_rows(con, oracles[name])) if name in oracles else []
            n = df.count() if name not in oracles else len(oracle_rows(con, oracles[name])[2])
        except Exception as error:
            found, n = [f"{type(error).__name__}: {str(error)[:700]}"], 0
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} rows={n} {time.time() - start:.1f}s", flush=True)
        for line in found[:3]:
            print("    ", line, flush=True)
        if len(found) > 3:
            print("     ...", len(found), "differences")
    print("bad", bad)


if __name__ == "__main__":
    main()
