"""Run named queries in Spark and their SQL twins in DuckDB, and compare.

    python tests/check_oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def session(name="check"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compare(df, con, sql):
    """None when rows, column names and column types are equal, else what differs."""
    con.execute(f"CREATE OR REPLACE TEMP TABLE want AS {sql}")
    con.register("got", df.toArrow())
    types = {
        t: dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {t})").fetchall())
        for t in ("got", "want")
    }
    if types["got"] != types["want"]:
        return f"types {types['got']} vs {types['want']}"
    cols = ", ".join(f'"{c}"' for c in sorted(types["want"]))
    n = [con.execute(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("got", "want")]
    if n[0] != n[1]:
        return f"rows {n[0]} vs {n[1]}"
    extra = f"(SELECT {cols} FROM got EXCEPT ALL SELECT {cols} FROM want)"
    lacking = f"(SELECT {cols} FROM want EXCEPT ALL SELECT {cols} FROM got)"
    bad = con.execute(f"SELECT count(*) FROM {extra}").fetchall()[0][0]
    if bad:
        first = [con.execute(f"SELECT * FROM {q} ORDER BY ALL LIMIT 2").fetchall() for q in (extra, lacking)]
        return f"{bad} of {n[0]} rows differ ({cols}): got {first[0]}, want {first[1]}"
    return None


def main(argv):
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = session(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
                rows = con.execute("SELECT count(*) FROM want").fetchall()[0][0]
            else:
                rows = df.count()
                problem = None if rows else "no rows"
        except Exception as e:  # report and go on with the next query
            problem, rows = f"{type(e).__name__}: {str(e)[:600]}", -1
        took = time.time() - start
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} {took:.1f}s{'' if name in sql else ' (rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
