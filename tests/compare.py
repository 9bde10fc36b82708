"""Run registered queries next to their SQL and compare rows exactly, whatever their order."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame):
    """Sorted tuples with columns in name order; numbers as numbers, so 1 and 1.0 are equal."""
    return sorted((tuple(r) for r in frame), key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(spark, con, query, sql, sf_dir):
    """An empty string, or what differs."""
    df = query(spark, sf_dir)
    order = sorted(df.columns)
    ours = rows_of(df.select(*order).collect())
    relation = con.sql(sql)
    if sorted(relation.columns) != order:
        return f"columns {order} against {sorted(relation.columns)}"
    quoted = ", ".join(f'"{c}"' for c in order)
    theirs = rows_of(relation.project(quoted).fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, first {different[0]}"
    kinds = {str(type(v)) for r in ours[:1] for v in r}, {str(type(v)) for r in theirs[:1] for v in r}
    if kinds[0] != kinds[1]:
        return f"types {kinds}"
    return "" if ours else "no rows"


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name not in sql:
                print(f"{name}: no SQL, {query(spark, sf_dir).count()} rows ({time.time() - began:.1f} s)", flush=True)
                continue
            problem = compare(spark, con, query, sql[name], sf_dir)
        except Exception as error:  # show and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{name}: {problem or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
