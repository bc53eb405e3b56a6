"""Run queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, Decimal)):
        return round(float(value), 6)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def same(a, b) -> bool:
    """Equal, or doubles apart by one step of the last rounded digit.

    Sums in another order can fall on either side of a rounding tie.
    """
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1.5e-6 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, con, name, build, sql, folder) -> str | None:
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, wanted {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {sorted(df.columns)}, first {bad[0][0]} / {bad[0][1]}"
    return None if got else "no rows"


def main(argv):
    sys.path.insert(0, ".")
    from patchsieve.session import local_session
    import __spark_entry__ as e

    folder = argv[0]
    wanted = argv[1:]
    spark = local_session()
    con = duck(folder)
    sqls, failed = e.oracle_sql(), []
    for name, build in e.queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, name, build, sqls.get(name), folder)
        except Exception as error:  # reported below
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        took = time.time() - began
        tag = "ok" if problem is None else "FAIL"
        print(f"{tag:5}{took:6.1f}s {name}{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
