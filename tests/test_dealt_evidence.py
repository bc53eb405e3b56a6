"""Evidence of files whose lines are dealt once by part, change and path, on rows of its own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patchsieve.operators import evidence as E
from patchsieve.operators import frames
from patchsieve.plans import history
from patchsieve.plans.catalog import QUERIES
from patchsieve.plans.registry import Tables

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders that repeat with other days and customers, times within a day, null keys, lines without a part, large numbers."""
    at = str(tmp_path_factory.mktemp("dealt"))
    lines = []
    for i in range(400):
        cid = i % 37 if i % 41 else None
        lines.append((cid, i % 9 if i % 13 else None, i % 4 if i % 17 else None, i % 6 if i % 19 else None,
                      float(i % 50) if i % 23 else 5000.5, i * 1.25 if i % 29 else 1e12 + 0.001, (i % 11) / 100, (i % 9) / 100 if i % 31 else 3.07))
    lines += lines[:60] + [(5, 1, 2, 1, 7.0, 3.0, 0.01, 0.02)] * 4
    lines += [(50, i % 7, 1, i, float(i % 40), 1.0, 0.02, (i % 9) / 100) for i in range(80)]
    orders = [(i, i % 5, DAY + dt.timedelta(days=i % 11), ["1-URGENT", "2-HIGH", "5-LOW", None][i % 4]) for i in range(34)] + [(50, 1, DAY, "2-HIGH")]
    orders += [(3, 1, DAY + dt.timedelta(hours=5), "2-HIGH"), (3, 2, DAY, "5-LOW"), (4, 4, None, "1-URGENT"), (6, 1, dt.datetime(1960, 5, 5), None), (7, 99, DAY, "5-LOW")]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "orders": (orders + orders[:9], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(i, i % 2 if i != 4 else None) for i in range(5)] + [(1, 7)], "c_custkey long, c_nationkey int"),
        "part": ([(i, ["ECONOMY", "STANDARD", "PROMO", None][i % 4], i if i != 5 else None) for i in range(7)] + [(2, "SMALL", 4)], "p_partkey long, p_type string, p_size int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def told(df):
    types = F.transform("evidence", lambda e: F.concat_ws("|", e["evidence_type"], e["description"]))
    return sorted(map(str, df.select(*[c for c in history.FILE if c != "item"], types.alias("e")).collect()))


@pytest.mark.parametrize("cut", [False, True])
def test_one_route_gives_the_rows_of_the_joins(spark, folder, cut):
    t = Tables(spark, folder)
    files = history.change_files(t)
    want = told(E.merge_evidence(history.facts(files), history.past(t, files), history.FILE, history.derived))
    if cut:  # changes and paths are cut into slices
        spark.conf.set("patchsieve.sliceRows", "3")
        spark.conf.set("patchsieve.slicesPerPartition", "200")
    try:
        got = told(history.merged(t))
    finally:
        spark.conf.unset("patchsieve.sliceRows")
        spark.conf.unset("patchsieve.slicesPerPartition")
    assert got == want and len(want) > 300


def test_lines_are_not_dealt_by_file(spark, folder, capsys, monkeypatch):
    """Ranks and history meet where the rows are: no exchange by the keys of a file, and no table of files is written."""
    monkeypatch.setattr(frames, "new_folder", lambda *_: pytest.fail("written"))
    QUERIES["evidence_projection"](spark, folder).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" in plan and not any("line#" in x.split(", item#")[0] for x in plan.splitlines() if "hashpartitioning(cid#" in x and ", item#" in x)


def test_packed_numbers_are_whole(spark):
    rows = [(1, 0.07), (None, 0.07), (-1, 0.5), (300, 0.5), (255, 1 / 3), (2, None), (3, 1e300), (4, float("nan"))]
    df = spark.createDataFrame(rows, "n long, x double")
    got = frames.packed(df, ["n", "x"], {"n": 8, "x": 7}, {"n": 1, "x": 100})
    back = frames.unpacked({"n": 8, "x": 7}, {"n": 1, "x": 100})
    same = got.select(back["n"].eqNullSafe(F.col("n")) & back["x"].eqNullSafe(F.col("x")), F.col("__few").isNotNull())
    assert sorted(map(tuple, same.collect())) == [(True, False)] * 7 + [(True, True)]
    longs = frames.packed(df.select("n"), ["n"], {"n": 8})
    assert longs.where(frames.unpacked({"n": 8})["n"].eqNullSafe(F.col("n"))).count() == len(rows)
