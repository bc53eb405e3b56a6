"""The sliced frames must give what the plain windows give."""

import random

import pytest
from pyspark.sql import functions as F

from patchsieve.operators import frames


@pytest.fixture(params=["1", "40"])
def slices(spark, request):
    """Few and many slices; without any group is a slice, as with plain windows."""
    spark.conf.set(frames.SLICES_PER_PARTITION, request.param)
    spark.conf.set(frames.SLICE_ROWS, "1")
    yield
    spark.conf.unset(frames.SLICES_PER_PARTITION)
    spark.conf.unset(frames.SLICE_ROWS)


def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(900):
        group = None if i % 3 == 0 else f"g{i % 7}" if i % 3 == 1 else f"s{i}"
        data.append((group, rnd.choice([1.0, 2.0, 2.5, 9.0]), i, rnd.choice([None, i]), rnd.randint(0, 5)))
    return spark.createDataFrame(data, "g string, v double, seq int, mark int, w int").repartition(5)


def run(df, group):
    out = frames.frame(
        df, group, [-F.col("v"), F.col("seq")], row="r",
        sums={"s": F.col("w")}, lasts={"l": F.col("mark")}, maxes={"m": F.col("w")},
        totals={"t": F.col("w")},
    )
    return sorted(map(tuple, out.collect()), key=str)


def plain(data, grouped):
    """The same values, counted row by row."""
    groups = {}
    for r in data:
        groups.setdefault(r["g"] if grouped else None, []).append(r)
    out = []
    for members in groups.values():
        total, running, last, most = sum(r["w"] for r in members), 0, None, None
        for n, r in enumerate(sorted(members, key=lambda r: (-r["v"], r["seq"])), 1):
            out.append((*r, n, running, last, most, total))
            running += r["w"]
            last = r["mark"] if r["mark"] is not None else last
            most = r["w"] if most is None else max(most, r["w"])
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [["g"], []])
def test_frames_equal_a_loop(spark, slices, group):
    df = rows(spark)
    assert run(df, group) == plain(df.collect(), bool(group))


def test_large_groups_are_cut_and_small_ones_are_not(spark, slices):
    """The group of nulls holds a third of the rows."""
    df = rows(spark)
    order = [-F.col("v"), F.col("seq")]
    got = frames._sliced(df, ["g"], order, frames._splits(df, ["g"], order), "left").groupBy("g", "__slice").count().collect()
    cut = [r["count"] for r in got if r["g"] is None]
    assert len(cut) > 1 and max(cut) < 300 * (0.9 if len(cut) < 8 else 0.2)
    assert {r["__slice"] for r in got if str(r["g"]).startswith("s")} == {None}


def test_halving_finds_the_place_among_the_splits(spark):
    cases = [(s, v) for s in ([], [3], [3, 3, 5], list(range(0, 40, 2))) for v in range(-1, 42)]
    df = spark.createDataFrame(cases, "s array<int>, v int").select("*", frames._below(F.col("s"), F.col("v"), 20).alias("n"))
    assert all(r.n == sum(x <= r.v for x in r.s) for r in df.collect())


def test_branches_for_large_groups_are_skipped_where_there_is_none(spark, tmp_path):
    """One pass for the sizes and one for the rows: the samples and the totals of slices read nothing."""
    path = str(tmp_path / "t")
    rows(spark).write.parquet(path)
    out = frames.frame(spark.read.parquet(path), ["g"], [F.col("seq")], row="r", sums={"s": F.col("w")})
    out.collect()
    # the last plan that adaptive execution settled on
    final = out._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    assert final.count("Scan parquet") <= 1 and "BroadcastHashJoin" not in final


def test_nothing_runs_while_a_frame_is_built(spark):
    df = rows(spark)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    frames.number_rows(df, ["g"], [F.col("seq")])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("group", [["g"], []])
def test_percentiles_equal_builtin(spark, slices, group):
    df = rows(spark).withColumn("x", F.col("v") * F.col("seq"))
    points = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {tuple(r[:len(group)]): r for r in frames.percentiles(df, group, "x", points).collect()}
    want = df.groupBy(*group).agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in points.items()]).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[tuple(r[:len(group)])][len(group):] == pytest.approx(tuple(r[len(group):]))


def test_first_rows_prunes_before_the_shuffle(spark, capsys):
    df = frames.first_rows(rows(spark), ["g"], [F.col("seq")], 3)
    assert df.groupBy("g").count().agg(F.max("count")).first()[0] == 3
    df.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


@pytest.mark.parametrize("group", [["g"], []])
@pytest.mark.parametrize("n", [1, 2, 4, 50])
def test_previous_rows_cross_slice_ends(spark, slices, group, n):
    df = rows(spark)
    out = frames.with_previous(df, group, [F.col("seq")], n, F.col("seq"), "p")
    got = {r["seq"]: list(r["p"]) for r in out.collect()}
    groups = {}
    for r in sorted(df.collect(), key=lambda r: r["seq"]):
        members = groups.setdefault(r["g"] if group else None, [])
        members.append(r["seq"])
        assert got[r["seq"]] == members[-n:]
    assert len(got) == 900


@pytest.mark.parametrize("group", [["g"], []])
@pytest.mark.parametrize("n", [1, 5, 50])
def test_last_entries_leave_out_rows_without_one(spark, slices, group, n):
    df = rows(spark)
    out = frames.with_last(df, group, [F.col("seq")], n, F.col("mark"), "p")
    got = {r["seq"]: list(r["p"]) for r in out.collect()}
    groups = {}
    for r in sorted(df.collect(), key=lambda r: r["seq"]):
        members = groups.setdefault(r["g"] if group else None, [])
        members += [r["mark"]] * (r["mark"] is not None)
        assert got[r["seq"]] == members[-n:]
    assert len(got) == 900


def test_summary_equals_builtin(spark, slices):
    df = rows(spark).withColumn("x", F.col("v") * F.col("seq"))
    moments = {m: m for m in ("count", "mean", "std", "min", "max")}
    got = {r["g"]: tuple(r)[1:] for r in frames.summary(df, ["g"], "x", {"p": 0.3}, moments).collect()}
    want = df.groupBy("g").agg(F.count("x"), F.avg("x"), F.stddev_pop("x"), F.min("x"), F.max("x"), F.percentile("x", F.lit(0.3))).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r["g"]] == pytest.approx(tuple(r)[1:][:5] + (r[6],))
