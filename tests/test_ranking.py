import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from patchsieve.operators import evidence as E
from patchsieve.operators import features as X
from patchsieve.operators import history as H
from patchsieve.operators import ranking as R

TINY = [("tie", 0, 5, False), ("tie", 1, 5, False), ("tie", 2, 9, True), ("one", 0, 0, False), ("bin", 0, 3, True), ("bin", 1, 9, True)]
TINY += [("eight", i, 80 - i, False) for i in range(8)]


def tiny(spark):
    return spark.createDataFrame(TINY, "g string, seq int, value int, excluded boolean")


def test_rank_priority_and_bands(spark):
    out = R.priority_band(R.rank_priority(tiny(spark), ["g"], "value", ["seq"], "excluded"), "excluded")
    got = {(r["g"], r["seq"]): (r["position"], round(r["score"], 4), r["band"]) for r in out.collect()}
    assert got["tie", 0] == (0, 1.0, "highest") and got["tie", 1] == (1, 0.0, "medium") and got["tie", 2] == (2, 0.0, "low")
    assert got["one", 0] == (0, 1.0, "highest") and got["bin", 1] == (1, 0.0, "low")
    assert [got["eight", i][2] for i in range(8)] == ["highest", "high", "high", "medium", "medium", "low", "low", "low"]
    risk = R.risk_output(out, "seq", "excluded").where("g = 'tie'").orderBy("seq").collect()
    assert [(r["rank"], r["warning"]) for r in risk] == [(1, None), (2, None), (0, "Binary file 2 not scored")]


def test_minmax_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = sorted((r["g"], r["n"]) for r in R.minmax_normalize(df, "v", "n", ["g"]).collect())
    assert got == [("a", 0.5), ("a", 0.5), ("b", 0.0), ("b", 1.0)]


def test_random_scores_do_not_depend_on_the_layout(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 7)
    a = {r["id"]: r["score"] for r in R.random_baseline(df.repartition(3), 1, ["g", "id"]).collect()}
    b = {r["id"]: r["score"] for r in R.random_baseline(df.repartition(5), 1, ["g", "id"]).collect()}
    assert a == b and all(0 <= v < 1 for v in a.values()) and len(set(a.values())) == 200


T0 = dt.datetime(2020, 1, 1)


def touches(spark, rows):
    return spark.createDataFrame(
        [("r", "p", i, T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=c), fix, loose) for i, h, c, fix, loose in rows],
        "repo string, path string, pos int, ts timestamp, committed timestamp, is_fix boolean, loose_fix boolean")


def test_history_is_strictly_before(spark):
    t = touches(spark, [(0, 0, 0, True, True), (1, 47, 47, False, False), (2, 72, 72, True, True)])
    ask = spark.createDataFrame(
        [("r", "p", 0, T0, True), ("r", "p", 2, T0 + dt.timedelta(hours=72), True), ("r", "p", 3, T0 + dt.timedelta(hours=60), True),
         ("r", "p", 9, T0, False), ("r", "/dev/null", 9, T0, True)], "repo string, path string, pos int, ts timestamp, has_parent boolean")
    got = {(r["path"], r["pos"]): tuple(r)[3:] for r in H.history_features(ask, t, ["repo", "path"], ["pos"]).collect()}
    assert got["p", 0] == (0, 0, 0) and got["p", 2] == (2, 1, 1)
    assert got["p", 3] == (3, 2, 0)  # the clock ran backwards: days stop at 0
    assert got["p", 9] == (0, 0, 0) and got["/dev/null", 9] == (0, 0, 0)


def test_legacy_history_counts_newer_touches(spark):
    t = touches(spark, [(0, 48, 48, True, True), (1, 12, 12, True, True), (2, 36, 36, False, False)])
    got = {r["pos"]: tuple(r)[3:] for r in H.history_features_legacy(t, ["repo", "path"], ["pos"]).collect()}
    assert got == {0: (2, 1, 0.5), 1: (1, 0, 0.0), 2: (0, 0, 0.0)}


def test_recent_history_takes_five_then_filters(spark):
    # touch 5 was authored after the change but committed before it: it uses up one of the five places
    t = touches(spark, [(i, i, i, False, i == 1) for i in range(5)] + [(5, 200, 5, False, True), (6, 30, 31, False, False)])
    ask = t.where("pos = 6").select("repo", "path", "pos", (F.lit(T0 + dt.timedelta(hours=30))).alias("ts"), F.lit(T0 + dt.timedelta(hours=31)).alias("committed"))
    r = H.recent_history(ask, t, ["repo", "path"], ["pos"]).first()
    assert (r["recent_commits"], r["recent_bug_fixes"], r["days_since_last_change"], r["history_unavailable"]) == (4, 1, 1, False)
    first = t.where("pos = 0").select("repo", "path", "pos", "ts", "committed")
    assert H.recent_history(first, t, ["repo", "path"], ["pos"]).first()["history_unavailable"]


FACTS = dict(
    g="c", status="modified", lines_added=3, lines_deleted=1, hunk_count=1, function_declarations_added=0, function_declarations_deleted=0, class_declarations_added=0,
    class_declarations_deleted=0, imports_added=0, imports_deleted=0, is_binary=False, max_changed_line_indent=0, avg_changed_line_indent=0.0, avg_hunk_size=0.0,
    is_test_file=False, test_prod_coupling=False, has_test_changes=True, commit_lines=8, language=0.0, position=None, total_lines_changed=4, band="high",
)


def described(spark, **changes):
    schema = ("g string, status string, lines_added long, lines_deleted long, hunk_count int, function_declarations_added int, function_declarations_deleted int, class_declarations_added int, "
              "class_declarations_deleted int, imports_added int, imports_deleted int, is_binary boolean, max_changed_line_indent int, avg_changed_line_indent double, avg_hunk_size double, "
              "is_test_file boolean, test_prod_coupling boolean, has_test_changes boolean, commit_lines long, language double, position long, total_lines_changed long, band string")
    row = {**FACTS, **changes}
    df = E.cheap_evidence(spark.createDataFrame([tuple(row.values())], schema))
    return df.select("*", E.explanation().alias("why"), E.evidence_gaps().alias("gaps")).first()


def test_evidence_conditions(spark):
    plain = described(spark)
    assert [(e["evidence_type"], e["description"]) for e in plain["evidence"]] == [
        ("lines_changed", "3 lines added, 1 deleted"),
        ("change_concentration", "File accounts for 50% of total commit changes (4 of 8 lines)")]
    assert plain["why"] == "High-priority file; with 4 line(s) changed." and plain["gaps"] == []
    full = described(
        spark, hunk_count=2, function_declarations_added=1, class_declarations_deleted=1, imports_added=2, status="renamed", max_changed_line_indent=4, avg_changed_line_indent=0.25,
        avg_hunk_size=2.5, is_test_file=True, test_prod_coupling=True, has_test_changes=False, language=21 / 23, position=0, commit_lines=32)
    kinds = [e["evidence_type"] for e in full["evidence"]]
    assert kinds == ["lines_changed", "hunk_count", "function_churn", "class_churn", "import_churn", "file_status", "indentation", "hunk_size",
                     "test_file", "test_coupling", "no_test_changes", "change_concentration", "language", "b1_ranking"]
    text = {e["evidence_type"]: e["description"] for e in full["evidence"]}
    assert text["indentation"] == "Average changed-line indentation: 0.2 spaces, max: 4 spaces"
    assert text["change_concentration"].startswith("File accounts for 12%") and text["language"] == "File language: markdown"
    assert full["why"].endswith("; This is a test file; No test files changed in this commit; Both test and production files changed in this commit.")


def test_binary_files_are_told_apart(spark):
    r = described(spark, is_binary=True, status="binary", band="low")
    assert r["why"].startswith("Binary file: no") and r["gaps"] == ["Binary file: no B1 ranking score assigned"]


def test_history_entries(spark):
    df = spark.createDataFrame(
        [(1, True, True, 0, 0, None, True), (2, True, False, 0, 0, None, True), (3, True, True, 2, 1, 7, False), (4, False, True, 2, 1, 7, False)],
        "i int, eligible boolean, has_parent boolean, recent_commits long, recent_bug_fixes long, days_since_last_change long, history_unavailable boolean")
    got = {r["i"]: [e["evidence_type"] for e in r["history"]] for r in E.historical_evidence(df).collect()}
    assert got == {1: ["history_unavailable"], 2: ["root_commit"], 3: ["recent_commits", "recent_bug_fixes", "days_since_last_change"], 4: []}


def test_primary_language_takes_the_last_file(spark):
    rows = [("c", 0, "go", 50), ("c", 1, "go", 2), ("c", 2, "rust", 2), ("c", 3, "java", 1), ("z", 0, "go", 0)]
    df = spark.createDataFrame([(*r[:3], r[3], 0) for r in rows], "g string, seq int, language_name string, lines_added long, lines_deleted long")
    for c in ("hunk_count", "function_declarations_added", "function_declarations_deleted", "class_declarations_added", "class_declarations_deleted", "imports_added", "imports_deleted", "indent_sum", "indent_lines", "max_changed_line_indent"):
        df = df.withColumn(c, F.lit(0).cast("long"))
    df = df.withColumn("status", F.lit("modified")).withColumn("is_test_file", F.col("seq") == 3)
    got = {r["g"]: r for r in X.commit_features(df, ["g"], ["seq"]).collect()}
    assert got["c"]["primary_name"] == "go" and got["c"]["languages_touched"] == 3 and got["c"]["test_prod_coupling"]
    want = -sum(x / 55 * math.log2(x / 55) for x in (50, 2, 2, 1))
    assert got["c"]["change_entropy"] == pytest.approx(want) and got["z"]["change_entropy"] == 0.0


def test_texts_of_entries_are_as_format_string_says_them(spark):
    values = [(0, 0.0), (7, 12.5), (-3, -0.1), (None, None), (10**12, 1.5e9), (1, float("nan")), (2, float("inf"))]
    df = spark.createDataFrame(values, "n long, x double")
    template = "%d of %s is %.1f at %.0f%%"
    cells = (F.col("n"), F.col("n"), F.col("x"), F.bround("x", 0))
    rows = df.select(E._text(template, *cells).alias("a"), F.format_string(template, *cells).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_evidence_meets_the_past_of_files_on_one_side_only(spark):
    fact = dict(lines_added=3, lines_deleted=1, hunk_count=1, function_declarations_added=0, function_declarations_deleted=0,
                class_declarations_added=0, class_declarations_deleted=0, imports_added=0, imports_deleted=0, status="modified",
                is_binary=False, max_changed_line_indent=0, avg_changed_line_indent=0.0, avg_hunk_size=0.0, is_test_file=True,
                test_prod_coupling=False, has_test_changes=True, commit_lines=4, language=0.0, position=None)
    facts = spark.range(1, 3).select(F.col("id").alias("f"), *[F.lit(v).alias(k) for k, v in fact.items() if k != "position"],
                                     F.lit(None).cast("long").alias("position"))
    past = spark.range(2, 4).select(F.col("id").alias("f"), F.lit(True).alias("eligible"), F.lit(False).alias("has_parent"),
                                    F.lit(0).alias("recent_commits"), F.lit(0).alias("recent_bug_fixes"),
                                    F.lit(None).cast("long").alias("days_since_last_change"), F.lit(True).alias("history_unavailable"))

    def kinds(df):
        return {r.f: [e.evidence_type for e in r.evidence] for r in df.collect()}

    own, root = ["lines_changed", "test_file", "change_concentration"], ["root_commit"]
    assert kinds(E.merge_evidence(facts, past, ["f"])) == {1: own, 2: own + root, 3: root}
    assert kinds(E.investigation_view(facts, past, ["f"])) == {1: own, 2: own + root}


def test_touches_are_their_own_candidates(spark, capsys):
    day = F.timestamp_seconds(F.floor(F.col("id") / 3) * 43200)
    t = spark.range(400).select(
        F.lit("r").alias("repo"), (F.col("id") % 2).alias("path"), day.alias("day"), F.col("id").alias("cid"), day.alias("ts"), day.alias("committed"),
        (F.col("id") % 3 == 0).alias("loose_fix"))
    keys, pos = ["repo", "path"], ["day", "cid"]
    spark.conf.set("patchsieve.sliceRows", "40")
    try:
        want = sorted(H.recent_history(t, t, keys, pos, distinct=True).collect())
        got = H.recent_history_of_touches(t, keys, pos)
        assert sorted(got.collect()) == want and len(want) == 400
        got.explain()
    finally:
        spark.conf.unset("patchsieve.sliceRows")
    assert "Union" not in capsys.readouterr().out


def test_recent_history_of_the_lines_reads_a_touch_once(spark, capsys):
    from patchsieve.plans.catalog import QUERIES

    QUERIES["merge_evidence"](spark, "/root/testdata/sf0.001").explain()
    assert "Union" not in capsys.readouterr().out
