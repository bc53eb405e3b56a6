import datetime as dt

import pytest
from pyspark.sql import functions as F

from patchsieve.operators import labels as B

A, C = "a" * 12 + "0" * 28, "a" * 12 + "1" * 28
D, E_ = "b" * 40, "c" * 7 + "1" * 33
G = "c" * 7 + "2" * 33


def refs(spark, messages, exclude_self=False):
    known = spark.createDataFrame([(1, s, i) for i, s in enumerate([A, C, D, E_, G])], "repo int, sha string, pos int")
    said = spark.createDataFrame([(1, s, m) for s, m in messages], "repo int, sha string, message string")
    return {r["sha"]: r["resolved"] for r in B.resolve_refs(said, known, ["repo"], exclude_self).collect()}


def test_references(spark):
    got = refs(spark, [
        ("m1", f"fix {D}"), ("m2", "fix " + "b" * 8), ("m3", "fix " + "c" * 7), ("m4", f"{D} and {E_}"),
        ("m5", "fix " + "a" * 12), ("m6", "fix " + "d" * 9), ("m7", f"{D.upper()} again {D[:10]}"), ("m8", f"{D} then " + "c" * 7),
    ])
    # one prefix with two hits spoils the message; a 12 character prefix takes the last change
    assert got == {"m1": D, "m2": D, "m5": C, "m7": D}


def test_a_change_does_not_find_itself(spark):
    assert refs(spark, [(D, f"fix {D}"), (E_, "fix " + "c" * 7)], True) == {E_: G}
    assert refs(spark, [(C, "fix " + "a" * 12)], True) == {C: C}


def changes(spark, rows):
    return spark.createDataFrame(
        [(1, s, i, m, n, f) for i, (s, m, n, f) in enumerate(rows)], "repo int, sha string, pos int, message string, n_files int, is_fix boolean")


def test_reverts(spark):
    c = changes(spark, [
        (A, "Add x", 1, False), (C, "Add x", 1, False), (D, 'Revert "Add x"', 1, False),
        (E_, f"revert {A}", 1, False), (G, f"Revert {A[:20]}", 1, False), ("d" * 40, "reverts nothing", 1, False)])
    assert {r["reverted"]: r["reverting"] for r in B.revert_map(c, ["repo"]).collect()} == {C: D, A: G}


def test_oversized_fixes_count_for_nothing(spark):
    c = changes(spark, [(A, "x", 1, False), (D, f"fix {A}", 21, True), (E_, f"fix {A}", 20, True)])
    assert [(r["sha"], r["cause"]) for r in B.explicit_attribution(c, ["repo"]).collect()] == [(A, E_)]


def ambiguous(spark, ages, fixes, paths=None, window=200):
    day = dt.datetime(2020, 1, 1)
    ch = spark.createDataFrame(
        [(1, i, None if a is None else day + dt.timedelta(days=a)) for i, a in enumerate(ages)], "repo int, pos int, ts timestamp")
    files = spark.createDataFrame(
        [(1, i, (paths or {}).get(i, "p"), i in fixes) for i in range(len(ages))], "repo int, pos int, path string, is_fix boolean")
    return sorted(r["pos"] for r in B.ambiguous_evidence(files, ch, ["repo"], window=window).collect())


def test_window_and_gap(spark):
    assert ambiguous(spark, [0, 10, 90], {2}) == [0, 1]
    assert ambiguous(spark, [0, 10, 91], {2}) == [1]
    # the first too young change ends the scan although the fix itself is near
    assert ambiguous(spark, [0, 200, 5], {2}) == [1]
    # an old clock before the candidate does not end it
    assert ambiguous(spark, [500, 0, 5], {2}) == [0, 1]
    assert ambiguous(spark, [0, None, 5], {2}) == [0, 1]
    assert ambiguous(spark, [None, 400, 500], {2}) == [0]
    assert ambiguous(spark, [0, 1, 2, 3], {3}, window=2) == [1, 2]
    assert ambiguous(spark, [0, 1, 2], {2}, {0: "other"}) == [1]


def test_window_matches_a_plain_scan(spark):
    import random

    rnd = random.Random(3)
    ages = [rnd.choice([None, *range(0, 300, 7)]) for _ in range(120)]
    fixes = {i for i in range(120) if rnd.random() < 0.2}
    paths = {i: rnd.choice("abc") for i in range(120)}
    want = []
    for i in range(120):
        for j in range(i + 1, min(i + 13, 120)):
            if ages[i] is not None and ages[j] is not None and ages[j] - ages[i] > 90:
                break
            if j in fixes and paths[i] == paths[j]:
                want.append(i)
                break
    assert ambiguous(spark, ages, fixes, paths, window=12) == want


def test_precedence(spark):
    files = spark.createDataFrame([(1, s, p) for s in "abcde" for p in ("x", "y")], "repo int, sha string, path string")
    ch = spark.createDataFrame([(1, s, i) for i, s in enumerate("abcde")], "repo int, sha string, pos int")
    cause = lambda *s: spark.createDataFrame([(1, x, "f") for x in s], "repo int, sha string, cause string")
    overlap = spark.createDataFrame([(1, s, "x", "f") for s in "ac"], "repo int, sha string, path string, cause string")
    amb = spark.createDataFrame([(1, i) for i in (0, 2, 3)], "repo int, pos int")
    out = B.merge_labels(files, ch, ["repo"], cause("a"), cause("b"), overlap, amb).collect()
    got = {(r["sha"], r["path"]): (r["label_source"], r["defect_label"], r["label_confidence"]) for r in out}
    assert got["a", "x"] == ("explicit_sha_reference", 1, 1.0) and got["b", "y"] == ("revert", 1, 1.0)
    assert got["c", "x"] == got["c", "y"] == ("line_overlap", 1, 0.7)
    assert got["d", "x"] == ("ambiguous", -1, 0.0) and got["e", "x"] == ("none", 0, 0.0)


def test_line_overlap(spark):
    hunks = spark.createDataFrame(
        [(1, "c", 1, "p", 0, 5, 3), (1, "f", 2, "p", 0, 6, 2), (1, "late", 3, "p", 0, 5, 3)],
        "repo int, sha string, pos int, path string, hunk int, old_start int, old_count int")
    fixes = spark.createDataFrame([(1, "f", 1, 3)], "repo int, sha string, n_files int, n_lines int")
    added = spark.createDataFrame([(1, "f", "p", 0, 8, "two\n")], "repo int, sha string, path string, hunk int, at int, text string")
    none = spark.createDataFrame([], "repo int, sha string")
    def run(line_no, text):
        parent = spark.createDataFrame([(1, "c", "p", line_no, text)], "repo int, sha string, path string, line_no int, text string")
        return [(r["sha"], r["cause"]) for r in B.line_overlap_attribution(hunks, fixes, added, parent, none, ["repo"]).collect()]
    assert run(8, "two") == [("c", "f")]  # the ends of the region are included
    assert run(9, "two") == [] and run(8, "three") == []


def test_splits(spark):
    df = spark.createDataFrame([(i, None if i == 9 else dt.datetime(2020, 1, 1 + i)) for i in range(10)], "sha int, ts timestamp").withColumn("repo", F.lit("r"))
    got = {r["sha"]: r["split"] for r in B.global_chrono_split(df, "ts", "repo", "sha").collect()}
    assert got[9] == "train" and [got[i] for i in (5, 6, 7, 8)] == ["train", "validation", "test", "test"]
    table = spark.createDataFrame([("other", "train")], "repo string, split string")
    with pytest.raises(Exception, match="no split for repository"):
        B.split_by_lookup(df, table, "repo").collect()


def test_line_overlap_with_a_line_that_is_everywhere(spark):
    """A hundred thousand blank lines on both sides: no line is paired with another."""
    n = 100_000
    hunks = spark.createDataFrame([(1, "c", 1, "p", 0, 0, n), (1, "f", 2, "p", 0, 0, n), (1, "d", 1, "q", 0, 0, n), (1, "f", 2, "q", 0, 0, n)],
                                  "repo int, sha string, pos int, path string, hunk int, old_start int, old_count int")
    fixes = spark.createDataFrame([(1, "f", 2, 9)], "repo int, sha string, n_files int, n_lines int")
    lines = spark.range(n).select(F.lit(1).alias("repo"), F.col("id").cast("int").alias("at"), F.when(F.col("id") == 7, "seven").otherwise("\n").alias("text"))
    added = lines.withColumn("path", F.explode(F.array(F.lit("p"), F.lit("q")))).select("repo", F.lit("f").alias("sha"), "path", F.lit(0).alias("hunk"), "at", "text")
    parent = lines.select("repo", F.lit("c").alias("sha"), F.lit("p").alias("path"), F.col("at").alias("line_no"), "text").unionByName(
        lines.where("at <> 7").select("repo", F.lit("d").alias("sha"), F.lit("q").alias("path"), F.col("at").alias("line_no"), "text"))
    none = spark.createDataFrame([], "repo int, sha string")
    out = B.line_overlap_attribution(hunks, fixes, added, parent, none, ["repo"])
    # the file d lacks one of the lines that the fix adds
    assert [(r["sha"], r["path"], r["cause"]) for r in out.collect()] == [("c", "p", "f")]


def test_messages_are_not_shuffled_to_their_position(spark, capsys):
    from patchsieve.plans.labels import changes as document_changes
    from patchsieve.plans.registry import Tables

    rows = document_changes(Tables(spark, "/root/testdata/sf0.001"))
    B.active_fixes(rows).select("sha", "pos", *[c for c in ("message", "tokens", "title", "quoted") if c in rows.columns]).explain()
    shuffled = [line for line in capsys.readouterr().out.splitlines() if "Exchange" in line or "Join" in line or "Sort" in line]
    assert shuffled and "message" not in rows.columns and not any("message#" in line or "text#" in line for line in shuffled)


def test_what_is_read_off_a_message_stands_for_it(spark):
    c = changes(spark, [
        (A, "Add x", 1, False), (D, f"fix {A}", 2, True), (E_, 'Revert "Add x"', 3, False)])
    read = c.withColumns(B.said(F.col("message"))).drop("message")
    for rule in (B.revert_map, B.explicit_attribution):
        want = rule(c, ["repo"]).collect()
        assert want and rule(read, ["repo"]).collect() == want


def test_lines_before_a_change_are_asked_for_by_file(spark):
    """A function gives the lines of the files that have a pair; nothing is asked of the others."""
    hunks = spark.createDataFrame(
        [(1, "c", 1, "p", 0, 5, 3), (1, "f", 2, "p", 0, 6, 2), (1, "other", 1, "q", 0, 5, 3)],
        "repo int, sha string, pos int, path string, hunk int, old_start int, old_count int")
    fixes = spark.createDataFrame([(1, "f", 1, 3)], "repo int, sha string, n_files int, n_lines int")
    added = spark.createDataFrame([(1, "f", "p", 0, 8, "two\n"), (1, "f", "p", 0, 7, None)], "repo int, sha string, path string, hunk int, at int, text string")
    lines = spark.createDataFrame([(1, "c", "p", 8, "two"), (1, "other", "q", 8, "two")], "repo int, sha string, path string, line_no int, text string")
    none = spark.createDataFrame([], "repo int, sha string")
    asked = []

    def parent(wanted):
        asked.extend((r["sha"], r["path"]) for r in wanted.collect())
        return lines.join(wanted, ["repo", "sha", "path"], "left_semi")

    for before in (lines, parent):
        out = B.line_overlap_attribution(hunks, fixes, added, before, none, ["repo"]).collect()
        assert [(r["sha"], r["path"], r["cause"]) for r in out] == [("c", "p", "f")]
    assert asked == [("c", "p")]


def test_changes_are_numbered_once_for_their_hunks(spark, capsys):
    """Hunks are read from where they were written: what is made of them numbers no change again."""
    from patchsieve.plans.labels import hunk_tables
    from patchsieve.plans.registry import Tables

    hunks, fixes, added, *_ = hunk_tables(Tables(spark, "/root/testdata/sf0.001"))
    for table in (hunks, fixes, added):
        table.explain()
    assert "Window" not in capsys.readouterr().out
