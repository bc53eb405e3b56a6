from pyspark.sql import functions as F

from patchsieve.functions import lines as L
from patchsieve.functions import messages as M
from patchsieve.functions import paths as P
from patchsieve.operators import diffs as D

MODIFIED = """diff --git a/src/a b.py b/src/a b.py
index 1..2 100644
--- a/src/a b.py
+++ b/src/a b.py
@@ -1,3 +1,4 @@ def top():
 keep
-def old(x):
+def new(x):
+    import os
 end
@@ -10 +11,2 @@
-gone
+++ counted as a header, not as a line
\\ No newline at end of file
"""
ADDED = "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+x = 1\n"
DELETED = "diff --git a/d.py b/d.py\n--- a/d.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x = 1\n"
RENAMED = "diff --git a/o.py b/p.py\nsimilarity index 100%\nrename from o.py\nrename to p.py\n"
BINARY = "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"
NEW_BINARY = "diff --git a/j.png b/j.png\nBinary files /dev/null and b/j.png differ\n"
PATCH = "diff --git a/k.bin b/k.bin\nGIT binary patch\nliteral 3\n"
DASHES = "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,2 +1 @@\n--- old comment\n-x\n"


def table(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "g int, diff_text string")


def headers(spark, *texts):
    rows = D.file_header(D.split_files(table(spark, *texts), ["g"], "diff_text")).collect()
    return {r["g"]: (r["path"], r["old_path"], r["status"], r["is_binary"]) for r in rows}


def test_headers(spark):
    got = headers(spark, MODIFIED, ADDED, DELETED, RENAMED, BINARY, NEW_BINARY, PATCH, "", "  \n")
    assert got[1] == ("n.py", "n.py", "added", False)
    assert got[2] == ("d.py", "d.py", "deleted", False)
    assert got[3] == ("p.py", "o.py", "renamed", False)
    assert got[4] == ("i.png", "i.png", "binary", True)
    assert got[5][0] == "/dev/null" and got[5][3]
    assert got[6] == ("k.bin", "k.bin", "binary", True)
    assert 7 not in got and 8 not in got


def test_hunk_body_lines_can_look_like_headers(spark):
    got = headers(spark, DASHES, MODIFIED)
    assert got[0][1] == "old comment"
    assert got[1][0] == "counted as a header, not as a line"


def test_sections_keep_their_order(spark):
    rows = D.split_files(table(spark, ADDED + DELETED + RENAMED), ["g"], "diff_text").orderBy("file_seq").collect()
    assert [r["section"].split()[2] for r in rows] == ["a/n.py", "a/d.py", "a/o.py"]


def test_hunks_and_lines(spark):
    sections = D.split_files(table(spark, MODIFIED), ["g"], "diff_text")
    hunks = D.hunks(sections, ["g"])
    got = [tuple(r)[1:6] for r in hunks.orderBy("hunk_seq").collect()]
    assert [x[:5] for x in got] == [(0, 1, 3, 1, 4), (1, 10, 1, 11, 2)]
    lines = {(r["kind"], r["text"]) for r in D.changed_lines(hunks, ["g"]).collect()}
    assert lines == {("deleted", "def old(x):"), ("added", "def new(x):"), ("added", "    import os"), ("deleted", "gone")}
    places = {(r["hunk_seq"], r["kind"], r["line"]) for r in D.line_coordinates(hunks, ["g"]).collect()}
    # the rest of the header line counts as a context line
    assert places == {(0, "deleted", 3), (0, "added", 3), (0, "added", 4), (1, "deleted", 11)}


def test_file_features(spark):
    r = D.file_features(D.split_files(table(spark, MODIFIED), ["g"], "diff_text"), ["g"]).first()
    assert (r["lines_added"], r["lines_deleted"], r["hunk_count"]) == (2, 2, 2)
    assert (r["function_declarations_added"], r["function_declarations_deleted"], r["imports_added"]) == (1, 1, 1)
    assert (r["max_changed_line_indent"], r["avg_changed_line_indent"], r["avg_hunk_size"]) == (4, 1.0, 5.0)


def test_range_hits(spark):
    ranges = spark.createDataFrame([
        (1, "new", "function", 1, 4), (1, "new", "function", 6, 7), (1, "old", "function", 2, 2),
        (1, "new", "try", 3, 9), (1, "old", "try", 3, 9), (1, "old", "try", 20, 30), (2, "new", "try", 1, 5),
    ], "f int, side string, kind string, start int, end int")
    lines = spark.createDataFrame([(1, "added", 4), (1, "deleted", 9), (2, "deleted", 3)], "f int, kind string, line int")
    sides = spark.createDataFrame(
        [(1, True, True, True), (2, False, True, True), (3, True, True, False)], "f int, has_old boolean, has_new boolean, eligible boolean")
    got = {r["f"]: tuple(r)[1:] for r in D.range_hits(ranges, lines, sides, ["f"]).collect()}
    assert got == {1: (1, 0, 1), 2: (0, 0, 0), 3: (0, 0, 0)}


def test_paths(spark):
    paths = ["a/b.PY", ".bashrc", "x/.hidden.rs", "Makefile", "a.tar.gz", "src/test_x.c", "my_tests/x.c", "tests/x.c", "a_test.go", "test_x.y z"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(
        "p", P.language(F.col("p")).alias("l"), P.is_test_file(F.col("p")).alias("t"), P.stem(F.col("p")).alias("s")).collect()
    got = {r["p"]: (r["l"], r["t"]) for r in rows}
    assert got["a/b.PY"] == ("python", False) and got[".bashrc"][0] == "unknown" and got["x/.hidden.rs"][0] == "rust"
    assert got["a.tar.gz"][0] == "unknown" and got["src/test_x.c"][1] and not got["my_tests/x.c"][1]
    assert got["tests/x.c"][1] and got["a_test.go"][1] and got["test_x.y z"][1]
    stems = {r["p"]: r["s"] for r in rows}
    assert stems[".bashrc"] == ".bashrc" and stems["a.tar.gz"] == "a.tar"


def test_language_index_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in P.LANGUAGES], "l string")
    assert df.where(P.language_name(P.language_index(F.col("l"))) != F.col("l")).count() == 0


def test_messages(spark):
    said = [("Fixes #1", 3), ("prefix", 3), ("fix it", 0), ("   ", 3), ("HOTFIX now", 1)]
    rows = spark.createDataFrame(said, "m string, n int").select(
        M.is_bug_fix(F.col("m"), F.col("n")).alias("a"), M.is_bug_fix_loose(F.col("m")).alias("b")).collect()
    assert [r["a"] for r in rows] == [True, False, False, False, True]
    assert [r["b"] for r in rows] == [True, True, True, False, True]


def test_lines_of_all_breaks(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc d\n",), ("",), ("\n",)], "t string")
    assert [r[0] for r in df.select(L.text_lines(F.col("t"))).collect()] == [["a", "b", "c", "d"], [], [""]]
