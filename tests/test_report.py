import random

import pytest
from pyspark.sql import functions as F

from patchsieve.operators import attribution as A
from patchsieve.operators import report as R

OURS, THEIRS, LOST = "a" * 40, "b" * 40, "c" * 40


def greedy(left, right):
    """The plain rule: every left line looks at every right line that is free."""
    used, out = set(), []
    for line in left:
        best, pick = 0, None
        for other in right:
            x, y = set(line.split()), set(other.split())
            if other in used or not x or not y:
                continue
            share = len(x & y) / len(x | y)
            if share > best and share > 0.3:
                best, pick = share, other
        if pick:
            out.append((line, pick, round(best, 4)))
            used.add(pick)
    return out


def test_pairs_of_lines_follow_the_plain_rule():
    rng = random.Random(2)
    for _ in range(400):
        side = lambda: sorted({" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 9))) for _ in range(12)})
        a, b = side(), side()
        left, right = [x for x in a if x not in b], [x for x in b if x not in a]
        assert A._pair_lines(left, right) == greedy(left, right)


def test_pairs_of_long_files_with_a_common_token():
    left = [f"x{n} y{n} common" for n in range(20_000)]
    right = [f"x{n} z{n} common" for n in range(20_000)]
    assert len(A._pair_lines(left, right)) == 20_000


def lines_of(spans):
    return {n for start, stop in spans for n in range(start, stop)}


def test_shared_lines_are_those_of_the_sets(spark):
    rng = random.Random(4)
    side = lambda: [(s := rng.randrange(30), s + rng.randrange(6)) for _ in range(rng.randrange(4))]
    rows = [(n, side(), side()) for n in range(300)]
    rows = [(n, [x for x in a if x[0] < x[1]], [x for x in b if x[0] < x[1]]) for n, a, b in rows]
    kind = "array<struct<start:bigint,stop:bigint>>"
    df = spark.createDataFrame(rows, f"n int, a {kind}, b {kind}")
    for r in df.select("n", R.shared_lines(F.col("a"), F.col("b")).alias("s")).collect():
        both = lines_of(rows[r.n][1]) & lines_of(rows[r.n][2])
        assert (r.s.lines, r.s.first, r.s.last) == (len(both), min(both, default=None), max(both, default=None))
    hunks = [(n, c, s, e - s) for n, a, b in rows for c, spans in ((True, a), (False, b)) for s, e in spans]
    swept = A.region_overlap(spark.createDataFrame(hunks, "n int, is_candidate boolean, new_start int, new_count int"), ["n"])
    for r in swept.collect():
        a, b = (lines_of(rows[r.n][i]) for i in (1, 2))
        assert (r.overlap_lines, r.overlap_start, r.overlap_end, r.overlap_exists) == (len(a & b), min(a & b, default=None), max(a & b, default=None), bool(a & b))
        assert (r.candidate_start, r.candidate_end, r.corrective_start, r.corrective_end) == (min(a, default=None), max(a, default=None), min(b, default=None), max(b, default=None))


def test_a_region_of_many_lines_is_two_events(spark):
    hunks = [(1, True, 0, 2_000_000_000), (1, False, 1_000_000_000, 2_000_000_000), (1, True, 5, 0)]
    r = A.region_overlap(spark.createDataFrame(hunks, "n int, is_candidate boolean, new_start long, new_count long"), ["n"]).first()
    assert (r.overlap_lines, r.overlap_start, r.overlap_end) == (1_000_000_000, 1_000_000_000, 1_999_999_999)


def report(spark):
    """One change with a file for each case, corrected by another one."""
    positives = spark.createDataFrame([(OURS, "revert", f"reverted by {THEIRS[:10]}"), (LOST, "line_overlap", "lines"), ], "sha string, label_source string, label_evidence string")
    files = [  # path, old path, before, after of the change; path, old path, before, after of its correction
        ("same.py", "", "x\n", "x\ny\n", "same.py", "", "x\ny\n", "x  \n"),
        ("exact.py", "", "x\n", "x\nnew line\n", "exact.py", "", "x\nnew line\nz", "x\nz\nq"),
        ("weak.py", "", "x", "x\ny", "weak.py", "", "x\ny", "x\ny\nz"),
        ("dir/moved.py", "", "x", "x\ny", "other/moved.py", "", "y", "x"),
        ("lib/old.py", "", "x", "y", "lib/new.py", "old.py", "x", "y"),
        ("partial.py", "", "", "one two three four\n", "partial.py", "", "one two three five", "x"),
        ("unlisted.py", "", "x", "y", "unlisted.py", "", "y", "x"),
        ("nothing.py", "", "x", "y", "else.py", "", "y", "x"),
        ("gone.py", "", "x", None, "gone.py", "", None, "x"),
    ]
    rows = []
    for n, (p, old, b, a, q, q_old, rb, ra) in enumerate(files):
        rows += [(OURS, p, old, n, b, a), (THEIRS, q, q_old, n, rb, ra)]
    rows.append((LOST, "lost.py", "", 0, "x", "y"))
    diffs = spark.createDataFrame(rows, "sha string, path string, old_path string, seq int, before string, after string")
    listed = diffs.where(f"NOT (path = 'unlisted.py' AND sha = '{THEIRS}')")
    hunks = spark.createDataFrame([(OURS, "weak.py", 1, 5), (THEIRS, "weak.py", 4, 9), (OURS, "same.py", 1, 1), (THEIRS, "same.py", 9, 1)], "sha string, path string, new_start int, new_count int")
    functions = spark.createDataFrame([(OURS, "exact.py", "f", 1, 2), (OURS, "exact.py", "a", 1, 1), (THEIRS, "exact.py", "f", 1, 9), (THEIRS, "exact.py", "a", 1, 1),
                                       (OURS, "partial.py", "g", 1, 1), (THEIRS, "partial.py", "g", 1, 1), (OURS, "weak.py", "h", 1, 2)], "sha string, path string, name string, start int, end int")
    links = R.corrective_links(positives, diffs)
    return links, R.file_report(links, diffs, listed, diffs, hunks, functions), listed


def test_every_case_of_a_file(spark):
    _, files, _ = report(spark)
    got = {r.path: r for r in files.collect()}
    assert len(got) == 10 and all(r.sha in (OURS, LOST) for r in got.values())
    assert {p: r.method for p, r in got.items()} == {
        "same.py": "exact_path", "exact.py": "exact_path", "weak.py": "exact_path", "dir/moved.py": "path_transform", "lib/old.py": "git_rename",
        "partial.py": "exact_path", "unlisted.py": "exact_path", "nothing.py": "none", "gone.py": "exact_path", "lost.py": "none"}
    assert {p: r.level for p, r in got.items()} == {
        "same.py": A.STRONG, "exact.py": A.STRONG, "weak.py": A.WEAK, "dir/moved.py": A.STRONG, "lib/old.py": A.WEAK, "partial.py": A.WEAK,
        "unlisted.py": A.UNKNOWN, "nothing.py": A.UNKNOWN, "gone.py": A.STRONG, "lost.py": A.UNKNOWN}
    assert got["same.py"].evidence_types == ["CONTENT_RESTORATION", "EXACT_CANDIDATE_CONTENT_REMOVAL"] and got["same.py"].line_diff_count == 0
    e = got["exact.py"]
    assert e.exact_match_count == 1 and e.exact_match_ratio == 1.0 and e.function_name == "a" and e.same_function and not e.structural_relationship
    assert e.rationale == "Exact candidate-content removal: 1 lines matched" and e.line_diff_count == 2
    w = got["weak.py"]
    assert (w.overlap_lines, w.overlap_start, w.overlap_end) == (2, 4, 5) and w.evidence_types == ["SAME_REGION_OVERLAP"] and not w.same_function
    p = got["partial.py"]
    assert (p.partial_match_count, p.correspondence_type, p.function_name) == (1, "partial_overlap", "g") and p.evidence_types == ["SAME_FUNCTION_CANDIDATE_CONTENT"]
    u = got["unlisted.py"]
    assert u.corrective_path == "unlisted.py" and u.evidence_types == [] and u.exact_match_count is None and "not in corrective commit" in u.rationale
    assert got["gone.py"].restored and got["gone.py"].exact_match_count == 0
    assert got["nothing.py"].rationale == got["lost.py"].rationale == "File identity not established"


@pytest.fixture
def listed_with_context(spark):
    links, files, listed = report(spark)
    return links, files, listed.select("sha", "path", F.lit("modified").alias("status"), (F.col("path") == "weak.py").cast("double").alias("test_flag"))


def test_change_rows_and_their_nested_form(spark, listed_with_context):
    links, files, listed = listed_with_context
    vectors = spark.createDataFrame([(OURS, [1.0, 0.0]), (THEIRS, [1.0, 1.0]), (THEIRS, [1.0])], "sha string, vector array<double>")
    changes = R.change_report(links, listed, vectors, 2)
    got = {r.sha: r for r in R.nested_report(changes, files).collect()}
    ours, lost = got[OURS], got[LOST]
    assert (ours.commit_evidence_level, lost.commit_evidence_level) == (A.COMMIT_STRONG, A.COMMIT_NONE)
    assert (ours.corrective, ours.chain_depth, ours.cosine_similarity, ours.has_both) == (THEIRS, 1, 0.707107, True)
    assert len(ours.file_results) == 9 and ours.unknown_files == ["nothing.py", "unlisted.py"] and [f.path for f in ours.file_results] == sorted(f.path for f in ours.file_results)
    assert (ours.candidate_files, ours.corrective_files, ours.overlap_files, ours.category) == (9, 8, 5, A.PARTIAL) and lost.category == A.NO_ATTRIBUTION
    assert lost.unknown_files == ["lost.py"]
