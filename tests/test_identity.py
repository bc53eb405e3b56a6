"""Identity of candidate files against the plain rule, file by file."""

import pytest

from patchsieve.operators import attribution as A


def plain(links, files):
    """The rule as loops: (sha, path) -> (method, corrective path)."""
    out = {}
    for sha, corrective in links:
        own = [f for f in files if f[0] == sha]
        theirs = sorted((f[3], f[1], f[2]) for f in files if f[0] == corrective)
        name = lambda p: p.split("/")[-1]
        for path in {f[1] for f in own}:
            last = max((f[3], f[1]) for f in own if name(f[1]) == name(path))[1]
            renamed = [p for _, p, old in theirs if old and path.endswith(old)]
            moved = [p for _, p, _ in theirs if name(p) == name(path) and p != path]
            if any(p == path for _, p, _ in theirs):
                out[sha, path] = ("exact_path", path)
            elif renamed:
                out[sha, path] = ("git_rename", renamed[0])
            elif moved and last == path:
                out[sha, path] = ("path_transform", moved[0])
            else:
                out[sha, path] = ("none", None)
    return out


@pytest.mark.parametrize("at_once", [2, 1_000])
def test_identity_of_many_changes_with_one_correction(spark, monkeypatch, at_once):
    """Twelve changes are corrected by one, in blocks of its links; a chain, a change of its own, and one that nothing corrects."""
    monkeypatch.setattr(A, "_LINKS_AT_ONCE", at_once)
    files = []
    for sha in range(1, 13):
        for i in range(4):
            folder = ("a", "b/c", "moved", "")[(sha + i) % 4]
            files.append((sha, f"{folder}/f{(sha * i) % 5}.py".lstrip("/"), "", i))
            files.append((sha, f"x{sha % 3}/f{i}.py", "", 10 + i))
    files += [(100, "a/f1.py", "", 3), (100, "new/f2.py", "f2.py", 2), (100, "newer/f2.py", "c/f2.py", 1), (100, "z/f3.py", "", 5),
              (100, "y/f3.py", "x1/f4.py", 5), (100, "f0.py", "", 0), (100, "b/c/f0.py", "", 9), (100, "a/f1.py", "other.py", 8), (200, "a/f1.py", "a/f1.py", 0)]
    links = [(sha, 100) for sha in range(1, 13)] + [(100, 200), (200, None)]
    got = A.file_identity(spark.createDataFrame(links, "sha long, corrective long"),
                          spark.createDataFrame(files, "sha long, path string, old_path string, seq long")).collect()
    want = plain(links, files)
    assert {m for m, _ in want.values()} == {"exact_path", "git_rename", "path_transform", "none"}
    assert len(got) == len(want) and {(r.sha, r.path): (r.method, r.corrective_path) for r in got} == want


def test_paths_are_not_joined_one_rule_after_another(spark, capsys):
    """Candidates and corrective files meet in one exchange; no join goes by a path."""
    from patchsieve.plans.attribution import report
    from patchsieve.plans.registry import Tables

    report(Tables(spark, "/root/testdata/sf0.001")).explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join [" in line]
    assert joins and not any("path#" in line or "hash#" in line for line in joins)


def test_both_sides_of_a_function_go_through_one_pass(spark, monkeypatch):
    passes = []
    looked_up = A.ranges_with_line
    monkeypatch.setattr(A, "ranges_with_line", lambda *a: passes.append(a) or looked_up(*a))
    ranges = spark.createDataFrame([(1, "f", 1, 5), (1, "g", 8, 9)], "file int, name string, start int, end int")
    lines = spark.createDataFrame([(1, 9)], "file int, line int")
    r = A.same_function(ranges, lines, ranges.where("name = 'g'"), lines, ["file"]).collect()
    assert [(x.parsed, x.function_name, x.same_function, x.structural_relationship) for x in r] == [(True, "g", True, True)]
    assert len(passes) == 1
