"""Unified diff text to tables of files, hunks and changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchsieve.functions import lines as L
from patchsieve.functions import paths as P
from patchsieve.functions.messages import stripped
from patchsieve.operators.frames import frame

HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"  # fixed value: hunk header
NAMES = r"(?mdU)^diff\s+--git\s+a/(.+?)\s+b/(.+)$"  # fixed value: section header
NO_FILE = "/dev/null"


def split_files(diffs: DataFrame, group: list[str], text: str) -> DataFrame:
    """One row per file section, in input order."""
    parts = F.posexplode(F.split(F.col(text), r"(?md)(?=^diff --git )", -1)).alias("file_seq", "section")
    out = diffs.where(stripped(F.col(text)) != "").select(*group, parts)
    return out.withColumn("section", stripped(F.col("section"))).where(
        F.startswith("section", F.lit("diff --git"))
    )


def _cut_path(value: Column, prefix: str) -> Column:
    return F.regexp_replace(F.substring_index(value, "\t", 1), f"^{prefix}/", "")


def _last(marks: Column, keep) -> Column:
    """Value of the last entry for which ``keep`` gives a non-null value."""
    return F.try_element_at(
        F.filter(F.transform(marks, keep), lambda v: v.isNotNull()), F.lit(-1)
    )


def file_header(sections: DataFrame) -> DataFrame:
    """Path, old path, status and binary flag; the last marker line wins.

    The scan covers hunk bodies too, so a removed line that begins with ``-- ``
    is read as a header line. A binary path is the first of the two names.
    """
    after = lambda x, n: F.substring(x, n + 1, 2147483647)
    starts = lambda x, p: F.startswith(x, F.lit(p))

    def binary(x):
        return starts(x, "Binary files")

    def status_of(x):
        return (
            F.when(binary(x) | (x == "GIT binary patch"), "binary")
            .when(x == "--- " + NO_FILE, "added")
            .when(x == "+++ " + NO_FILE, "deleted")
            .when(x.rlike("^rename from ."), "renamed")
        )

    def path_of(x):
        first = F.regexp_extract(x, r"^Binary files (.+) and (.+) differ", 1)
        return (
            F.when(binary(x) & (first != ""), F.regexp_replace(first, "^a/", ""))
            .when(starts(x, "+++ ") & (x != "+++ " + NO_FILE), _cut_path(after(x, 4), "b"))
            .when(x.rlike("^rename to ."), after(x, 10))
        )

    def old_path_of(x):
        return (
            F.when(starts(x, "--- ") & (x != "--- " + NO_FILE), _cut_path(after(x, 4), "a"))
            .when(x.rlike("^rename from ."), after(x, 12))
        )

    marks = F.filter(
        L.text_lines(F.col("section")),
        lambda x: x.rlike(r"^(Binary files|GIT binary patch$|--- |\+\+\+ |rename from .|rename to .)"),
    )
    given = lambda i: F.nullif(F.regexp_extract("section", NAMES, i), F.lit(""))
    out = sections.withColumn("__marks", marks).select(
        *sections.columns,
        F.coalesce(F.nullif(_last(F.col("__marks"), path_of), F.lit("")), given(2), given(1)).alias("path"),
        F.coalesce(F.nullif(_last(F.col("__marks"), old_path_of), F.lit("")), given(1)).alias("old_path"),
        F.coalesce(_last(F.col("__marks"), status_of), F.lit("modified")).alias("status"),
        F.exists("__marks", lambda x: binary(x) | (x == "GIT binary patch")).alias("is_binary"),
    )
    return out.where(F.col("path").isNotNull() | F.col("is_binary")).withColumn(
        "path", F.coalesce("path", F.lit(""))
    )


def _number(piece: Column, i: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(piece, HUNK, i), F.lit("")), F.lit("1")).cast("int")


def hunk_array(section: Column) -> Column:
    """Hunks of a section as an array of structs; a missing count is 1."""
    pieces = F.filter(
        F.split(section, rf"(?md)(?=^{HUNK})", -1), lambda x: x.rlike("^" + HUNK)
    )
    return F.transform(pieces, lambda x: F.struct(
        _number(x, 1).alias("old_start"), _number(x, 2).alias("old_count"),
        _number(x, 3).alias("new_start"), _number(x, 4).alias("new_count"),
        F.regexp_replace(x, rf"\A{HUNK}[^\n]*", "").alias("content"),
    ))


def hunks(sections: DataFrame, keys: list[str]) -> DataFrame:
    return sections.select(
        *keys, F.posexplode(hunk_array(F.col("section"))).alias("hunk_seq", "h")
    ).select(*keys, "hunk_seq", "h.*")


def body_lines(hunk_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of hunk bodies with their kind. The rest of the header line is line 0."""
    out = hunk_rows.select(
        *keys, "hunk_seq", "old_start", "new_start",
        F.posexplode(L.text_lines(F.col("content"))).alias("line_seq", "raw"),
    )
    kind = F.when(L.is_added(F.col("raw")), "added").when(L.is_deleted(F.col("raw")), "deleted")
    return out.withColumn("kind", kind.otherwise("context"))


def changed_lines(hunk_rows: DataFrame, keys: list[str]) -> DataFrame:
    return body_lines(hunk_rows, keys).where(F.col("kind") != "context").select(
        *keys, "hunk_seq", "line_seq", "kind", F.substring("raw", 2, 2147483647).alias("text")
    )


def line_coordinates(hunk_rows: DataFrame, keys: list[str]) -> DataFrame:
    """New-file numbers of added lines and old-file numbers of deleted ones.

    Every other line moves both counters. That includes the empty line 0 after
    the hunk header, so the first body line has number start + 1. The window is
    one hunk, which came out of a single text value.
    """
    w = Window.partitionBy(*keys, "hunk_seq").orderBy("line_seq").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda other: F.coalesce(F.sum((F.col("kind") != other).cast("int")).over(w), F.lit(0))
    out = body_lines(hunk_rows, keys).select(
        "*",
        F.when(F.col("kind") == "added", F.col("new_start") + moved("deleted"))
        .when(F.col("kind") == "deleted", F.col("old_start") + moved("added")).alias("line"),
    )
    return out.where(F.col("kind") != "context").select(
        *keys, "hunk_seq", "line_seq", "kind", F.col("line").cast("long").alias("line")
    )


def range_hits(ranges: DataFrame, lines: DataFrame, sides: DataFrame, key: list[str]) -> DataFrame:
    """Count ranges that hold at least one changed line.

    ``ranges``  key, side (new/old), kind (function/try), start, end
    ``lines``   key, kind (added/deleted), line
    ``sides``   key, has_old, has_new, eligible (the path is Python and both sides parse)

    Functions are probed with the lines of their own side, try blocks with all
    lines. The nearest line at or after a range's start decides, so ranges and
    lines are merged in one ordered pass and never paired.
    """
    probe = F.when(F.col("kind") == "try", "all").otherwise(F.col("side"))
    nothing = F.lit(None).cast("long")
    spans = ranges.select(
        *key, probe.alias("probe"), F.col("start").cast("long").alias("at"), F.lit(1).alias("is_range"),
        F.col("end").cast("long").alias("end"), "side", "kind", nothing.alias("line"),
    )
    own = F.when(F.col("kind") == "added", "new").otherwise("old")
    marks = lines.select(
        *key, F.explode(F.array(own, F.lit("all"))).alias("probe"), F.col("line").cast("long").alias("line")
    ).distinct().select(
        *key, "probe", F.col("line").alias("at"), F.lit(0).alias("is_range"), nothing.alias("end"),
        F.lit("").alias("side"), F.lit("").alias("kind"), "line",
    )
    nearest = frame(
        spans.unionByName(marks), [*key, "probe"],
        [-F.col("at"), F.col("is_range"), F.col("end"), F.col("side"), F.col("kind")],
        lasts={"nearest": F.col("line")},
    )
    hit = nearest.where((F.col("is_range") == 1) & (F.col("nearest") <= F.col("end")))
    is_try, new = F.col("kind") == "try", F.col("side") == "new"
    # equal try ranges of the two sides count once: pre-aggregated by range
    per_range = hit.groupBy(*key, "kind", "at", "end").agg(
        F.count_if(new).alias("new_n"), F.count_if(~new).alias("old_n")
    )
    counts = per_range.groupBy(*key).agg(
        F.sum(F.when(~is_try, F.col("new_n"))).alias("fn_new"),
        F.sum(F.when(~is_try, F.col("old_n"))).alias("fn_old"),
        F.sum(F.when(is_try, F.col("new_n"))).alias("try_new"),
        F.sum(F.when(is_try, F.col("old_n"))).alias("try_old"),
        F.count_if(is_try).alias("try_either"),
    )
    changed = lines.groupBy(*key).agg(
        F.count_if(F.col("kind") == "added").alias("n_added"),
        F.count_if(F.col("kind") == "deleted").alias("n_deleted"),
    )
    zero = F.lit(0).cast("long")
    n = lambda c: F.coalesce(F.col(c), zero)
    one_side = F.when(F.col("has_new") & (n("n_added") > 0), n("try_new")).otherwise(zero) + F.when(
        F.col("has_old") & (n("n_deleted") > 0), n("try_old")
    ).otherwise(zero)
    ok = F.col("eligible")
    return sides.join(counts, key, "left").join(changed, key, "left").select(
        *key,
        F.when(ok & F.col("has_new"), n("fn_new")).otherwise(zero).alias("function_declarations_added"),
        F.when(ok & F.col("has_old"), n("fn_old")).otherwise(zero).alias("function_declarations_deleted"),
        F.when(~ok, zero).when(F.col("has_old") & F.col("has_new"), n("try_either"))
        .otherwise(one_side).alias("try_changed"),
    )


def diff_stats(files: DataFrame, group: list[str], added="lines_added", deleted="lines_deleted") -> DataFrame:
    """Totals and counts per status, one row per change."""
    statuses = ("added", "deleted", "modified", "renamed", "binary")  # fixed values
    return files.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(added).alias("total_lines_added"), F.sum(deleted).alias("total_lines_deleted"),
        *[F.count_if(F.col("status") == s).alias(f"files_{s}") for s in statuses],
    )


def file_features(sections: DataFrame, keys: list[str]) -> DataFrame:
    """All per-file features of a section in one projection; nothing is shuffled."""
    cut = file_header(sections).withColumn("h", hunk_array(F.col("section")))
    body = F.flatten(F.transform("h", lambda h: L.text_lines(h["content"])))
    cut = cut.withColumn("__body", body)
    cut = cut.withColumn("__add", L.without_marker(F.col("__body"), L.is_added)).withColumn(
        "__del", L.without_marker(F.col("__body"), L.is_deleted)
    )
    total, n, widest = L.indent_stats(F.concat("__add", "__del"))
    sizes = F.aggregate("h", F.lit(0), lambda a, h: a + h["old_count"] + h["new_count"])
    added, deleted = F.array_join("__add", "\n"), F.array_join("__del", "\n")
    out = cut.select(
        *keys, "path", "old_path", "status", "is_binary",
        P.language_index(P.language(F.col("path"))).alias("language"),
        P.is_test_file(F.col("path")).alias("is_test_file"),
        F.size("__add").alias("lines_added"), F.size("__del").alias("lines_deleted"),
        (F.size("__add") + F.size("__del")).alias("total_lines_changed"),
        F.size("h").alias("hunk_count"),
        L.count_most(added, L.FUNCTION_PATTERNS).alias("function_declarations_added"),
        L.count_most(deleted, L.FUNCTION_PATTERNS).alias("function_declarations_deleted"),
        L.count_most(added, L.CLASS_PATTERNS).alias("class_declarations_added"),
        L.count_most(deleted, L.CLASS_PATTERNS).alias("class_declarations_deleted"),
        L.count_most(added, L.IMPORT_PATTERNS).alias("imports_added"),
        L.count_most(deleted, L.IMPORT_PATTERNS).alias("imports_deleted"),
        total.alias("indent_sum"), n.alias("indent_lines"), widest.alias("max_changed_line_indent"),
        F.when(F.size("h") > 0, sizes / F.nullif(F.size("h"), F.lit(0))).otherwise(0.0).alias("avg_hunk_size"),
    )
    return out.withColumn(
        "avg_changed_line_indent",
        F.when(F.col("indent_lines") > 0, F.col("indent_sum") / F.nullif(F.col("indent_lines"), F.lit(0))).otherwise(0.0),
    )


# fixed values: names and order of the per-file feature vector, as the data contract has them
FILE_VECTOR = [
    "language",
    "is_binary",
    "is_test_file",
    "lines_added",
    "lines_deleted",
    "total_lines_changed",
    "hunk_count",
    "function_declarations_added",
    "function_declarations_deleted",
    "class_declarations_added",
    "class_declarations_deleted",
    "imports_added",
    "imports_deleted",
    "avg_changed_line_indent",
    "max_changed_line_indent",
    "avg_hunk_size",
]


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])
