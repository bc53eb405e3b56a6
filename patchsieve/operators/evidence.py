"""Typed evidence rows per file, and what is told from them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchsieve.functions.paths import language_name

ENTRY = ("struct<ord:int,category:string,evidence_type:string,description:string,"
         "source:string,provenance:string,number:double>")


def _entry(order: int, category, kind, text: Column, source, provenance, number: Column) -> Column:
    return F.struct(
        F.lit(order).alias("ord"), F.lit(category).alias("category"), F.lit(kind).alias("evidence_type"),
        text.alias("description"), F.lit(source).alias("source"), F.lit(provenance).alias("provenance"),
        number.cast("double").alias("number"),
    )


def _shown(mark: str, value: Column) -> Column:
    """A value as format_string says it; usual numbers without its formatter, which is slow."""
    if mark in ("%d", "%s"):
        return F.coalesce(value.cast("string"), F.lit("null"))
    # one decimal of a rounded double below 10**7 is its shortest form
    plain = value.cast("string") if mark == "%.1f" else value.cast("long").cast("string")
    return F.when(value.between(0.0, 9_999_999.0), plain).otherwise(F.format_string(mark, value))


def _text(template: str, *columns: Column) -> Column:
    left, parts = list(columns), []
    for part in re.split(r"(%d|%s|%\.1f|%\.0f|%%)", template):
        if part == "%%":
            parts.append(F.lit("%"))
        elif part.startswith("%"):
            parts.append(_shown(part, left.pop(0)))
        elif part:
            parts.append(F.lit(part))
    return F.concat(*parts)


def cheap_evidence(df: DataFrame, name: str = "evidence") -> DataFrame:
    """Evidence from the change itself, in a fixed order, as an array of at most 15 entries.

    The descriptions are fixed templates; the raw number stands beside the text.
    """
    c = F.col
    one = lambda x: F.bround(x.cast("double"), 1)
    total = F.greatest(c("commit_lines"), F.lit(1).cast("long"))
    lines = c("lines_added") + c("lines_deleted")
    part = lines / total
    feature, diff = "feature_extraction", "diff"
    rules = [
        (F.lit(True), "change", "lines_changed",
         _text("%d lines added, %d deleted", c("lines_added"), c("lines_deleted")), diff, "direct", lines),
        (c("hunk_count") > 1, "change", "hunk_count",
         _text("Changed across %d hunks", c("hunk_count")), feature, "direct", c("hunk_count")),
        ((c("function_declarations_added") > 0) | (c("function_declarations_deleted") > 0), "change", "function_churn",
         _text("%d function declaration(s) added, %d deleted", c("function_declarations_added"), c("function_declarations_deleted")),
         feature, "direct", c("function_declarations_added") + c("function_declarations_deleted")),
        ((c("class_declarations_added") > 0) | (c("class_declarations_deleted") > 0), "change", "class_churn",
         _text("%d class declaration(s) added, %d deleted", c("class_declarations_added"), c("class_declarations_deleted")),
         feature, "direct", c("class_declarations_added") + c("class_declarations_deleted")),
        ((c("imports_added") > 0) | (c("imports_deleted") > 0), "change", "import_churn",
         _text("%d import(s) added, %d deleted", c("imports_added"), c("imports_deleted")),
         feature, "direct", c("imports_added") + c("imports_deleted")),
        (c("status") != "modified", "change", "file_status",
         _text("File status: %s", c("status")), diff, "direct", F.lit(None)),
        (c("is_binary"), "change", "binary_file", F.lit("Binary file"), diff, "direct", F.lit(None)),
        (c("max_changed_line_indent") > 0, "structural", "indentation",
         _text("Average changed-line indentation: %.1f spaces, max: %d spaces", one(c("avg_changed_line_indent")), c("max_changed_line_indent")),
         feature, "derived", c("avg_changed_line_indent")),
        (c("avg_hunk_size") > 0, "structural", "hunk_size",
         _text("Average hunk size: %.1f lines", one(c("avg_hunk_size"))), feature, "derived", c("avg_hunk_size")),
        (c("is_test_file"), "test", "test_file", F.lit("This is a test file"), "path_convention", "direct", F.lit(None)),
        (c("test_prod_coupling"), "test", "test_coupling",
         F.lit("Both test and production files changed in this commit"), feature, "derived", F.lit(None)),
        (~c("has_test_changes"), "test", "no_test_changes",
         F.lit("No test files changed in this commit"), feature, "derived", F.lit(None)),
        (part > 0, "context", "change_concentration",
         _text("File accounts for %.0f%% of total commit changes (%d of %d lines)", F.bround(part * 100, 0), lines, total),
         diff, "derived", part),
        # index 0 (Python) never shows up here
        (c("language") > 0, "context", "language",
         _text("File language: %s", language_name(c("language"))), feature, "direct", c("language")),
        (c("position").isNotNull(), "context", "b1_ranking",
         _text("Ranked at position %d in B1 output (%d lines changed)", c("position"), lines),
         "b1_ranking", "derived", c("position")),
    ]
    entries = [
        F.when(cond, _entry(i, cat, kind, text, source, prov, number))
        for i, (cond, cat, kind, text, source, prov, number) in enumerate(rules)
    ]
    return df.withColumn(name, F.array_compact(F.array(*entries)))


def historical_evidence(df: DataFrame, name: str = "history") -> DataFrame:
    """Evidence from earlier changes for eligible files (see ``recent_history``)."""
    c = F.col
    root, none, n = ~c("has_parent"), c("history_unavailable"), c("recent_commits")
    known = ~root & ~none
    rules = [
        (root, "root_commit", F.lit("Analyzed commit is a root commit (no parent history available)"), "direct", F.lit(None)),
        (~root & none, "history_unavailable", F.lit("No prior history found for this file"), "direct", F.lit(None)),
        (known, "recent_commits", _text("File changed in %d recent commit(s)", n), "derived", n),
        (known & (c("recent_bug_fixes") > 0), "recent_bug_fixes",
         _text("File has %d prior bug-fix commit(s)", c("recent_bug_fixes")), "derived", c("recent_bug_fixes")),
        (known & c("days_since_last_change").isNotNull(), "days_since_last_change",
         _text("File last changed %d day(s) ago", c("days_since_last_change")), "derived", c("days_since_last_change")),
    ]
    entries = [
        F.when(c("eligible") & cond, _entry(100 + i, "historical", kind, text, "git_log", prov, number))
        for i, (cond, kind, text, prov, number) in enumerate(rules)
    ]
    return df.withColumn(name, F.array_compact(F.array(*entries)))


PAST = ["eligible", "has_parent", "recent_commits", "recent_bug_fixes", "days_since_last_change", "history_unavailable"]


def _apart(rows: DataFrame, keys: list[str], again: str) -> DataFrame:
    """Rows that hold both sides, as a full outer join gives them: sides whose key holds a null do not meet."""
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    own, past = F.array(F.lit(1)), F.array(F.lit(2))
    sides = F.when(F.col("eligible") & unkeyed, F.when(F.col(again), past).otherwise(F.concat(own, past))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("__side", F.explode(sides))
    return rows.withColumns({"__change": F.col("__side") != 2, "eligible": F.col("eligible") & (F.col("__side") != 1)}).drop("__side", again)


def _met(
    facts: DataFrame, past: DataFrame | None, keys: list[str], how: str, derived: Callable[[DataFrame], DataFrame] | None, again: str = ""
) -> DataFrame:
    """Both sides meet as plain values and entries are made of the joined rows, so no text is shuffled.

    ``derived`` adds what follows from the plain values of a row, which need not be shuffled either.
    """
    if past is None:
        both = _apart(facts, keys, again)
    else:
        both = facts.withColumn("__change", F.lit(True)).join(past.select(*keys, *PAST), keys, how)
    both = derived(both) if derived else both
    told = historical_evidence(cheap_evidence(both, "__cheap"), "__history")
    empty = F.array().cast(f"array<{ENTRY}>")
    cheap = F.when(F.col("__change"), F.col("__cheap")).otherwise(empty)
    return told.withColumn("evidence", F.concat(cheap, "__history")).drop("__change", "__cheap", "__history", *PAST)


def merge_evidence(
    facts: DataFrame, past: DataFrame | None, keys: list[str], derived: Callable[[DataFrame], DataFrame] | None = None, again: str = ""
) -> DataFrame:
    """Entries of the change first, then those of its past, per file; a file of one side has that side's.

    ``facts`` (after ``derived``) has the columns of ``cheap_evidence``, ``past`` those of ``historical_evidence``.
    Without ``past`` the rows of ``facts`` hold both, ``eligible`` (never null) tells which have a past, and ``again`` marks the
    second and further rows of a file with several.
    """
    return _met(facts, past, keys, "full_outer", derived, again)


def evidence_rows(df: DataFrame, keys: list[str], name: str = "evidence") -> DataFrame:
    return df.select(*keys, F.explode(name).alias("e")).select(*keys, "e.*")


def investigation_view(
    ranked: DataFrame, past: DataFrame, keys: list[str], derived: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Ranked files with score, position and their evidence array; ``ranked`` has the columns of ``cheap_evidence``, too."""
    return _met(ranked, past, keys, "left", derived)


def has_type(kind: str, name: str = "evidence") -> Column:
    return F.exists(name, lambda e: e["evidence_type"] == kind)


def evidence_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("is_binary", has_type("binary_file")).withColumn("is_test_file", has_type("test_file"))


def evidence_projection(name: str = "evidence") -> Column:
    fields = ("category", "evidence_type", "description", "source", "provenance")
    return F.transform(name, lambda e: F.struct(*[e[f].alias(f) for f in fields]))


def explanation(total_lines: str = "total_lines_changed") -> Column:
    """One sentence from band, size and the evidence types present."""
    lines = F.concat(F.lit("with "), F.col(total_lines).cast("string"), F.lit(" line(s) changed"))
    band = F.concat(F.initcap(F.col("band")), F.lit("-priority file"))
    # fixed values: clauses in the order they are told
    clauses = (
        ("hunk_count", "across multiple hunks"),
        ("function_churn", "with function declaration changes"),
        ("class_churn", "with class declaration changes"),
        ("import_churn", "with import changes"),
        ("recent_commits", "with prior commit history"),
        ("recent_bug_fixes", "including prior bug-fix commits"),
        ("history_unavailable", "with no prior commit history available"),
        ("root_commit", "analyzed as a root commit"),
        ("test_file", "This is a test file"),
        ("no_test_changes", "No test files changed in this commit"),
        ("test_coupling", "Both test and production files changed in this commit"),
    )
    said = F.concat_ws("; ", band, lines, *[F.when(has_type(kind), F.lit(text)) for kind, text in clauses])
    return (
        F.when(has_type("binary_file"), "Binary file: no B1 investigation-priority score assigned.")
        .when(F.size("evidence") == 0,
              F.concat(F.lit("Low-priority file "), lines, F.lit("; no evidence available.")))
        .otherwise(F.concat(said, F.lit(".")))
    )


def evidence_gaps() -> Column:
    binary = has_type("binary_file")
    return F.array_compact(F.array(
        F.when(binary, "Binary file: no B1 ranking score assigned"),
        F.when((F.size("evidence") == 0) & ~binary, "No evidence generated for this file"),
        F.when(has_type("history_unavailable"), "Historical commit data not available for this file"),
        F.when(has_type("root_commit"), "Root commit: no parent history available"),
    ))


__all__ = ["cheap_evidence", "historical_evidence", "merge_evidence", "evidence_rows",
           "investigation_view", "evidence_flags", "evidence_projection", "explanation", "evidence_gaps"]
