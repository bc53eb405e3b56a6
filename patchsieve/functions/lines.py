"""Column functions on lines and blocks of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the line breaks of a text split into lines
BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# fixed values: declaration patterns per kind; (?mdU) = lines end at \n only, Unicode classes
FUNCTION_PATTERNS = (
    r"(?mdU)^\s*def\s+\w+",
    r"(?mdU)^\s*(?:function\s+\w+|(?:public|private|protected|static|async|export|const|let|var)\s+)*\w+\s*\(.*\)\s*(?:\{|=>)",
    r"(?mdU)^\s*func\s+\w+",
    r"(?mdU)^\s*\w+\s*\(.*\)\s*\{",
)
CLASS_PATTERNS = (
    r"(?mdU)^\s*class\s+\w+",
    r"(?mdU)^\s*(?:export\s+)?(?:abstract\s+)?class\s+\w+",
)
IMPORT_PATTERNS = (
    r"(?mdU)^\s*(?:from\s+\S+\s+)?import\s+",
    r"(?mdU)^\s*(?:import\s+\{|import\s+\w|from\s+\S+\s+import\s+)",
    r"(?mdU)^\s*\"[\w/]+\"",
    r"(?mdU)^\s*(?:import|from|include|require|#include)\s",
)


def text_lines(text: Column) -> Column:
    """Lines of a text; a break at the end opens no further line, empty text has none."""
    body = F.regexp_replace(text, f"(?:{BREAK})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, BREAK, -1))


def normalize_line(line: Column) -> Column:
    """Trailing white space removed, leading white space kept."""
    return F.regexp_replace(line, r"(?U)\s+\z", "")


def indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"(?U)^\s*", 0))


def indent_stats(lines: Column) -> tuple[Column, Column, Column]:
    """Sum, count and maximum of the leading white space over an array of lines."""
    widths = F.transform(lines, indent)
    total = F.aggregate(widths, F.lit(0).cast("long"), lambda a, w: a + w)
    return total, F.size(lines), F.coalesce(F.array_max(widths), F.lit(0))


def count_most(text: Column, patterns: tuple[str, ...]) -> Column:
    """Largest match count over the patterns, not their sum."""
    return F.greatest(*[F.regexp_count(text, F.lit(p)) for p in patterns])


def is_added(line: Column) -> Column:
    return F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++"))


def is_deleted(line: Column) -> Column:
    return F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("---"))


def without_marker(lines: Column, keep) -> Column:
    return F.transform(F.filter(lines, keep), lambda x: F.substring(x, 2, 2147483647))
