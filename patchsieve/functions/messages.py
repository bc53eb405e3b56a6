"""Column functions on change messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that mark a correcting change
FIX_WORDS = r"(?iU)\b(fix(es|ed)?|bug|resolve[sd]?|patch(es|ed)?|hotfix|regression)\b"
LOOSE_FIX_WORDS = ("fix", "bug", "patch", "hotfix", "resolve", "correct")
REVERT_START = r"(?iU)^revert\s"
REVERT_QUOTE = r"(?iU)Revert\s+[\"'](.+?)[\"']"
HEX_RUN = r"(?i)[0-9a-f]{7,40}"
FIX_PREFIX = r"bug-fix ([0-9a-f]{8,40})"
REVERT_PREFIX = r"reverted by ([0-9a-f]{8,40})"
MENTION = r"(?iU)\b(?:fix|patch|resolve|bug|issue|error)\b.*?\b(\w+)\b"
# fixed values: upper ends and names of the change size buckets
SIZE_BUCKETS = ((1, "1"), (3, "2-3"), (5, "4-5"), (10, "6-10"), (20, "11-20"), (None, ">20"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def says_fix(message: Column, words: str = FIX_WORDS) -> Column:
    return message.rlike(words)


def is_bug_fix(message: Column, lines_changed: Column, words: str = FIX_WORDS) -> Column:
    """A fix word, a message that is not blank, and a diff that is not empty."""
    return (stripped(message) != "") & says_fix(message, words) & (lines_changed != 0)


def is_bug_fix_loose(message: Column, words: tuple[str, ...] = LOOSE_FIX_WORDS) -> Column:
    """Substring rule of the recent-history evidence: "prefix" counts as well."""
    return F.lower(message).rlike("|".join(words))


def is_revert(message: Column) -> Column:
    return stripped(message).rlike(REVERT_START)


def revert_quote(message: Column) -> Column:
    return F.nullif(stripped(F.regexp_extract(message, REVERT_QUOTE, 1)), F.lit(""))


def hex_refs(message: Column) -> Column:
    return F.transform(F.regexp_extract_all(message, F.lit(HEX_RUN), 0), F.lower)


def fix_prefix(evidence: Column) -> Column:
    found = [F.nullif(F.regexp_extract(evidence, p, 1), F.lit("")) for p in (FIX_PREFIX, REVERT_PREFIX)]
    return F.coalesce(*found)


def mentioned_words(message: Column) -> Column:
    """First five words that follow a fix-like verb."""
    return F.slice(F.regexp_extract_all(message, F.lit(MENTION), 1), 1, 5)


def size_bucket(files: Column) -> Column:
    out = F.when(files == SIZE_BUCKETS[0][0], SIZE_BUCKETS[0][1])
    for top, name in SIZE_BUCKETS[1:-1]:
        out = out.when(files <= top, name)
    return out.otherwise(SIZE_BUCKETS[-1][1])


def short_sha(sha: Column, length: int = 8) -> Column:
    return F.substring(sha, 1, length)
