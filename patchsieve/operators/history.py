"""What is known about a file before a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchsieve.operators.diffs import NO_FILE
from patchsieve.operators.frames import frame, reused, with_last

DAY = 86400


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(late: Column, early: Column) -> Column:
    return (micros(late) - micros(early)) / 1_000_000


def whole_days(late: Column, early: Column) -> Column:
    """Whole days from early to late, rounded down, never below 0."""
    passed = F.greatest(micros(late) - micros(early), F.lit(0))
    return F.floor(passed / (DAY * 1_000_000)).cast("long")


def _once_per_change(touches: DataFrame, keys: list[str], pos: list[str]) -> DataFrame:
    """A change touches a path once, however many rows say so."""
    return touches.groupBy(*keys, *pos).agg(F.min("ts").alias("ts"), F.max("is_fix").alias("is_fix"))


def history_features(
    candidates: DataFrame, touches: DataFrame, keys: list[str], pos: list[str]
) -> DataFrame:
    """Touches, fixes and whole days since the last touch, all strictly before.

    ``touches`` and ``candidates`` hold ``keys`` (repository, path), ``pos`` (the
    linear position of the change) and ``ts``; touches also ``is_fix``. Both are
    merged into one ordered pass per path, a candidate sorting before a touch at
    the same position, so nothing is paired. ``/dev/null`` and candidates with
    ``has_parent`` false get zeros.
    """
    path = keys[-1]
    nothing = F.lit(None)
    seen = _once_per_change(touches, keys, pos).select(
        *keys, *pos, F.lit(1).alias("__touch"), F.col("ts").alias("__ts"),
        F.col("is_fix").cast("long").alias("__fix"), nothing.cast("timestamp").alias("ts"),
        nothing.cast("boolean").alias("has_parent"),
    )
    asked = candidates.select(*keys, *pos, "ts", "has_parent").distinct().select(
        *keys, *pos, F.lit(0).alias("__touch"), nothing.cast("timestamp").alias("__ts"),
        F.lit(0).cast("long").alias("__fix"), "ts", "has_parent",
    )
    out = frame(
        seen.unionByName(asked), keys, [*map(F.col, pos), F.col("__touch")],
        sums={"__n": F.col("__touch").cast("long"), "__fixes": F.col("__fix")},
        lasts={"__last": F.col("__ts")},
    ).where(F.col("__touch") == 0)
    known = F.col("has_parent") & (F.col(path).cast("string") != NO_FILE)
    zero = F.lit(0).cast("long")
    return out.select(
        *keys, *pos,
        F.when(known, F.col("__n")).otherwise(zero).alias("prior_touches"),
        F.when(known, F.col("__fixes")).otherwise(zero).alias("prior_fixes"),
        F.when(known & F.col("__last").isNotNull(), whole_days(F.col("ts"), F.col("__last")))
        .otherwise(zero).alias("days_since"),
    )


def history_features_legacy(touches: DataFrame, keys: list[str], pos: list[str]) -> DataFrame:
    """Older rule: the list is read from the newest touch down to the change itself.

    So the counts are of *newer* touches, and the days run from the newest one
    (fractional, never below 0).
    """
    seen = reused(_once_per_change(touches, keys, pos))
    ranked = frame(
        seen, keys, [*map(F.col, pos)],
        row="__r", sums={"__f": F.col("is_fix").cast("long")},
        totals={"__n": F.lit(1).cast("long"), "__ft": F.col("is_fix").cast("long")},
        peaks={"__newest": F.struct(*pos, "ts")}, inclusive=True,
    ).withColumn("__newest", F.col("__newest.ts"))
    later = F.col("__n") - F.col("__r")
    return ranked.select(
        *keys, *pos, later.alias("touches"), (F.col("__ft") - F.col("__f")).alias("fixes"),
        F.when(later > 0, F.greatest(F.lit(0.0), seconds_between(F.col("ts"), F.col("__newest")) / DAY))
        .otherwise(0.0).alias("days_since"),
    )


def recent_history(
    candidates: DataFrame, touches: DataFrame, keys: list[str], pos: list[str], n: int = 5, distinct: bool = False
) -> DataFrame:
    """The last n touches before a change, in two steps as the history tool takes them.

    First the n newest touches at an earlier position whose ``committed`` time is
    not after the candidate's ``ts``; then, of these, only the ones whose ``ts``
    is strictly before. Positions follow the committed time, so the first step is
    one prefix of that order: up to the earlier of the candidate's two times, and
    within equal times up to its position. One ordered pass over touches and candidates
    gives every candidate the last n touches before it. ``distinct`` candidates are not repeated,
    and need no table of those seen.
    """
    nothing = F.lit(None)
    entry = "array<struct<ts:timestamp,loose_fix:boolean>>"
    seen = touches.select(
        *keys, *pos, F.col("committed").cast("timestamp").alias("__at"), F.lit(1).alias("__touch"), nothing.cast("timestamp").alias("ts"),
        F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("loose_fix").cast("boolean").alias("loose_fix")).alias("__entry"),
    )
    wanted = candidates.select(*keys, *pos, "ts", "committed")
    asked = (wanted if distinct else wanted.distinct()).select(
        *keys, *pos, F.least("ts", "committed").cast("timestamp").alias("__at"), F.lit(0).alias("__touch"),
        F.col("ts").cast("timestamp").alias("ts"), nothing.cast("struct<ts:timestamp,loose_fix:boolean>").alias("__entry"),
    )
    met = with_last(
        seen.unionByName(asked), keys, [F.col("__at"), *map(F.col, pos), F.col("__touch")], n, F.col("__entry"), "__found",
    ).where(F.col("__touch") == 0)
    return _found(met.withColumn("__found", F.coalesce("__found", F.array().cast(entry))), [*keys, *pos])


def recent_history_of_touches(touches: DataFrame, keys: list[str], pos: list[str], n: int = 5) -> DataFrame:
    """``recent_history`` of the touches themselves, for touches whose ``ts`` is not before their ``committed`` time.

    Positions follow the committed time and are told once, so a touch stands at its own place in the order, right
    after the touches that it is asked about: one row is both sides, and half as many rows are shuffled and sorted.
    """
    entry = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("loose_fix").cast("boolean").alias("loose_fix"))
    rows = touches.select(*keys, *pos, entry.alias("__entry"))
    met = with_last(rows, keys, [F.col(c) for c in pos], n + 1, F.col("__entry"), "__found")
    own = F.element_at("__found", -1)["ts"]
    return _found(met.select(*keys, *pos, own.alias("ts"), F.slice("__found", 1, F.size("__found") - 1).alias("__found")), [*keys, *pos])


def recent_history_of_rows(
    rows: DataFrame, keys: list[str], pos: list[Column], ts: Column, loose: Column, counted: Column,
    sample: DataFrame, by: list[str], n: int = 5,
) -> DataFrame:
    """``recent_history_of_touches`` where a touch may have several rows, which all keep their columns.

    One row of a touch is ``counted`` and all are told its history; rows of no touch are told nothing of use. Positions and times
    are expressions, made where the rows are dealt. ``sample`` has about the counted rows and is cheap to read (see ``with_last``).
    """
    entry = F.struct(ts.cast("timestamp").alias("ts"), loose.alias("loose_fix"))
    order = [*pos, F.when(counted, 0).otherwise(1)]
    met = with_last(rows, keys, order, n + 1, F.when(counted, entry), "__found", sample, by)
    found = F.slice("__found", 1, F.greatest(F.size("__found") - 1, F.lit(0)))
    return _found(met.select(*rows.columns, ts.cast("timestamp").alias("ts"), found.alias("__found")), rows.columns)


def _found(met: DataFrame, columns: list[str]) -> DataFrame:
    """What is told of the last touches (``__found``) whose time is before ``ts``."""
    met = met.withColumn("__found", F.filter("__found", lambda x: x["ts"] < F.col("ts")))
    newest = F.try_element_at(F.col("__found"), F.lit(-1))["ts"]
    return met.select(
        *columns, F.size("__found").cast("long").alias("recent_commits"),
        F.size(F.filter("__found", lambda x: x["loose_fix"])).cast("long").alias("recent_bug_fixes"),
        F.when(newest.isNotNull(), whole_days(F.col("ts"), newest)).alias("days_since_last_change"),
        (F.size("__found") == 0).alias("history_unavailable"),
    )
