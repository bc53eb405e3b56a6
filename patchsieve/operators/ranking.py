"""Ranking the members of a group by investigation priority."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchsieve.operators.frames import beside, first_rows, frame, number_rows, number_within, reused

MODULUS = 2147483647  # fixed value: prime below 2**31, so products fit in a bigint

# fixed values: weights of the blended scores (size, functions, imports, hunks)
BLENDS = {
    "c1": (1.0, 0.0, 0.0, 0.0),
    "c2": (0.7, 0.3, 0.0, 0.0),
    "c3": (0.5, 0.2, 0.15, 0.15),
}


def _one_minus_share(position: Column, n: Column) -> Column:
    return F.lit(1.0) - position / F.greatest(n - 1, F.lit(1))


def rank_priority(
    df: DataFrame, group: list[str], value: str, seq: list[str], excluded: str, totals: dict[str, Column] | None = None,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Order a group by size, excluded rows last in input order; score 1 .. 0 by rank.

    Adds ``position`` (0-based), ``n_ranked`` and ``score``, and sums over the whole group named in ``totals``.
    ``sample`` is that of ``frames.frame``.
    """
    out = frame(
        df,
        group,
        [F.col(excluded), F.when(~F.col(excluded), -F.col(value)), *map(F.col, seq)],
        row="__row",
        totals={"n_ranked": F.when(F.col(excluded), 0).otherwise(1).cast("long"), **(totals or {})},
        sample=sample,
    )
    position = F.col("__row") - 1
    return out.withColumn("position", position).withColumn(
        "score",
        F.when(F.col(excluded), 0.0).otherwise(_one_minus_share(position, F.col("n_ranked"))),
    ).drop("__row")


def risk_output(ranked: DataFrame, path: str, excluded: str) -> DataFrame:
    """Rank 1..n for scored rows, 0 and a warning for excluded ones."""
    return ranked.withColumn(
        "rank", F.when(F.col(excluded), F.lit(0).cast("long")).otherwise(F.col("position") + 1)
    ).withColumn(
        "warning",
        F.when(
            F.col(excluded),
            F.concat(F.lit("Binary file "), F.col(path).cast("string"), F.lit(" not scored")),
        ),
    )


def risk_counts(ranked: DataFrame, group: list[str], excluded: str) -> DataFrame:
    return ranked.groupBy(*group).agg(
        F.count_if(~F.col(excluded)).alias("files_analyzed"),
        F.count_if(F.col(excluded)).alias("files_skipped"),
    )


def rank_normalize(
    df: DataFrame, group: list[str], value: str, seq: list[str], name: str = "score"
) -> DataFrame:
    """Rank-normalised score of every row; ties follow ``seq``."""
    out = frame(
        df, group, [-F.col(value), *map(F.col, seq)], row="__row",
        totals={"__n": F.lit(1).cast("long")},
    )
    return out.withColumn(name, _one_minus_share(F.col("__row") - 1, F.col("__n"))).drop("__row", "__n")


def signals(df: DataFrame) -> DataFrame:
    """Function churn, import churn and hunk count as ranking signals."""
    return df.select(
        "*",
        (F.abs("function_declarations_added") + F.abs("function_declarations_deleted")).cast("double").alias("s1"),
        (F.abs("imports_added") + F.abs("imports_deleted")).cast("double").alias("s2"),
        F.col("hunk_count").cast("double").alias("s3"),
    )


def normalized_signals(
    df: DataFrame, group: list[str], parts: dict[str, str], seq: list[str]
) -> DataFrame:
    """Rank-normalise several columns: {new name: source column}.

    Each pass is written, as a frame reads its input more than once.
    """
    for name, source in parts.items():
        df = reused(rank_normalize(df, group, source, seq, name))
    return df


def blend(columns: list[str], weights: tuple[float, ...]) -> Column:
    """Weighted sum, added in the order given."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in zip(columns, weights)])


def blend_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blends of the four normalised signals and the full blend less one signal each."""
    full = BLENDS["c3"]
    out = df
    for name, weights in BLENDS.items():
        out = out.withColumn(name, blend(columns, weights))
    for i, c in enumerate(columns):
        left = tuple(0.0 if j == i else w for j, w in enumerate(full))
        out = out.withColumn(f"c3_without_{c}", blend(columns, left))
    return out


def hashed_int(seed: Column | int, *keys: Column) -> Column:
    """Portable hash of integer keys into [0, MODULUS)."""
    h = F.pmod(F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long"), F.lit(MODULUS))
    for key in keys:
        h = F.pmod(h * 48271 + F.pmod(key.cast("long"), F.lit(MODULUS)) * 16807 + 12345, F.lit(MODULUS))
    return F.pmod(F.pmod(h * 69621 + 7919, F.lit(MODULUS)) * 48271 + 11, F.lit(MODULUS))


def hashed_ints(seed: int, *keys: np.ndarray) -> np.ndarray:
    """The same hash of whole arrays, inside tasks."""
    h = np.int64(seed % MODULUS)
    for key in keys:
        h = (h * 48271 + key % MODULUS * 16807 + 12345) % MODULUS
    return ((h * 69621 + 7919) % MODULUS * 48271 + 11) % MODULUS


def random_baseline(df: DataFrame, seed: int, keys: list[str], name: str = "score") -> DataFrame:
    """One seeded uniform score per row, a pure function of seed and row keys."""
    return df.withColumn(name, hashed_int(seed, *map(F.col, keys)) / F.lit(float(MODULUS)))


def rank_predictions(df: DataFrame, group: list[str], score: str, seq: list[str]) -> DataFrame:
    return frame(
        df, group, [-F.col(score), *map(F.col, seq)], row="rank",
        totals={"group_size": F.lit(1).cast("long")},
    )


def minmax_normalize(
    df: DataFrame, value: str, name: str, group: list[str] | None = None, tolerance: float = 1e-12, few: bool = False
) -> DataFrame:
    """(x - min) / (max - min); a spread within ``tolerance`` gives 0.5.

    ``few`` groups hold much of the table each: their ends travel to the rows, as rows sorted by group would fill few tasks.
    """
    group = group or []
    ends = df.groupBy(*group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = df.join(F.broadcast(ends) if few else ends, group) if group else beside(df, ends)
    spread = F.col("__hi") - F.col("__lo")
    return joined.withColumn(
        name,
        F.when(spread <= tolerance, F.lit(0.5)).otherwise(
            (F.col(value) - F.col("__lo")) / F.when(spread > tolerance, spread)
        ),
    ).drop("__lo", "__hi")


def top_cut_capture(
    df: DataFrame, score: str, positive: str, seq: list[str],
    cuts: tuple[int, ...] = (10, 20, 50, 100), shares: tuple[int, ...] = (10, 20), by: list[str] | None = None,
) -> DataFrame:
    """Positives among the first rows, by count and by share (percent), of the whole table or of each ``by``."""
    by = by or []
    ranked = number_rows(df, by, [-F.col(score), *map(F.col, seq)], "__rank")
    # the share cuts need the row count, the fixed cuts do not
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.count_if(positive).alias("__p"))
    with_counts = lambda d, how: d.join(counts, by, how) if by else beside(d, counts)
    limits = {f"top_{k}": F.lit(k).cast("long") for k in cuts}
    for s in shares:
        limits[f"top_{s}_percent"] = F.greatest(F.lit(1).cast("long"), F.floor(F.col("__n") / (100 // s)))
    hits = with_counts(ranked.where(F.col(positive)), "inner").groupBy(*by).agg(
        *[F.count_if(F.col("__rank") <= limit).alias(n) for n, limit in limits.items()]
    )
    # a group without positives has no row among the hits
    row = with_counts(hits, "right")
    long = F.explode(F.array(*[
        F.struct(F.lit(n).alias("cut"), F.least(limit, F.col("__n")).alias("rows"), F.coalesce(n, F.lit(0)).cast("long").alias("captured"))
        for n, limit in limits.items()
    ])).alias("c")
    return row.select(*by, long, "__p").select(
        *by, "c.cut", "c.rows", "c.captured",
        F.when(F.col("__p") > 0, F.lit(100.0) * F.col("c.captured") / F.col("__p")).alias("percent"),
    )


def rank_importance(df: DataFrame, name: str, weight: str) -> DataFrame:
    """Absolute weights over their maximum, ranked downwards, original index kept."""
    strength = F.abs(F.col(weight).cast("double"))
    top = df.agg(F.max(strength).alias("__top"))
    scaled = beside(df, top).withColumn(
        "importance", F.when(F.col("__top") > 0, strength / F.col("__top")).otherwise(strength)
    ).drop("__top")
    return number_rows(scaled, [], [-F.col("importance"), F.col(name)], "rank")


def candidate_ranking(
    df: DataFrame, repo: str, change: str, positive: str, min_changes: int = 50
) -> DataFrame:
    """Repositories with enough changes, by positive changes then positive files."""
    return (
        df.groupBy(repo, change)
        .agg(F.count(F.lit(1)).alias("__files"), F.count_if(positive).alias("__pos"))
        .groupBy(repo)
        .agg(
            F.count(F.lit(1)).alias("changes"),
            F.sum("__files").alias("files"),
            F.count_if(F.col("__pos") > 0).alias("positive_changes"),
            F.sum(F.when(F.col("__pos") > 0, F.col("__files")).otherwise(0)).alias("positive_files"),
        )
        .where(F.col("changes") >= min_changes)
        .orderBy(F.desc("positive_changes"), F.desc("positive_files"), repo)
    )


BANDS = ("highest", "high", "medium", "low")  # fixed values


def priority_band(ranked: DataFrame, excluded: str, position="position", n="n_ranked") -> DataFrame:
    """Band from the rank among the non-excluded rows only."""
    p, total = F.col(position), F.col(n)
    return ranked.withColumn(
        "band",
        F.when(F.col(excluded), "low")
        .when(p == 0, "highest")
        .when(p <= F.floor(total / 4), "high")
        .when(p <= F.floor(total / 2), "medium")
        .otherwise("low"),
    )


def priority_summary(banded: DataFrame, group: list[str], excluded: str, evidence_count: str) -> DataFrame:
    return banded.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(~F.col(excluded)).alias("files_ranked"),
        F.count_if(F.col(excluded)).alias("files_binary"),
        *[F.count_if(F.col("band") == b).alias(f"{b}_count") for b in BANDS],
        F.count_if(F.col(evidence_count) > 0).alias("evidence_available"),
        F.count_if(F.col(evidence_count) == 0).alias("evidence_unavailable"),
    )


def top_k_eligible(
    df: DataFrame, group: list[str], seq: list[str], excluded: str, deleted: Column, k: int = 10, mark: str | None = None
) -> DataFrame:
    """First k rows per group in input order, leaving out excluded and deleted rows.

    With ``mark`` all rows stay, and a column of that name tells which these are.
    """
    if mark:
        able = F.coalesce(~F.col(excluded) & ~deleted, F.lit(False))
        placed = number_within(df.withColumn("__able", able), [*group, "__able"], [F.col(c) for c in seq], "slot")
        return placed.withColumn(mark, F.col("__able") & (F.col("slot") <= k)).drop("__able", "slot")
    return first_rows(df.where(~F.col(excluded) & ~deleted), group, [F.col(c) for c in seq], k, "slot")


