"""Evaluation of rankings: within groups, over groups, and over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchsieve.operators.frames import beside, frame, number_rows, percentiles, reused

BUDGETS = (1, 2, 3, 5, 10, 20, 50, 100)  # fixed values: the K grid of the reports


def share(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """top / bottom, ``empty`` where the bottom is zero."""
    return F.when(bottom != 0, top / F.nullif(bottom, F.lit(0))).otherwise(F.lit(empty).cast("double"))


def rank_in_group(df: DataFrame, group: list[str], score: str, ties: list[Column]) -> DataFrame:
    return number_rows(reused(df), group, [-F.col(score), *ties], "rank")


def group_counts(ranked: DataFrame, group: list[str], positive: str, budgets=BUDGETS) -> DataFrame:
    """One row per group: size, positives, first positive rank and hits per budget.

    All budgets come out of one aggregation, so no row is copied per budget.
    """
    hit = F.col(positive)
    return ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(hit).alias("n_positive"),
        F.min(F.when(hit, F.col("rank"))).alias("first_rank"),
        *[F.count_if(hit & (F.col("rank") <= k)).alias(f"hits_{k}") for k in budgets],
    ).withColumn("reciprocal_rank", F.lit(1.0) / F.col("first_rank"))


def budget_values(k: int) -> tuple[Column, Column, Column]:
    """Recall, enrichment and all-captured of one group at budget k."""
    n, p, hits = F.col("n_files"), F.col("n_positive"), F.col(f"hits_{k}")
    recall = share(hits, p)
    return recall, recall / (F.least(F.lit(k), n) / n), hits >= p


def within_group_metrics(
    df: DataFrame, group: list[str], score: str, positive: str, seq: list[str], budgets=BUDGETS
) -> DataFrame:
    """Long form (group, k): recall, enrichment, all captured, first positive rank.

    A group without positives has recall 0 and counts as captured.
    """
    counts = group_counts(
        rank_in_group(df.select(*group, *seq, score, positive), group, score, [F.col(c) for c in seq]), group, positive, budgets
    )
    return per_budget(counts, group, budgets)


def per_budget(counts: DataFrame, group: list[str], budgets=BUDGETS) -> DataFrame:
    entries = []
    for k in budgets:
        recall, enrichment, captured = budget_values(k)
        entries.append(F.struct(
            F.lit(k).alias("k"), recall.alias("recall"), enrichment.alias("enrichment"),
            captured.alias("all_captured"),
        ))
    keep = [*group, "n_files", "n_positive", "first_rank", "reciprocal_rank"]
    return counts.select(*keep, F.explode(F.array(*entries)).alias("e")).select(*keep, "e.*")


def aggregate_group_metrics(counts: DataFrame, by: list[str] | None = None, budgets=BUDGETS) -> DataFrame:
    """Macro means over groups with positives; sizes and coverage over all groups.

    The groups are first folded per first positive rank. A rank r needs a group of
    at least r rows, so N rows have at most sqrt(2 N) different ranks; the exact
    medians of the second step are weighted by the folded counts and small.
    """
    by = by or []
    some = F.col("n_positive") > 0
    only = lambda c: F.sum(F.when(some, c))
    parts, means = [], []
    for k in budgets:
        recall, enrichment, captured = budget_values(k)
        for name, value in (("recall", recall), ("enrichment", enrichment), ("captured", captured.cast("long"))):
            parts.append(only(value).alias(f"{name}_{k}"))
            means.append(f"{name}_{k}")
    folded = counts.groupBy(*by, "first_rank").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(some).alias("p"), F.sum("n_files").alias("files"), *parts
    )
    n, p = F.sum("n"), F.sum("p")
    per_group = lambda c: F.coalesce(F.sum(c) / F.nullif(p, F.lit(0)), F.lit(0.0))
    rank = F.col("first_rank")
    weight = F.when(F.col("p") > 0, F.col("p")).otherwise(F.lit(0))
    middle = lambda c: F.coalesce(F.percentile(c, F.lit(0.5), weight), F.lit(0.0))
    return folded.groupBy(*by).agg(
        n.alias("groups"), p.alias("groups_with_positive"),
        F.coalesce(p / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.sum("files") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("mean_files"),
        per_group(F.col("p") / rank).alias("mrr"), per_group(F.col("p") * rank).alias("mean_first_rank"),
        *[per_group(F.col(c)).alias(c) for c in means],
        middle(rank).alias("median_first_rank"), middle(F.lit(1.0) / rank).alias("median_reciprocal_rank"),
    )


def per_commit_precision(
    df: DataFrame, group: list[str], score: str, positive: str, path: list[str],
    cuts=(1, 2, 3, 5), captures=(1, 3, 5),
) -> DataFrame:
    """Precision, recall and capture per group, ties by path; null without positives."""
    counts = group_counts(
        rank_in_group(df, group, score, [F.col(c) for c in path]), group, positive, cuts
    )
    n, p = F.col("n_files"), F.col("n_positive")
    some = p > 0
    return counts.select(
        *group, "n_files", "n_positive", "first_rank", "reciprocal_rank",
        *[F.when(some, F.col(f"hits_{k}") / F.least(F.lit(k), n)).alias(f"precision_{k}") for k in cuts],
        *[F.when(some, F.col(f"hits_{k}") / F.nullif(p, F.lit(0))).alias(f"recall_{k}") for k in cuts],
        *[F.when(some, (F.col(f"hits_{k}") > 0).cast("int")).alias(f"capture_{k}") for k in captures],
    )


def precision_summary(per_commit: DataFrame, cuts=(1, 2, 3, 5), captures=(1, 3, 5)) -> DataFrame:
    """Long form (metric, mean, median) over groups with positives."""
    names = (
        [f"precision_{k}" for k in cuts] + [f"recall_{k}" for k in cuts]
        + [f"capture_{k}" for k in captures] + ["first_rank", "reciprocal_rank"]
    )
    long = per_commit.where(F.col("n_positive") > 0).select(
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
        ])).alias("m")
    ).select("m.*")
    means = long.groupBy("metric").agg(F.avg("value").alias("mean"))
    return means.join(percentiles(long, ["metric"], "value", {"median": 0.5}), "metric")


def first_of_table(df: DataFrame, score: str, seq: list[str], k: int) -> DataFrame:
    """The k best rows of the whole table with their rank."""
    order = [-F.col(score), *[F.col(c) for c in seq]]
    top = df.orderBy(*order).limit(k)  # at most k rows, so one window task is enough
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def global_topk(
    df: DataFrame, score: str, positive: str, seq: list[str], budgets=BUDGETS, clip: bool = False
) -> DataFrame:
    """Recall@K and precision@K over the whole table; K is clipped to n only on request."""
    top = first_of_table(df, score, seq, max(budgets)).agg(
        *[F.count_if(F.col(positive) & (F.col("rank") <= k)).alias(f"hits_{k}") for k in budgets]
    )
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p"))
    entries = [
        F.struct(
            F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits"),
            (F.least(F.lit(k).cast("long"), F.col("n")) if clip else F.lit(k).cast("long")).alias("cut"),
        )
        for k in budgets
    ]
    both = beside(top, counts)
    return both.select("n", "p", F.explode(F.array(*entries)).alias("e")).select(
        "e.k", "e.hits",
        share(F.col("e.hits"), F.col("p")).alias("recall"),
        share(F.col("e.hits"), F.col("e.cut")).alias("precision"),
    )


def score_steps(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Rows and positives per distinct score with running counts from the top."""
    by = by or []
    steps = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p")
    )
    return frame(
        steps, by, [-F.col("score")],
        sums={"n_cum": F.col("n"), "p_cum": F.col("p")},
        totals={"n_all": F.col("n"), "p_all": F.col("p")}, inclusive=True,
    )


def ranking_areas(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """ROC area (ties half) and average precision over distinct scores; 0 on one class."""
    by = by or []
    neg, neg_all = F.col("n") - F.col("p"), F.col("n_all") - F.col("p_all")
    # positives above a step beat its negatives, positives on the step tie with them
    wins = neg * (F.col("p_cum") - F.col("p")) + 0.5 * neg * F.col("p")
    gain = share(F.col("p") * F.col("p_cum"), F.col("n_cum"))
    out = score_steps(df, score, positive, by).groupBy(*by).agg(
        F.max("n_all").alias("n"), F.max("p_all").alias("n_positive"),
        F.sum(wins).alias("__wins"), F.sum(gain).alias("__gain"), F.max(neg_all).alias("__neg"),
    )
    two = (F.col("n_positive") > 0) & (F.col("__neg") > 0)
    pairs = F.nullif(F.col("n_positive") * F.col("__neg"), F.lit(0))
    return out.select(
        *by, "n", "n_positive",
        share(F.col("n_positive"), F.col("n")).alias("prevalence"),
        F.when(two, F.col("__wins") / pairs).otherwise(0.0).alias("roc_auc"),
        F.when(two, F.col("__gain") / F.nullif(F.col("n_positive"), F.lit(0))).otherwise(0.0).alias("average_precision"),
    ).withColumn("lift", share(F.col("average_precision"), F.col("prevalence")))


def threshold_metrics(df: DataFrame, score: str, positive: str, threshold: float = 0.5, by=None) -> DataFrame:
    """Confusion counts, precision, recall and F1 at score >= threshold."""
    by = by or []
    said, real = F.col(score) >= threshold, F.col(positive)
    out = df.groupBy(*by).agg(
        F.count_if(said & real).alias("tp"), F.count_if(said & ~real).alias("fp"),
        F.count_if(~said & ~real).alias("tn"), F.count_if(~said & real).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(
        "*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(
    df: DataFrame, score: str, positive: str, seq: list[str], threshold: float = 0.5,
    budgets=(5, 10, 20, 50, 100), tops=(10, 20, 50, 100),
) -> DataFrame:
    """One row: areas, confusion and F1 at the threshold, precision and recall at each budget, and
    the share of positives that each top cut holds."""
    cuts = sorted({*budgets, *tops})
    at = global_topk(df, score, positive, seq, cuts)
    wide = at.agg(
        *[F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_at_{k}") for k in budgets for m in ("precision", "recall")],
        *[F.max(F.when(F.col("k") == k, F.col("recall"))).alias(f"captured_top_{k}") for k in tops],
    )
    return beside(beside(ranking_areas(df, score, positive), threshold_metrics(df, score, positive, threshold)), wide)


def majority_baseline(df: DataFrame, positive: str) -> DataFrame:
    """Most frequent class (a tie gives 0) and its accuracy."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p"))
    most = F.greatest(F.col("p"), F.col("n") - F.col("p"))
    return counts.select(
        F.col("n").alias("total"),
        F.when(F.col("p") > F.col("n") - F.col("p"), 1).otherwise(0).alias("majority_class"),
        share(most, F.col("n")).alias("accuracy"),
    )


def repo_precision(df, repo: str, group: list[str], score: str, positive: str, path: list[str]) -> DataFrame:
    """Per repository: prevalence, average precision if 3 <= positives < n, mean P@1, R@1, MRR."""
    per_commit = per_commit_precision(df, [repo, *group], score, positive, path)
    means = per_commit.groupBy(repo).agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(F.col("n_positive") > 0).alias("positive_changes"),
        F.avg("precision_1").alias("mean_precision_1"), F.avg("recall_1").alias("mean_recall_1"),
        F.avg("reciprocal_rank").alias("mrr"),
    )
    areas = ranking_areas(df, score, positive, [repo])
    enough = (F.col("n_positive") >= 3) & (F.col("n_positive") < F.col("n"))
    return areas.join(means, repo).select(
        repo, "n", "n_positive", "changes", "positive_changes", "prevalence",
        F.when(enough, F.col("average_precision")).alias("average_precision"),
        "mean_precision_1", "mean_recall_1", "mrr",
    )


def macro_average(repo_metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Unweighted mean over repositories, nulls left out."""
    return repo_metrics.agg(
        F.count(F.lit(1)).alias("repos"), *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )


def summarize_repos(repo_metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Median, interquartile range, min and max over repositories with positives."""
    long = repo_metrics.where(F.col("groups_with_positive") > 0).select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns
        ])).alias("m")
    ).select("m.*")
    ends = long.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    cuts = percentiles(long, ["metric"], "value", {"median": 0.5, "__q1": 0.25, "__q3": 0.75})
    return ends.join(cuts, "metric").select(
        "metric", "median", (F.col("__q3") - F.col("__q1")).alias("iqr"), "min", "max"
    )


def budget_curve(counts: DataFrame, budgets=BUDGETS) -> DataFrame:
    """Per budget: share of groups fully captured, mean recall, mean enrichment."""
    return (
        per_budget(counts.where(F.col("n_positive") > 0), [], budgets)
        .groupBy("k")
        .agg(
            F.avg(F.col("all_captured").cast("double")).alias("fraction_captured"),
            F.avg("recall").alias("mean_recall"), F.avg("enrichment").alias("mean_enrichment"),
        )
    )


def dominance(df: DataFrame, repo: str, positive: str, limit: float = 0.5) -> DataFrame:
    """Positives per repository, their share, and a flag above the limit."""
    counts = df.where(F.col(positive)).groupBy(repo).agg(F.count(F.lit(1)).alias("positives"))
    total = counts.agg(F.sum("positives").alias("__all"))
    return beside(counts, total).select(
        repo, "positives", (F.col("positives") / F.col("__all")).alias("share"),
        (F.col("positives") / F.col("__all") > limit).alias("dominant"),
    )
