"""Statistics over rankings, scores and populations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchsieve.functions.messages import SIZE_BUCKETS, size_bucket
from patchsieve.operators.frames import beside, frame, number_rows, percentiles, reused, summary
from patchsieve.operators.metrics import BUDGETS, budget_values, score_steps, share
from patchsieve.operators.ranking import hashed_ints

# ---- bootstrap ------------------------------------------------------------------

_RANGE_GROUPS = 8_192  # a range's draws are counted in a table of this width, one row per replicate


def metric_columns(budgets=BUDGETS) -> dict[str, Column]:
    """Per-group metrics of ``group_counts`` rows, null without positives."""
    some = F.col("n_positive") > 0
    out = {"mrr": F.col("reciprocal_rank"), "first_rank": F.col("first_rank").cast("double")}
    for k in budgets:
        recall, enrichment, captured = budget_values(k)
        out[f"recall_{k}"] = F.when(some, recall)
        out[f"enrichment_{k}"] = F.when(some, enrichment)
        out[f"captured_{k}"] = F.when(some, captured.cast("double"))
    return out


def _pack_draws(replicates: int, seed: int, n: int, span: int):
    """(range, draws): what the groups of a batch draw, dealt to ranges of `span` groups.

    Every group makes its own draw in every replicate. A draw takes four bytes, its place in the range and
    its replicate, and the draws of many groups go along in one row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replicate = np.arange(replicates, dtype=np.int64)[None]
        for batch in batches:
            own = batch.column("idx").to_numpy()
            for lo in range(0, len(own), 1_000):
                drawn = hashed_ints(seed, replicate, own[lo:lo + 1_000, None]) % n
                order = np.argsort(drawn, axis=None, kind="stable")
                drawn = drawn.ravel()[order]
                packed = np.empty((len(order), 2), np.uint16)
                packed[:, 0], packed[:, 1] = drawn % span, order % replicates
                at = drawn // span
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                rows = [packed[s:e].tobytes() for s, e in zip(first, [*first[1:], len(at)])]
                yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(rows, pa.binary())], names=["range", "draws"])
    return run


def _fold_draws(names: list[str], replicates: int, span: int, once: bool):
    """Per replicate, the sums and counts of the metrics of the groups of a range that were drawn."""
    def run(groups: pa.Table, draws: pa.Table) -> pa.Table:
        values = np.column_stack([groups.column(c).to_numpy().astype(float) for c in names])
        place = groups.column("idx").to_numpy() % span
        there = ~np.isnan(values)
        packed = np.frombuffer(b"".join(x for part in draws.column("draws").chunks for x in part.to_pylist()), np.uint16).reshape(-1, 2)
        drawn = np.bincount(packed[:, 1] * np.int64(span) + packed[:, 0], minlength=replicates * span).reshape(replicates, span)[:, place]
        times = (drawn > 0 if once else drawn).astype(float)
        sums, counts = times @ np.where(there, values, 0.0), times @ there.astype(float)
        columns = [pa.array(np.arange(replicates), pa.int32())] + [pa.array(c) for c in np.hstack([sums, counts]).T.copy()]
        return pa.table(columns, names=["replicate", *[f"s_{c}" for c in names], *[f"c_{c}" for c in names]])
    return run


def _replicate_means(numbered: DataFrame, names: list[str], replicates: int, seed: int, once: bool = False) -> DataFrame:
    """Means of the drawn groups' metrics, one row per replicate; nulls are left out, nothing drawn gives 0.

    ``numbered``  idx from 0 without gaps, and the metrics. As many draws as groups are made in every
    replicate; with ``once`` a group counts once in a replicate. Groups are cut into ranges of a bounded
    size, the draws travel to their range in packed form, and a range gives one row per replicate.
    """
    n = numbered.count()
    partitions = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = max(1, min(_RANGE_GROUPS, -(-n // partitions)))
    draws = numbered.select("idx").mapInArrow(_pack_draws(replicates, seed, n, span), "range long, draws binary")
    placed = numbered.withColumn("range", F.floor(F.col("idx") / span))
    schema = "replicate int, " + ", ".join([f"s_{c} double" for c in names] + [f"c_{c} double" for c in names])
    parts = placed.groupBy("range").cogroup(draws.groupBy("range")).applyInArrow(_fold_draws(names, replicates, span, once), schema)
    return parts.groupBy("replicate").agg(*[
        F.coalesce(share(F.sum(f"s_{c}"), F.sum(f"c_{c}")), F.lit(0.0)).alias(c) for c in names])


def _number_groups(groups: DataFrame, key: list[str]) -> DataFrame:
    numbered = number_rows(reused(groups), [], [F.col(c) for c in key], "__i")
    return reused(numbered.withColumn("idx", F.col("__i") - 1).drop("__i"))


def _interval(per_replicate: DataFrame, names: list[str]) -> DataFrame:
    """Mean and 95 % interval over the replicates (one row each, a fixed number)."""
    long = per_replicate.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names
    ])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("ci_lower"),
        F.percentile("value", F.lit(0.975)).alias("ci_upper"),
    )


def bootstrap_ci(
    counts: DataFrame, key: list[str], replicates: int = 1000, seed: int = 42, budgets=BUDGETS
) -> DataFrame:
    """Intervals of the macro metrics; a group drawn twice counts twice."""
    metrics = metric_columns(budgets)
    numbered = _number_groups(counts.select(*key, *[e.alias(n) for n, e in metrics.items()]), key).drop(*key)
    return _interval(_replicate_means(numbered, list(metrics), replicates, seed), list(metrics))


def paired_bootstrap(
    counts: DataFrame, other: DataFrame, key: list[str], replicates: int = 1000, seed: int = 42,
    budgets=BUDGETS, with_recall: bool = False,
) -> DataFrame:
    """Interval of the difference of two rankings on the same draws.

    A group drawn twice counts once here. One form compares enrichment and MRR,
    the other adds recall.
    """
    names = ["mrr"] + [f"enrichment_{k}" for k in budgets]
    if with_recall:
        names += [f"recall_{k}" for k in budgets]
    def sides(df, mark):
        metrics = metric_columns(budgets)
        return df.select(*key, *[metrics[n].alias(f"{mark}_{n}") for n in names])
    joined = sides(counts, "a").join(sides(other, "b"), key)
    # the same groups have positives in both rankings, so the difference of the means
    # is the mean of the differences
    gaps = joined.select(*key, *[(F.col(f"a_{n}") - F.col(f"b_{n}")).alias(n) for n in names])
    numbered = _number_groups(gaps, key).drop(*key)
    return _interval(_replicate_means(numbered, names, replicates, seed, once=True), names)


# ---- two samples ------------------------------------------------------------------


def ks_two_sample(df: DataFrame, value: str, positive: str) -> DataFrame:
    """Largest distance of the two distribution functions, asymptotic p-value."""
    p, n = F.col("p_cum"), F.col("n_cum") - F.col("p_cum")
    p_all, n_all = F.col("p_all"), F.col("n_all") - F.col("p_all")
    gap = F.abs(share(p, p_all) - share(n, n_all))
    out = score_steps(df, value, positive).agg(
        F.max(p_all).alias("n1"), F.max(n_all).alias("n2"), F.max(gap).alias("ks")
    )
    lam = F.sqrt(share(F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2"))) * F.col("ks")
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    one = F.lit(1.0)
    two = (F.col("n1") > 0) & (F.col("n2") > 0)
    return out.select(
        "n1", "n2", F.when(two, F.col("ks")).otherwise(0.0).alias("ks"),
        F.when(two & (lam > 0.2), F.greatest(F.lit(0.0), F.least(one, tail))).otherwise(one).alias("p_value"),
    )


def two_sided(z: Column) -> Column:
    """Two-sided normal tail; rational approximation with error below 2e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(df: DataFrame, value: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """U of the positives with tie-averaged ranks, effect size 1 - 2U/(n1 n2), normal p."""
    by = by or []
    steps = df.groupBy(*by, F.col(value).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p")
    )
    placed = frame(steps, by, [F.col("score")], sums={"before": F.col("n")})
    n = F.col("n").cast("double")
    out = placed.groupBy(*by).agg(
        F.sum("p").alias("n1"), (F.sum("n") - F.sum("p")).alias("n2"),
        F.sum(F.col("p") * (F.col("before") + (n + 1) / 2)).alias("__ranks"),
        F.sum(n * n * n - n).alias("__ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    out = out.withColumn("u", F.col("__ranks") - n1 * (n1 + 1) / 2)
    total = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (total + 1 - share(F.col("__ties"), total * (total - 1))))
    z = share(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, spread)
    return out.select(
        *by, "n1", "n2", "u", (F.lit(1.0) - share(2 * F.col("u"), n1 * n2, 1.0)).alias("effect_size"),
        F.least(F.lit(1.0), two_sided(F.greatest(z, F.lit(0.0)))).alias("p_value"),
    )


# ---- one sample -------------------------------------------------------------------

_POINTS = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, exact percentiles, population deviation, IQR, ends; zeros when empty."""
    moments = {m: m for m in ("count", "mean", "std", "min", "max")}
    out = summary(df, by or [], value, _POINTS, moments)
    return out.withColumn("iqr", F.col("p75") - F.col("p25")).fillna(0.0)


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name="feature", value="value") -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns
    ])).alias("__u")).select(*keys, "__u.*")


def seed_stability(results: DataFrame, by: list[str], seed: str, metrics: list[str]) -> DataFrame:
    """Mean, deviation and their ratio over seeds, with two seeds at least."""
    long = unpivoted(results, [*by, seed], metrics, "metric")
    out = long.groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    return out.where(F.col("n_seeds") >= 2).withColumn("cv", share(F.col("std"), F.col("mean")))


def score_gap(df: DataFrame, score: str, positive: str) -> DataFrame:
    pos, rest = F.when(F.col(positive), F.col(score)), F.when(~F.col(positive), F.col(score))
    zero = F.lit(0.0)
    out = df.agg(
        F.coalesce(F.avg(pos), zero).alias("positive_mean"), F.coalesce(F.stddev_pop(pos), zero).alias("positive_std"),
        F.coalesce(F.avg(rest), zero).alias("unlabeled_mean"), F.coalesce(F.stddev_pop(rest), zero).alias("unlabeled_std"),
        F.count_if(positive).alias("__p"),
    )
    gap = F.when(F.col("__p") > 0, F.col("positive_mean") - F.col("unlabeled_mean")).otherwise(0.0)
    return out.withColumn("score_gap", gap).drop("__p")


def class_mean_ratio(long: DataFrame, positive: str) -> DataFrame:
    """Mean per feature and class; the ratio is infinite over a class mean of zero or less."""
    out = long.groupBy("feature").agg(
        F.coalesce(F.avg(F.when(F.col(positive), F.col("value"))), F.lit(0.0)).alias("positive_mean"),
        F.coalesce(F.avg(F.when(~F.col(positive), F.col("value"))), F.lit(0.0)).alias("negative_mean"),
    )
    n = F.col("negative_mean")
    return out.withColumn(
        "ratio", F.when(n > 0, F.col("positive_mean") / F.nullif(n, F.lit(0.0))).otherwise(F.lit(float("inf")))
    )


def ablation_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """b - a per metric and the change in percent (null from zero)."""
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    joined = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "metric", "full_outer")
    return joined.select(
        "metric", F.round(x, 6).alias("a"), F.round(y, 6).alias("b"), F.round(y - x, 6).alias("delta"),
        F.when(x != 0, F.round((y - x) / F.nullif(x, F.lit(0.0)) * 100, 2)).alias("pct_change"),
    )


# ---- observed positives -------------------------------------------------------------

POSITIVE_BUDGETS = (5, 10, 20, 50, 100, 200, 500)


def observed_positive_ranking(
    df: DataFrame, score: str, positive: str, key: list[str], seq: list[str], budgets=POSITIVE_BUDGETS
) -> DataFrame:
    """Recall and enrichment at K over the whole table, by the first rank of each positive key."""
    ranked = number_rows(df, [], [-F.col(score), *map(F.col, seq)], "rank")
    first = reused(ranked.where(F.col(positive)).groupBy(*key).agg(F.min("rank").alias("rank")))
    n = df.agg(F.count(F.lit(1)).alias("n_total"))
    hits = first.agg(
        F.count(F.lit(1)).alias("n_positive"), F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") <= 10).alias("top_10"),
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in budgets],
    )
    one = beside(beside(hits, n), percentiles(first, [], "rank", {"median_rank": 0.5}))
    p, total = F.col("n_positive"), F.col("n_total")
    return one.select(
        "n_total", "n_positive", F.coalesce("mean_rank", total.cast("double")).alias("mean_rank"),
        F.coalesce("median_rank", total.cast("double")).alias("median_rank"), "top_10",
        *[share(F.col(f"hits_{k}"), p).alias(f"recall_{k}") for k in budgets],
        *[F.when(p > 0, (F.col(f"hits_{k}") / F.lit(k)) / F.nullif(p / total, F.lit(0.0))).otherwise(1.0).alias(f"enrichment_{k}")
          for k in budgets],
    )


def expected_random(df: DataFrame, positive: str, budgets=POSITIVE_BUDGETS) -> DataFrame:
    """What a random order is expected to give."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("p"))
    n, p = F.col("n"), F.col("p")
    entries = [F.struct(F.lit(k).alias("k"), F.least(F.lit(k), n).alias("cut")) for k in budgets]
    return counts.select("n", "p", F.explode(F.array(*entries)).alias("e")).select(
        "n", "p", "e.k", share(F.col("e.cut"), n).alias("expected_recall"),
        share(F.col("e.cut") * p, n).alias("expected_positives"), F.lit(1.0).alias("expected_enrichment"),
        ((n + 1) / 2).alias("expected_mean_rank"),
    )


def pairwise_accuracy(df: DataFrame, group: list[str], score: str, level: str, strong, weak, seq: list[str]) -> DataFrame:
    """Share of strong-weak pairs of a group in which the strong file scores higher; 0.5 without pairs.

    Counted from the running number of weak files, so no pair is built.
    """
    sided = df.where(F.col(level).isin(strong, weak)).withColumn("__w", (F.col(level) == weak).cast("long"))
    counted = frame(
        sided, group, [F.col(score), F.col("__w"), *map(F.col, seq)],
        sums={"__below": F.col("__w")}, totals={"__weak": F.col("__w")},
    ).where(F.col("__w") == 0)
    out = counted.agg(F.sum("__weak").alias("pairs"), F.sum("__below").alias("wins"))
    return out.select(
        F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"),
        share(F.coalesce("wins", F.lit(0)), F.coalesce("pairs", F.lit(0)), 0.5).alias("accuracy"),
    )


# ---- concentration --------------------------------------------------------------------


def concentration(counts: DataFrame, name: str, n: str) -> DataFrame:
    """Top shares, Gini (zero counts included), Herfindahl and scaled entropy of counts per name."""
    counts = reused(counts)
    totals = counts.agg(F.sum(n).alias("__all"), F.count(F.lit(1)).alias("__m"))
    ranked = number_rows(counts.select(name, F.col(n).alias("__v")), [], [F.col("__v"), F.col(name)], "__i")
    row = beside(ranked, totals)
    s = share(F.col("__v"), F.col("__all"))
    from_top = F.col("__m") - F.col("__i") + 1
    out = row.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("__v") > 0).alias("with_signal"),
        F.sum(F.when(from_top <= 5, s)).alias("top_5_share"), F.sum(F.when(from_top <= 10, s)).alias("top_10_share"),
        F.sum(F.col("__i") * s).alias("__w"), F.sum(s).alias("__s"), F.sum(s * s).alias("herfindahl"),
        F.sum(F.when(s > 0, -s * F.ln(F.when(s > 0, s)))).alias("__h"),
    )
    m = F.col("total").cast("double")
    most = F.when(F.col("with_signal") > 1, F.ln(F.col("with_signal").cast("double")))
    return out.select(
        "total", "with_signal", "top_5_share", "top_10_share",
        F.when(F.col("__s") > 0, 2 * F.col("__w") / F.nullif(m * F.col("__s"), F.lit(0.0)) - (m + 1) / m).otherwise(0.0).alias("gini"),
        "herfindahl", F.when(most.isNotNull(), F.col("__h") / most).otherwise(0.0).alias("entropy"),
    )


def gini_variants(counts: DataFrame, name: str, n: str) -> DataFrame:
    """Over names with a count only: index form, and mean absolute difference of the shares.

    The sum over all pairs is 2 * sum((2 i - m - 1) x_i) in rank order, so no pair is built.
    """
    some = reused(counts.where(F.col(n) > 0))
    totals = some.agg(F.sum(n).alias("__all"), F.count(F.lit(1)).alias("__m"))
    row = beside(number_rows(some, [], [F.col(n), F.col(name)], "__i"), totals)
    weight = 2 * F.col("__i") - F.col("__m") - 1
    out = row.agg(
        F.sum(weight * F.col(n)).alias("__g"), F.max("__all").alias("__all"), F.max("__m").alias("__m"),
        F.sum(weight * F.col(n) / F.col("__all")).alias("__f"),
    )
    return out.select(
        share(F.col("__g"), F.col("__m") * F.col("__all")).alias("gini_index"),
        share(F.col("__f"), F.col("__m")).alias("gini_pairwise"),
    )


def top_share(counts: DataFrame, n: str, k: int = 5) -> DataFrame:
    top = counts.orderBy(F.desc(n)).limit(k).agg(F.sum(n).alias("__t"))
    return beside(counts.agg(F.sum(n).alias("__all")), top).select(
        share(F.col("__t"), F.col("__all")).alias(f"top_{k}_share")
    )


# ---- comparing populations -----------------------------------------------------------


def coverage_numeric(long: DataFrame, positive: str) -> DataFrame:
    """Per feature: both distributions, ratios of medians and IQRs, rank test, flag."""
    stats = distribution(long, "value", ["feature", positive])
    def side(flag, mark):
        return stats.where(F.col(positive) == flag).select(
            "feature", *[F.col(c).alias(f"{mark}_{c}") for c in ("count", "mean", "median", "std", "iqr")]
        )
    both = side(True, "observed").join(side(False, "unlabeled"), "feature")
    both = both.join(mann_whitney(long, "value", positive, ["feature"]), "feature").drop("n1", "n2")
    return both.select(
        "*", share(F.col("observed_median"), F.col("unlabeled_median"), None).alias("median_ratio"),
        share(F.col("observed_iqr"), F.col("unlabeled_iqr"), None).alias("iqr_ratio"),
        (F.col("observed_median") != F.col("unlabeled_median")).alias("notable"),
    )


def coverage_categories(df: DataFrame, category: str, positive: str) -> DataFrame:
    """Per category: counts and shares in both populations, flag on a ratio above 3 or below 0.33."""
    counts = df.groupBy(category).agg(
        F.count_if(positive).alias("observed"), F.count_if(~F.col(positive)).alias("unlabeled")
    )
    totals = counts.agg(F.sum("observed").alias("__o"), F.sum("unlabeled").alias("__u"))
    out = beside(counts, totals).select(
        category, "observed", "unlabeled", share(F.col("observed"), F.col("__o")).alias("observed_share"),
        share(F.col("unlabeled"), F.col("__u")).alias("unlabeled_share"),
    )
    ratio = share(F.col("observed_share"), F.col("unlabeled_share"), None)
    both = (F.col("observed") > 0) & (F.col("unlabeled") > 0)
    return out.withColumn("notable", F.coalesce(both & ((ratio > 3.0) | (ratio < 0.33)), F.lit(False)))


def selection_dependence(conc: DataFrame, notable: DataFrame) -> DataFrame:
    """Severities from the top-5 share and the number of notable differences, and evidence both ways.

    ``conc`` is one row of ``concentration``, ``notable`` one row with ``notable_count``.
    """
    row = beside(conc, notable)
    top, n = F.col("top_5_share"), F.col("notable_count")
    ratio = share(F.col("with_signal"), F.col("total"))
    return row.select(
        "top_5_share", "notable_count", ratio.alias("signal_ratio"),
        F.when(top > 0.7, "high").when(top > 0.5, "medium").otherwise("low").alias("repo_severity"),
        F.when(n > 5, "high").when(n > 2, "medium").otherwise("low").alias("feature_severity"),
        ((ratio > 0.3).cast("int") + (top < 0.4).cast("int")).alias("evidence_for"),
        ((ratio <= 0.3).cast("int") + (top > 0.6).cast("int") + (n > 3).cast("int")).alias("evidence_against"),
    )


def path_recommendation(row: DataFrame) -> DataFrame:
    """Rule on partial changes, unknown rate and usable negatives (one row)."""
    rate = share(F.col("unknown_files"), F.col("candidate_files"))
    return row.select(
        "*", rate.alias("unknown_rate"),
        F.when(F.col("partial_commits") == 0, "FILE_LEVEL_ATTRIBUTION_NOT_FEASIBLE")
        .when((rate > 0.8) | (F.col("negatives") == 0), "PATH_LEVEL_EVIDENCE_ONLY")
        .otherwise("FILE_LEVEL_ATTRIBUTION_FEASIBLE_WITH_RESTRICTIONS").alias("recommendation"),
    )


def recommendation_inputs(selection: DataFrame, seen: DataFrame, negative: DataFrame, splits: int = 3) -> DataFrame:
    """The row that ``pu_recommendation`` judges, from one row of each analysis.

    ``selection``  see ``selection_dependence``      ``negative``  negatives (defensible ones)
    ``seen``       observed, others (files with and without a signal), s (splits with a signal)
    Whether selection is at random cannot be tested without a negative. The two-sample statistics need both
    kinds of files, ranking metrics a signal.
    """
    c = F.col
    return beside(beside(selection, seen), negative).select(
        "negatives", "observed", "signal_ratio", (splits - c("s")).alias("empty_splits"), "notable_count", (c("negatives") == 0).alias("selection_untestable"),
        "repo_severity", (((c("observed") > 0) & (c("others") > 0)).cast("int") * 2 + (c("observed") > 0).cast("int")).alias("diagnostics"))


def pu_recommendation(row: DataFrame) -> DataFrame:
    """Rule on the number of concerns: 4 stop, 2 restrict (one row)."""
    c = F.col
    concerns = (
        (c("signal_ratio") < 0.2).cast("int") + c("empty_splits").cast("int") + (c("notable_count") > 5).cast("int")
        + c("selection_untestable").cast("int") + (c("repo_severity") == "high").cast("int") + (c("diagnostics") < 3).cast("int")
    )
    return row.select(
        "*", concerns.alias("concerns"),
        F.when(c("negatives") > 0, "BINARY_SUPERVISION_NOT_SUPPORTED").when(c("observed") == 0, "IMPROVE_ATTRIBUTION_FIRST")
        .when(concerns >= 4, "IMPROVE_ATTRIBUTION_FIRST").when(concerns >= 2, "PU_LEARNING_FEASIBLE_WITH_RESTRICTIONS")
        .otherwise("PU_LEARNING_FEASIBLE").alias("recommendation"),
    )


def proceed_recommendation(row: DataFrame) -> DataFrame:
    """Go on if weak files beat the earlier count by a fifth, or exist and need the repository."""
    w, earlier = F.col("file_weak"), F.col("partial_commits")
    return row.select(
        "*", F.when((w > earlier * 1.2) | ((w > 0) & F.col("requires_repo_access")), "PROCEED").otherwise("DO_NOT_PROCEED").alias("decision")
    )


# ---- label composition -----------------------------------------------------------------


def classify_changes(rows: DataFrame, key: list[str], label: str = "defect_label") -> DataFrame:
    """Per change: counts per label, class and share of positives."""
    is_ = lambda v: F.count_if(F.col(label) == v)
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("files"), is_(1).alias("positive"), is_(0).alias("negative"), is_(-1).alias("ambiguous")
    )
    p, n = F.col("positive"), F.col("negative")
    return out.withColumn(
        "composition",
        F.when((p > 0) & (n == 0), "all_positive").when((p > 0) & (n > 0), "mixed").when(n > 0, "all_negative")
        .otherwise("all_ambiguous"),
    ).withColumn("ratio", p / F.col("files"))


def label_composition(classified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The classes overall, by each of the given columns and by all of them."""
    is_ = lambda v: F.count_if(F.col("composition") == v)
    grouped = classified.cube(*by) if by else classified.groupBy()
    out = grouped.agg(
        F.count(F.lit(1)).alias("commits"), F.sum("files").alias("rows"), F.sum("positive").alias("positive_rows"),
        is_("all_positive").alias("all_positive"), is_("mixed").alias("mixed"),
        is_("all_negative").alias("all_negative"), is_("all_ambiguous").alias("all_ambiguous"),
    )
    pos = F.col("all_positive") + F.col("mixed")
    return out.select(
        "*", pos.alias("positive_commits"), share(100.0 * F.col("all_positive"), pos).alias("all_positive_pct"),
        share(100.0 * F.col("mixed"), pos).alias("mixed_pct"),
    )


# fixed values: sources that label a whole change, and a single file
COMMIT_SOURCES = ("explicit_sha_reference", "revert")
FILE_SOURCES = ("line_overlap",)


def _change_sources(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per change with positives and each source of its positive rows."""
    sources = rows.where(F.col("defect_label") == 1).select(*key, "label_source").distinct()
    return sources.join(classify_changes(rows, key), key)


def attribution_by_source(rows: DataFrame, key: list[str]) -> DataFrame:
    """A change's positive rows count for each of its sources."""
    return _change_sources(rows, key).groupBy("label_source").agg(
        F.count(F.lit(1)).alias("positive_commits"), F.sum("positive").alias("positive_rows"),
        F.count_if(F.col("composition") == "all_positive").alias("all_positive"),
        F.count_if(F.col("composition") == "mixed").alias("mixed"),
    )


def labeling_granularity(rows: DataFrame, key: list[str]) -> DataFrame:
    per = rows.where(F.col("defect_label") == 1).groupBy(*key).agg(
        F.max(F.col("label_source").isin(*COMMIT_SOURCES)).alias("c"), F.max(F.col("label_source").isin(*FILE_SOURCES)).alias("f")
    )
    return per.agg(
        F.count_if("c").alias("commit_level"), F.count_if("f").alias("file_level"), F.count(F.lit(1)).alias("positive_commits")
    ).withColumn("pct_commit_level", share(100.0 * F.col("commit_level"), F.col("positive_commits")))


def size_bucket_profile(classified: DataFrame) -> DataFrame:
    """Changes with positives by size bucket; empty buckets are zero."""
    names = classified.sparkSession.createDataFrame([(name,) for _, name in SIZE_BUCKETS], "bucket string")
    found = classified.where(F.col("positive") > 0).groupBy(size_bucket(F.col("files")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(F.col("composition") == "all_positive").alias("all_positive"),
        F.count_if(F.col("composition") == "mixed").alias("mixed"), F.avg("ratio").alias("mean_ratio"),
    )
    return names.join(found, "bucket", "left").fillna(0)


def suitability(composition: DataFrame, granularity: DataFrame) -> DataFrame:
    """Can files be ranked with these labels? One row of each input."""
    row = beside(composition.select("mixed"), granularity.select("pct_commit_level"))
    return row.select(
        "*", F.when(F.col("mixed") > 0, "conditionally_suitable").otherwise("not_suitable").alias("suitability"),
        F.when((F.col("mixed") == 0) & (F.col("pct_commit_level") == 100.0), "commit_level_only")
        .when((F.col("mixed") > 0) & (F.col("pct_commit_level") > 80.0), "mostly_commit_level")
        .when(F.col("mixed") > 0, "some_file_level").otherwise("no_mixed_commits").alias("reason"),
    )


def dataset_diversity(rows: DataFrame) -> DataFrame:
    """One row: positive changes and files, the largest repository and change, repositories with 1, 3, 5."""
    pos = rows.where(F.col("defect_label") == 1)
    per_change = pos.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("files"))
    per_repo = per_change.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.sum("files").alias("files"))
    repos = per_repo.agg(
        F.sum("commits").alias("positive_commits"), F.sum("files").alias("positive_files"),
        F.count(F.lit(1)).alias("repos_1"), F.count_if(F.col("commits") >= 3).alias("repos_3"),
        F.count_if(F.col("commits") >= 5).alias("repos_5"), F.max("commits").alias("largest_repo_commits"),
    )
    largest = pos.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest_commit_files"))
    return beside(repos, largest).select(
        "*", share(100.0 * F.col("largest_repo_commits"), F.col("positive_commits")).alias("largest_repo_pct"),
        share(100.0 * F.col("largest_commit_files"), F.col("positive_files")).alias("largest_commit_pct"),
    )


def diversity_breakdown(rows: DataFrame, by: tuple[str, ...] = ("repo", "label_source", "split")) -> DataFrame:
    """(part, name, positive_commits, positive_files, largest_commit_files, commits_pct) per repository, source and split.

    Positive files are folded to one row per change and combination first; a change counts once for each
    of its sources. Each part is a grouping set of that fold, and the whole table (part ``all``) is one, too.
    """
    folded = rows.where(F.col("defect_label") == 1).groupBy("sha", *by).agg(F.count(F.lit(1)).alias("n"))
    # a set at a time keeps a change's own columns and those of the set
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("name")) for c in by], F.struct(F.lit("all").alias("part"), F.lit("all").alias("name"))))
    per_change = folded.select("sha", "n", parts.alias("p")).groupBy("p.part", "p.name", "sha").agg(F.sum("n").alias("n"))
    out = per_change.groupBy("part", "name").agg(
        F.count(F.lit(1)).alias("positive_commits"), F.sum("n").alias("positive_files"), F.max("n").alias("largest_commit_files"))
    whole = out.where("part = 'all'").select(F.col("positive_commits").alias("__all"))
    return beside(out, whole).withColumn("commits_pct", share(100.0 * F.col("positive_commits"), F.col("__all"))).drop("__all")


def version_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two one-row reports side by side, one row per number."""
    names = [n for n, kind in after.dtypes if kind in ("bigint", "int", "double")]
    a, b = (unpivoted(d, [], names, "metric") for d in (before, after))
    return a.withColumnRenamed("value", "before").join(b.withColumnRenamed("value", "after"), "metric").withColumn(
        "delta", F.col("after") - F.col("before")
    )


def repo_table(levels: DataFrame) -> DataFrame:
    """Per repository: changes, share, files, attributed and unknown files, levels, splits (three at most)."""
    out = levels.groupBy("repo").agg(
        F.count(F.lit(1)).alias("commits"), F.sum("candidate_files").alias("files"),
        F.sum("overlap_files").alias("attributed_files"), F.sum("unknown_files").alias("unknown_files"),
        F.count_if(F.col("commit_evidence_level") == "COMMIT_STRONG").alias("commit_strong"),
        F.count_if(F.col("file_evidence_level") == "FILE_WEAK").alias("file_weak"),
        F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"),
    )
    total = out.agg(F.sum("commits").alias("__all"))
    return beside(out, total).withColumn("commit_fraction", F.round(F.col("commits") / F.col("__all"), 4)).drop("__all")


