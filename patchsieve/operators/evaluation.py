"""The whole evaluation of a scored population in one long table with its digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchsieve.operators import metrics as M
from patchsieve.operators.frames import reused
from patchsieve.operators.stats import bootstrap_ci, unpivoted
from patchsieve.sources.contracts import fingerprint

_UNITS = 10_000  # the digest is over values in these parts of one


def _named(df: DataFrame, part: str, name: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), "metric", F.col("value").cast("double").alias("value"))


def evaluation_report(
    scored: DataFrame, repo: str, group: list[str], seq: list[str], score: str, positive: str, malformed: str | None = None,
    replicates: int = 1000, seed: int = 42, budgets=M.BUDGETS,
) -> DataFrame:
    """(part, name, metric, value): population, overall, repository, global and interval metrics, and the digest.

    ``scored``  repo, group, seq, score, positive; with ``malformed`` a flag of rows that are counted, not ranked

    Files are ranked once and folded to one row per change, which is written; the overall metrics, those of
    every repository and the intervals come from these rows. The digest is a row of its own (part
    ``digest``, its short form as name) over all others, whatever their order.
    """
    whole = F.lit("all")
    flagged = F.col(malformed) if malformed else F.lit(False)
    well = scored.where(~flagged)
    ranked = M.rank_in_group(well.select(repo, *group, *seq, score, positive), [repo, *group], score, [F.col(c) for c in seq])
    counts = reused(M.group_counts(ranked, [repo, *group], positive, budgets))

    def long(df: DataFrame, keys: list[str]) -> DataFrame:
        return unpivoted(df, keys, [c for c in df.columns if c not in keys], "metric")

    rows, hits = F.sum("n_files"), F.sum("n_positive")
    # one row per repository first, so that nothing distinct is shuffled again
    per_repo = counts.groupBy(repo).agg(rows.alias("files"), hits.alias("positives"), F.count(F.lit(1)).alias("changes"))
    population = per_repo.agg(
        F.sum("files").alias("files"), F.sum("positives").alias("positives"), F.sum("changes").alias("changes"), F.count(F.lit(1)).alias("repositories"),
        M.share(F.sum("positives"), F.sum("files")).alias("positive_rate"))
    parts = [_named(long(population, []), "population", whole)]
    if malformed:
        broken = scored.where(flagged).groupBy(repo, *group).agg(F.count(F.lit(1)).alias("n"))
        parts.append(_named(long(broken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("malformed_files"), F.count(F.lit(1)).alias("changes_in_part")), []), "population", whole))
    parts.append(_named(long(M.aggregate_group_metrics(counts, None, budgets), []), "overall", whole))
    parts.append(_named(long(M.aggregate_group_metrics(counts, [repo], budgets).join(per_repo.select(repo, "files"), repo), [repo]), "repository", F.col(repo)))
    top = M.global_topk(well, score, positive, [repo, *group, *seq], budgets)
    top = top.select("k", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("value")) for m in ("hits", "recall", "precision")])).alias("e"))
    parts.append(_named(top.select(F.concat("e.m", F.lit("_"), "k").alias("metric"), "e.value"), "global", whole))
    ends = bootstrap_ci(counts, [repo, *group], replicates, seed, budgets)
    ends = ends.select(F.col("metric").alias("of"), F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in ("mean", "ci_lower", "ci_upper")])).alias("e"))
    parts.append(_named(ends.select("of", F.col("e.m").alias("metric"), "e.value"), "interval", F.col("of")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    # a few rows for each repository
    report = reused(report)
    line = F.concat_ws("|", "part", "name", "metric", F.floor(F.col("value") * _UNITS + 0.500001).cast("long").cast("string"))
    digest = fingerprint(report.select(line.alias("line")), ["line"])
    return report.unionByName(digest.select(F.lit("digest").alias("part"), F.col("short").alias("name"), F.lit("digest").alias("metric"), F.lit(None).cast("double").alias("value")))
