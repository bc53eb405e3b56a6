"""Populations of files by evidence, their accounting and their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.operators.attribution import COMMIT_ONLY, MODERATE, PARTIAL, STRONG, UNKNOWN, WEAK
from patchsieve.operators.diffs import NO_FILE
from patchsieve.operators.frames import beside, first_rows, frame, reused, spread
from patchsieve.operators.history import DAY, micros
from patchsieve.operators.metrics import share
from patchsieve.operators.stats import distribution

# fixed values: population names
POPULATIONS = (
    "OBSERVED_POSITIVE", "EVIDENCE_MODERATE", "EVIDENCE_WEAK", "EVIDENCE_UNKNOWN", "UNLABELED", "OUT_OF_SCOPE",
)
POSITIVE, EV_MODERATE, EV_WEAK, EV_UNKNOWN, UNLABELED, OUT_OF_SCOPE = POPULATIONS
SPLITS = ("train", "validation", "test")
# fixed values: pair categories
PAIRS = {
    "STRONG_vs_WEAK": (STRONG, WEAK), "STRONG_vs_UNKNOWN": (STRONG, UNKNOWN),
    "WEAK_vs_UNKNOWN": (WEAK, UNKNOWN), "STRONG_vs_MODERATE": (STRONG, MODERATE),
}


def supervision_populations(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Population of each file from its evidence row; ``evidence`` has one row per (repo, sha, path)."""
    level = F.col("level")
    joined = rows.join(evidence.select("repo", "sha", "path", "level", F.lit(True).alias("__ev")), ["repo", "sha", "path"], "left")
    return joined.withColumn(
        "population",
        F.when(F.contains("path", F.lit(NO_FILE)), OUT_OF_SCOPE).when(F.col("__ev").isNull(), UNLABELED)
        .when(level == STRONG, POSITIVE).when(level == MODERATE, EV_MODERATE).when(level == WEAK, EV_WEAK)
        .when(F.coalesce(level, F.lit(UNKNOWN)) == UNKNOWN, EV_UNKNOWN).otherwise(UNLABELED),
    ).drop("__ev")


def supervision_sets(rows: DataFrame, categories: DataFrame, shared: DataFrame) -> DataFrame:
    """Role of every raw row from the path overlap of its change; duplicates are kept.

    ``categories``  sha, category        ``shared``  sha, path (paths in both changes)
    """
    joined = rows.join(categories.select("sha", "category"), "sha", "left").join(
        shared.select("sha", "path", F.lit(True).alias("__both")).distinct(), ["sha", "path"], "left"
    )
    both = F.coalesce("__both", F.lit(False))
    return joined.withColumn(
        "role",
        F.when(F.col("path") == NO_FILE, "out_of_scope")
        .when((F.col("category") == PARTIAL) & both, "observed_path_associated")
        .when((F.col("category") == COMMIT_ONLY) & both, "sensitivity_commit_only_overlap").otherwise("unlabeled"),
    ).drop("__both")


def population_metadata(populated: DataFrame) -> DataFrame:
    """Counts, distinct changes and repositories and the time range of each population."""
    return populated.groupBy("population").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("sha").alias("commits"), F.count_distinct("repo").alias("repos"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def disjointness(populated: DataFrame, key: list[str]) -> DataFrame:
    """Named pair checks: keys that lie in both populations, and if there are none."""
    checks = (
        ("OP_intersect_EW", POSITIVE, EV_WEAK), ("OP_intersect_EU", POSITIVE, EV_UNKNOWN),
        ("EW_intersect_EU", EV_WEAK, EV_UNKNOWN), ("OP_intersect_EM", POSITIVE, EV_MODERATE),
        ("EM_intersect_EW", EV_MODERATE, EV_WEAK), ("EM_intersect_EU", EV_MODERATE, EV_UNKNOWN),
    )
    flags = populated.groupBy(*key).agg(*[F.max(F.col("population") == p).alias(p) for p in POPULATIONS])
    counts = flags.agg(*[F.count_if(F.col(a) & F.col(b)).alias(name) for name, a, b in checks])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(name).alias("keys")) for name, _, _ in checks
    ])).alias("c")).select("c.check", "c.keys", (F.col("c.keys") == 0).alias("ok"))


def reconcile(populated: DataFrame, split: str = "split") -> DataFrame:
    """Parts and whole, per split and overall, with a warning for empty parts."""
    out = populated.rollup(split).agg(
        F.grouping(split).alias("overall"), F.count(F.lit(1)).alias("raw_total"),
        *[F.count_if(F.col("population") == p).alias(p.lower()) for p in POPULATIONS],
        F.count_distinct(F.when(F.col("population") == POSITIVE, F.col("repo"))).alias("repos_with_signal"),
        F.count_distinct("repo").alias("repos"),
    )
    parts = sum((F.col(p.lower()) for p in POPULATIONS), F.lit(0))
    return out.select(
        F.when(F.col("overall") == 1, "all").otherwise(F.col(split)).alias("split"),
        "raw_total", *[p.lower() for p in POPULATIONS], "repos_with_signal", "repos",
        (parts == F.col("raw_total")).alias("reconciled"),
        F.when(F.col("observed_positive") == 0, "zero observed rows").when(F.col("repos_with_signal") == 0, "no repositories with signal").alias("warning"),
    )


def pu_labels(rows: DataFrame, populated: DataFrame, mode: str = "primary") -> DataFrame:
    """Label 1 for positives, 0 for the rest, and which rows take part.

    primary: weak and unknown evidence stays out; sensitivity: it joins the
    unlabeled rows. The label of a row left out is 0 all the same, so a step that
    only looks at the label takes it for unlabeled; ``included`` tells.
    """
    if mode not in ("primary", "sensitivity"):
        raise ValueError(f"unknown mode {mode}")
    is_ = lambda p: F.max(F.col("population") == p)
    flags = populated.groupBy("sha", "path").agg(
        is_(POSITIVE).alias("__p"), is_(EV_WEAK).alias("__w"), is_(EV_UNKNOWN).alias("__u"), is_(OUT_OF_SCOPE).alias("__o")
    )
    joined = rows.join(flags, ["sha", "path"], "left").fillna(False, ["__p", "__w", "__u", "__o"])
    positive = F.col("__p") & ~F.col("__o")
    aside = (F.col("__w") | F.col("__u")) & F.lit(mode == "primary")
    return joined.withColumn("label", positive.cast("int")).withColumn(
        "included", ~F.col("__o") & (F.col("__p") | ~aside)
    ).drop("__p", "__w", "__u", "__o")


def pu_accounting(rows: DataFrame, seq: list[str], role: str = "role") -> DataFrame:
    """Counts per split after folding equal (sha, path), the last row wins."""
    last = rows.groupBy("split", "sha", "path").agg(F.max_by(role, F.struct(*seq)).alias("role"))
    is_ = lambda r: F.count_if(F.col("role") == r)
    return last.groupBy("split").agg(
        F.count(F.lit(1)).alias("keys"), is_("observed_path_associated").alias("p"), is_("unlabeled").alias("u"),
        is_("sensitivity_commit_only_overlap").alias("s"), is_("out_of_scope").alias("o"),
    )


def pair_counts(files: DataFrame, group: list[str]) -> DataFrame:
    """Pairs per group and category of files with a known identity.

    The pairs of a group are the product of two level counts; they are counted
    and never built, since one large change would give the square of its files.
    """
    levels = sorted({x for pair in PAIRS.values() for x in pair})
    counted = files.where(F.col("identity")).groupBy(*group).agg(
        *[F.count_if(F.col("level") == x).alias(x) for x in levels]
    )
    return counted.select(*group, F.explode(F.array(*[
        F.struct(F.lit(name).alias("category"), (F.col(a) * F.col(b)).alias("pairs")) for name, (a, b) in PAIRS.items()
    ])).alias("p")).select(*group, "p.*").where(F.col("pairs") > 0)


def aligned_pairs(files: DataFrame, group: list[str], seq: list[str], strong=STRONG, weak=WEAK) -> DataFrame:
    """Each file of the larger side with one of the other, in turn: (group, strong_seq, weak_seq).

    Linear in the files: file i of the larger side meets file i mod m of the
    smaller one. Used to fit on differences, where the product would be needed.
    """
    sided = files.where(F.col("identity") & F.col("level").isin(strong, weak))
    place = F.struct(*seq)
    ranked = frame(
        sided.select(*group, *seq, "level"), [*group, "level"], [F.col(c) for c in seq], row="__i",
        totals={"__m": F.lit(1).cast("long")},
    )
    def side(level, mark):
        return ranked.where(F.col("level") == level).select(
            *group, (F.col("__i") - 1).alias(f"__i{mark}"), F.col("__m").alias(f"__m{mark}"), place.alias(mark)
        )
    sizes = ranked.groupBy(*group).agg(
        F.count_if(F.col("level") == strong).alias("__s"), F.count_if(F.col("level") == weak).alias("__w")
    ).where((F.col("__s") > 0) & (F.col("__w") > 0))
    steps = sizes.select(*group, "__s", "__w", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("__s", "__w") - 1)).alias("__t"))
    steps = steps.withColumn("__is", F.col("__t") % F.col("__s")).withColumn("__iw", F.col("__t") % F.col("__w"))
    s = side(strong, "s")
    w = side(weak, "w")
    return steps.join(s.select(*group, "__is", "s"), [*group, "__is"]).join(w.select(*group, "__iw", "w"), [*group, "__iw"]).select(
        *group, "s", "w"
    )


def strong_weak_pairs(
    files: DataFrame, group: list[str], seq: list[str], most: int | None = None, strong=STRONG, weak=WEAK, also: list[str] | None = None,
) -> DataFrame:
    """The pairs of a strong and a weak file of a change: (group, s, w), structs of ``seq`` and the columns of ``also``.

    All pairs are given: every strong file is dealt the numbers of the weak files and meets them one by one, so no
    task holds a product. With ``most``, the pairs of all changes are numbered through by running counts of their
    products (pair p of a change is strong file p div w with weak file p mod w); up to ``most`` pairs are given
    all, of more every k-th over all changes, so at most ``most`` rows come out.
    """
    file = F.struct(*seq, *(also or []))
    if most is None:
        own = files.where(F.col("identity") & F.col("level").isin(strong, weak)).select(*group, *seq, "level", *(also or []))
        is_weak = (F.col("level") == weak).cast("long")
        placed = reused(frame(own, group, [F.col(c) for c in seq], sums={"__iw": is_weak}, totals={"__w": is_weak}, inclusive=True))
        dealt = spread(placed.where((F.col("level") == strong) & (F.col("__w") > 0)).select(*group, file.alias("s"), "__w"))
        dealt = dealt.select(*group, "s", F.explode(F.sequence(F.lit(1).cast("long"), "__w")).alias("__iw"))
        others = placed.where(F.col("level") == weak).select(*group, "__iw", file.alias("w"))
        return dealt.join(others, [*group, "__iw"]).select(*group, "s", "w")
    sided = files.where(F.col("identity") & F.col("level").isin(strong, weak))
    ranked = frame(sided.select(*group, *seq, "level", *(also or [])), [*group, "level"], [F.col(c) for c in seq], row="__i")
    sizes = sided.groupBy(*group).agg(
        F.count_if(F.col("level") == strong).alias("__s"), F.count_if(F.col("level") == weak).alias("__w")
    ).where((F.col("__s") > 0) & (F.col("__w") > 0))
    product = F.col("__s") * F.col("__w")
    placed = beside(frame(sizes, [], [F.col(c) for c in group], sums={"__before": product}), sizes.agg(F.sum(product).alias("__all")))
    step = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("__all") / most))
    placed = placed.withColumn("__step", step).withColumn("__first", F.ceil(F.col("__before") / F.col("__step")) * F.col("__step"))
    taken = placed.where(F.col("__first") < F.col("__before") + product).select(
        *group, "__w", "__before", F.explode(F.sequence("__first", F.col("__before") + product - 1, F.col("__step"))).alias("__p"))
    own = F.col("__p") - F.col("__before")
    numbers = taken.select(*group, (F.floor(own / F.col("__w")) + 1).alias("__is"), (own % F.col("__w") + 1).alias("__iw"))

    def side(level: str, mark: str) -> DataFrame:
        return ranked.where(F.col("level") == level).select(*group, F.col("__i").alias(f"__i{mark}"), file.alias(mark))

    return numbers.join(side(strong, "s"), [*group, "__is"]).join(side(weak, "w"), [*group, "__iw"]).select(*group, "s", "w")


def pair_stats(pairs: DataFrame, sha: str = "sha") -> DataFrame:
    return pairs.groupBy("category").agg(
        F.sum("pairs").alias("pairs"), F.count_distinct("repo").alias("repos"), F.count_distinct(sha).alias("commits")
    )


def pair_leaders(pairs: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k repositories (or changes) with most pairs per category."""
    summed = pairs.groupBy("category", column).agg(F.sum("pairs").alias("pairs"))
    return first_rows(summed, ["category"], [-F.col("pairs"), F.col(column)], k, "place")


def pairs_by_split(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    known = pairs.join(manifest.select("repo", "split"), "repo").where(F.col("split").isin(*SPLITS))
    return known.groupBy("category", "split").agg(
        F.sum("pairs").alias("pairs"), F.count_distinct("sha").alias("commits"), F.count_distinct("repo").alias("repos")
    )


def observation_time(changes: DataFrame, positive_files: DataFrame) -> DataFrame:
    """Days from each change, and from each positive file, to the end of its repository.

    Long form of two distributions plus the censoring counts against the overall
    median. ``changes``: repo, sha, ts; ``positive_files``: repo, sha.
    """
    ends = changes.groupBy("repo").agg(F.max(micros(F.col("ts"))).alias("__end"))
    aged = changes.where(F.col("ts").isNotNull()).join(ends, "repo").select(
        "repo", "sha", ((F.col("__end") - micros(F.col("ts"))) / (DAY * 1_000_000.0)).alias("days")
    )
    positive = positive_files.select("repo", "sha").join(aged, ["repo", "sha"])
    both = reused(aged.select(F.lit("all").alias("population"), "days").unionByName(
        positive.select(F.lit("positive").alias("population"), "days")
    ))
    dist = distribution(both, "days", ["population"])
    median = dist.where(F.col("population") == "all").agg(F.max("median").alias("__median"))
    counts = beside(both, median).agg(
        F.count_if(F.col("population") == "positive").alias("event_observed"),
        F.count_if((F.col("population") == "all") & (F.col("days") > F.col("__median"))).alias("right_censored"),
        F.count_if(F.col("population") == "all").alias("__all"),
    ).withColumn(
        "insufficient_history",
        F.greatest(F.lit(0).cast("long"), F.col("__all") - F.col("event_observed") - F.col("right_censored")),
    ).drop("__all")
    return beside(dist, counts)


def signal_coverage(files: DataFrame, types: str = "evidence_types") -> DataFrame:
    """Files per evidence tag and per pair of tags (six tags a file at most)."""
    single = files.select(F.explode(types).alias("a")).select("a", F.col("a").alias("b"))
    pair = files.select(types, F.explode(types).alias("a")).select("a", F.explode(types).alias("b")).where(F.col("a") < F.col("b"))
    return single.unionByName(pair).groupBy("a", "b").agg(F.count(F.lit(1)).alias("files"))


def matched_controls(populated: DataFrame) -> DataFrame:
    is_ = lambda p: F.count_if(F.col("population") == p)
    return populated.groupBy("repo").agg(is_(POSITIVE).alias("positive"), is_(UNLABELED).alias("unlabeled")).orderBy(
        F.desc("positive"), F.desc("unlabeled"), "repo"
    )


# fixed values: names that must not be features, and the name of the repository column
FORBIDDEN = (
    "label_source", "corrective_sha", "content_correspondence", "content_restoration",
    "region_overlap", "function_analysis", "evidence_types", "file_evidence_level",
)
REPOSITORY = "repo_name"


def leakage_audit(names: DataFrame) -> DataFrame:
    """Per feature name (column feature): whether it is forbidden or the repository, and PASS or FAIL.

    Any other name passes. A feature table passes if all its names do.
    """
    used = names.select("feature").distinct()
    forbidden, repository = F.col("feature").isin(*FORBIDDEN), F.col("feature") == REPOSITORY
    return used.select(
        "feature", forbidden.alias("forbidden"), repository.alias("repository"),
        F.when(forbidden | repository, "FAIL").otherwise("PASS").alias("result"),
    )


def split_audit(rows: DataFrame) -> DataFrame:
    """Per split: rows per label, prevalence, repositories, positive changes."""
    is_ = lambda v: F.count_if(F.col("defect_label") == v)
    out = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), is_(1).alias("positive"), is_(0).alias("negative"), is_(-1).alias("ambiguous"),
        F.count_distinct("repo").alias("repos"),
        F.count_distinct(F.when(F.col("defect_label") == 1, F.col("sha"))).alias("positive_commits"),
    )
    return out.withColumn("prevalence", share(F.col("positive"), F.col("rows")))


def split_overlap(rows: DataFrame, column: str) -> DataFrame:
    """Names of a column that lie in two or three splits (one row)."""
    has = lambda s: F.max(F.col("split") == s)
    flags = rows.groupBy(column).agg(*[has(s).alias(s) for s in SPLITS])
    a, b, c = (F.col(s) for s in SPLITS)
    return flags.agg(
        F.count_if(a & b).alias("train_val"), F.count_if(a & c).alias("train_test"),
        F.count_if(b & c).alias("val_test"), F.count_if(a & b & c).alias("all_three"),
    )


def positives_in_several_splits(rows: DataFrame) -> DataFrame:
    return (
        rows.where(F.col("defect_label") == 1).groupBy("repo")
        .agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("positive"))
        .where(F.col("splits") > 1)
    )
