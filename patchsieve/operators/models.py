"""Ranking models on whole tables with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, QuantileDiscretizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchsieve.operators import metrics as M
from patchsieve.operators import populations as P
from patchsieve.operators import ranking as R
from patchsieve.operators.features import mean_vector
from patchsieve.operators.frames import beside, reused, written
from patchsieve.operators.stats import unpivoted

# fixed values: settings of the boosted trees at file and at change level
FILE_TREES = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1}
CHANGE_TREES = {"maxIter": 100, "maxDepth": 4, "stepSize": 0.1}
BINS = 32  # fixed value: bins of a feature that trees split between
TREE_ROWS = 40_000  # fixed value: rows a task of a tree fit has; a fit is many short jobs
_BIN = "__bin_"
PAIR_PENALTY = 0.01  # fixed value: weight of the squared weights in the pairwise fit


def weighted(df: DataFrame, label: str, balanced: bool) -> DataFrame:
    """Class weights from one aggregate: n / (2 n_c), or negatives / positives on positives."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__p"))
    n, p = F.col("__n"), F.col("__p")
    positive = F.col(label) == 1
    if balanced:
        weight = M.share(n, 2.0 * F.when(positive, p).otherwise(n - p), 1.0)
    else:
        weight = F.when(positive & (p > 0), M.share(n - p, p, 1.0)).otherwise(1.0)
    return beside(df, counts).withColumn("__weight", weight).drop("__n", "__p")


def fit_balanced_logistic(train: DataFrame, features: list[str], label: str, max_iter: int = 10000) -> PipelineModel:
    """Standardised logistic model; the scaler sees the training rows only."""
    stages = [
        VectorAssembler(inputCols=features, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__x", labelCol=label, weightCol="__weight", maxIter=max_iter, standardization=False),
    ]
    return Pipeline(stages=stages).fit(weighted(train, label, balanced=True))


def binned(train: DataFrame, features: list[str], label: str) -> tuple[Bucketizer, DataFrame]:
    """The bins of the features (``__bin_...``), and the weighted training rows with one row per bins and label.

    Trees split between bins only, so rows of equal bins and label always take the same way; one row with their
    summed weight gives the same trees, and the fit does not grow with the rows.
    """
    names = [_BIN + f for f in features]
    rows = weighted(train.select(*features, label), label, balanced=False)
    bins = QuantileDiscretizer(inputCols=features, outputCols=names, numBuckets=BINS, relativeError=1e-4).fit(rows)
    equal = bins.transform(rows).groupBy(*names, label).agg(F.sum("__weight").alias("__weight"))
    # other metadata than the bucketizer's, which call the bins categories without an order
    ordered = [F.col(n).alias(n, metadata={"bin_of": f}) for n, f in zip(names, features)]
    kept = reused(equal.select(*ordered, label, "__weight"))
    return bins, kept.coalesce(kept.count() // TREE_ROWS + 1)


def fit_boosted_trees(train: DataFrame, features: list[str], label: str, seed: int = 42, **settings) -> PipelineModel:
    bins, rows = binned(train, features, label)
    trees = GBTClassifier(
        featuresCol="__raw", labelCol=label, weightCol="__weight", maxBins=BINS, seed=seed, **{**FILE_TREES, **settings}
    )
    assembler = VectorAssembler(inputCols=[_BIN + f for f in features], outputCol="__raw")
    return PipelineModel([bins, assembler, trees.fit(assembler.transform(rows))])


_WORK = ("__raw", "__x", "rawPrediction", "probability", "prediction")


def probability(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """The probability of label 1. A model on bins scores each set of bins once, and rows look theirs up."""
    first = model.stages[0]
    if isinstance(first, Bucketizer):
        bins, rows = first.getOutputCols(), first.transform(df)
        each = _scored(PipelineModel(model.stages[1:]), rows.select(*bins).distinct(), name)
        return rows.join(written(each, "scores"), bins).drop(*bins)
    return _scored(model, df, name)


def _scored(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop(*_WORK)


def margin(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("rawPrediction")[1])
    return out.drop(*_WORK)


def pu_ranker(train: DataFrame, evaluated: DataFrame, features: list[str], label: str, split: list[str] | None = None) -> DataFrame:
    """Positive against unlabeled: margin scaled to 0 .. 1 within each evaluated split."""
    scored = margin(fit_balanced_logistic(train, features, label), evaluated, "__margin")
    return R.minmax_normalize(scored, "__margin", "score", split, tolerance=0.0, few=True).drop("__margin")


def commit_level_model(
    train: DataFrame, evaluated: DataFrame, group: list[str], vector: str, size: int, positive: str, **settings
) -> DataFrame:
    """Trees on the mean vector of a change, labelled by any strong file; all its files get the score."""
    names = [f"x{i}" for i in range(size)]
    def means(df):
        mean = mean_vector(df, group, vector, size, "__mean").where(F.col("__mean").isNotNull())
        return mean.select(*group, *[F.col("__mean")[i].alias(n) for i, n in enumerate(names)])
    label = train.groupBy(*group).agg(F.max(F.col(positive).cast("int")).cast("double").alias("label"))
    model = fit_boosted_trees(means(train).join(label, group), names, "label", **{**CHANGE_TREES, **settings})
    scores = probability(model, means(evaluated)).select(*group, "score")
    return evaluated.join(scores, group, "left").fillna(0.0, ["score"])


def pair_gaps(files: DataFrame, group: list[str], seq: list[str], features: list[str], most: int | None = None) -> DataFrame:
    """(gap): feature differences of the strong and weak files of a change, for all pairs or, if given, ``most`` at most."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    pairs = P.strong_weak_pairs(files.withColumn("__v", vector), group, seq, most, also=["__v"])
    return pairs.select(F.zip_with("s.__v", "w.__v", lambda a, b: a - b).alias("gap"))


def fit_pairwise(gaps: DataFrame, max_iter: int = 1000) -> list[float]:
    """Weights of a logistic model on differences, in both directions, without an intercept."""
    rows = gaps.select(F.explode(F.array(
        F.struct(F.col("gap").alias("x"), F.lit(1.0).alias("label")),
        F.struct(F.transform("gap", lambda g: -g).alias("x"), F.lit(0.0).alias("label")),
    )).alias("r")).select(array_to_vector("r.x").alias("x"), "r.label")
    fitted = LogisticRegression(featuresCol="x", fitIntercept=False, maxIter=max_iter, regParam=PAIR_PENALTY, standardization=False, tol=1e-9).fit(rows)
    return [float(w) for w in fitted.coefficients.toArray()]


def pairwise_ranker(
    files: DataFrame, evaluated: DataFrame, group: list[str], seq: list[str], features: list[str], most: int | None = None
) -> DataFrame:
    """Linear score fitted on the differences of all strong and weak files of a change.

    ``most`` bounds the pairs, see ``strong_weak_pairs``; without it all are fitted.
    """
    weights = fit_pairwise(reused(pair_gaps(files, group, seq, features, most)))
    score = sum((F.lit(w) * F.col(f) for w, f in zip(weights, features)), F.lit(0.0))
    return evaluated.withColumn("score", score)


def feature_importance(model: PipelineModel, features: list[str], variant: str = "") -> DataFrame:
    """Ranked weights of a fitted model; one row per feature."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    spark = SparkSession.getActiveSession()
    rows = [(variant, f, i, float(v)) for i, (f, v) in enumerate(zip(features, values.toArray()))]
    table = spark.createDataFrame(rows, "variant string, feature string, index int, weight double")
    return R.rank_importance(table, "feature", "weight")


# fixed values: scoring strategies (name, needs training, needs a stored model, modes, status)
STRATEGIES = (
    ("B0_RANDOM", False, False, "E0", "RESEARCH_ONLY"),
    ("B1_CHANGE_SIZE", False, False, "E0", "PRODUCTION_SAFE"),
    ("B2_BIASED_PVU", True, True, "E0,E1,E2,E4", "RESEARCH_ONLY"),
    ("B3_EVIDENCE_RANKING", True, True, "E0,E1,E2,E4", "RESEARCH_ONLY"),
    ("B4_COMMIT_LEVEL", True, True, "E0,E1,E2,E4", "RESEARCH_ONLY"),
)


def strategy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(STRATEGIES), "name string, requires_training boolean, requires_model boolean, modes string, status string"
    )


def allowed_strategy(name: str) -> str:
    """The name if it may be used online, else an error."""
    known = {s[0]: s[4] for s in STRATEGIES}
    if name not in known:
        raise ValueError(f"unknown strategy {name}")
    if known[name] != "PRODUCTION_SAFE":
        raise ValueError(f"strategy {name} is for research only")
    return name


def split_counts(rows: DataFrame, label: str, split: str, repo: str | None = None) -> DataFrame:
    """Rows, positives, prevalence and the accuracy of the larger class per split; with ``repo`` its repositories, too."""
    positive = F.col(label) == 1
    n, p = F.count(F.lit(1)), F.count_if(positive)
    # one row per split and repository first, so that distinct repositories need no second shuffle of the rows
    per = rows.groupBy(split, *([repo] if repo else [])).agg(n.alias("__n"), p.alias("__p")).groupBy(split).agg(
        F.sum("__n").alias("rows"), F.sum("__p").alias("positives"), F.count(F.lit(1)).alias("repositories"),
        F.count_if(F.col("__p") > 0).alias("positive_repositories"))
    n, p = F.col("rows"), F.col("positives")
    out = per.withColumn("prevalence", M.share(p, n)).withColumn("majority_accuracy", M.share(F.greatest(p, n - p), n))
    return out if repo else out.drop("repositories", "positive_repositories")


def train_report(
    rows: DataFrame, features: list[str], label: str, split: str, seq: list[str], max_iter: int = 1000, repo: str | None = None,
) -> DataFrame:
    """Fit once on train; per split the areas, threshold metrics, baseline, counts and top cuts, in long form.

    The fit and the counts read the rows several times, the metrics the scores: both are written once.
    """
    used = dict.fromkeys([split, label, *features, *seq, *([repo] if repo else [])])
    rows = written(rows.select(*used), "rows")
    train = rows.where(F.col(split) == "train")
    model = fit_balanced_logistic(train, features, label, max_iter)
    scored = written(probability(model, rows).select(split, (F.col(label) == 1).alias("positive"), "score", *seq), "scored")
    def long(wide):
        return unpivoted(wide, [split], [c for c in wide.columns if c != split], "metric")
    areas = M.ranking_areas(scored, "score", "positive", [split])
    cuts = M.threshold_metrics(scored, "score", "positive", by=[split])
    tops = R.top_cut_capture(scored, "score", "positive", seq, by=[split]).select(
        split, F.concat(F.lit("captured_"), F.col("cut")).alias("metric"), F.col("captured").cast("double").alias("value")
    )
    weights = feature_importance(model, features).select(
        F.lit("train").alias(split), F.concat(F.lit("importance_"), F.col("feature")).alias("metric"), F.col("importance").alias("value")
    )
    counts = split_counts(rows, label, split, repo)
    return long(areas.join(cuts, split)).unionByName(long(counts)).unionByName(tops).unionByName(weights)
