"""Model queries on order lines. Fits have no SQL form: what is determined of them is checked beside."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.operators import metrics as M
from patchsieve.operators import models as L
from patchsieve.operators.frames import beside, reused, written
from patchsieve.operators.ranking import rank_priority
from patchsieve.operators.ranking import top_cut_capture as top_cuts
from patchsieve.plans.bindings import FILES_SQL, RANKED_SQL, REPO_FILES_SQL, SEQ
from patchsieve.plans.ranking import RANDOM_SQL, random_files
from patchsieve.plans.registry import query, rounded
from patchsieve.plans.stats import LEVEL_SQL, leveled

FEATURES = ["added", "deleted", "hunks", "price"]


def rows_of(t):
    cid = F.col("cid")
    return leveled(t).withColumn("label", F.col("positive").cast("double")).withColumn(
        "split", F.when(cid % 10 < 7, "train").when(cid % 10 < 8, "validation").otherwise("test")
    )


def fit_rows(t, *also):
    """What a fit and its evaluation read many times, joined once and written."""
    return written(rows_of(t).select("split", "label", *FEATURES, *also), "rows")


def _train(rows):
    return rows.where(F.col("split") == "train")


def _by_split(scored):
    return rounded(M.ranking_areas(scored.withColumn("positive", F.col("label") == 1), "score", "positive", ["split"]))


@query("balanced_logistic")
def balanced_logistic(t):
    rows = fit_rows(t)
    return _by_split(L.probability(L.fit_balanced_logistic(_train(rows), FEATURES, "label"), rows))


_SPLIT_SQL = "CASE WHEN cid % 10 < 7 THEN 'train' WHEN cid % 10 < 8 THEN 'validation' ELSE 'test' END"


@query("balanced_logistic_fit", f"""WITH {FILES_SQL}, t AS (SELECT count(*) AS rows, count(*) FILTER (positive) AS positives FROM files WHERE {_SPLIT_SQL} = 'train')
SELECT feature, rows, positives, true AS stationary FROM t, (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature)""")
def balanced_logistic_fit(t):
    """At the fitted weights the weighted residuals of each standardised feature add up to nothing."""
    rows = _train(rows_of(t))
    scored = beside(L.probability(L.fit_balanced_logistic(rows, FEATURES, "label"), rows), rows.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"),
        *[F.avg(f).alias(f"mean_{f}") for f in FEATURES], *[F.stddev(f).alias(f"std_{f}") for f in FEATURES]))
    own = F.when(F.col("label") == 1, F.col("positives")).otherwise(F.col("rows") - F.col("positives"))
    residual = F.col("rows") / (2.0 * own) * (F.col("score") - F.col("label"))
    sums = scored.groupBy("rows", "positives").agg(*[
        F.avg(residual * (F.col(f) - F.col(f"mean_{f}")) / F.col(f"std_{f}")).alias(f) for f in FEATURES])
    pairs = F.explode(F.create_map(*[c for f in FEATURES for c in (F.lit(f), F.col(f))])).alias("feature", "slope")
    return sums.select("rows", "positives", pairs).select("feature", "rows", "positives", (F.abs("slope") < 1e-3).alias("stationary"))


@query("pu_ranker_bounds", f"""WITH {FILES_SQL} SELECT {_SPLIT_SQL} AS split, count(*) AS rows, count(*) FILTER (positive) AS positives, 0.0::DOUBLE AS least, 1.0::DOUBLE AS largest
FROM files GROUP BY 1""")
def pu_ranker_bounds(t):
    """Margins are scaled to 0 .. 1 within every split."""
    rows = fit_rows(t)
    scored = L.pu_ranker(_train(rows), rows, FEATURES, "label", ["split"])
    return rounded(scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"), F.min("score").alias("least"), F.max("score").alias("largest")))


@query("pu_ranker")
def pu_ranker(t):
    rows = fit_rows(t)
    return _by_split(L.pu_ranker(_train(rows), rows, FEATURES, "label", ["split"]))


@query("boosted_trees")
def boosted_trees(t):
    rows = fit_rows(t)
    return _by_split(L.probability(L.fit_boosted_trees(_train(rows), FEATURES, "label"), rows))


@query("commit_level_model")
def commit_level_model(t):
    rows = rows_of(t).withColumn("vector", F.array(*[F.col(f).cast("double") for f in FEATURES]))
    scored = L.commit_level_model(_train(rows), rows, ["cid"], "vector", len(FEATURES), "positive")
    return _by_split(scored)


@query("pairwise_ranker")
def pairwise_ranker(t):
    rows = rows_of(t)
    return _by_split(L.pairwise_ranker(_train(rows), rows, ["cid"], SEQ, FEATURES))


_PAIRS_SQL = f"""{LEVEL_SQL}, sides AS (SELECT cid, count(*) FILTER (level = 'FILE_STRONG') AS s, count(*) FILTER (level = 'FILE_WEAK') AS w
  FROM lev WHERE identity AND {_SPLIT_SQL} = 'train' GROUP BY cid)"""


@query("pairwise_ranker_fit", f"""WITH {_PAIRS_SQL}
SELECT feature, (SELECT sum(s * w)::BIGINT FROM sides) AS pairs, true AS stationary FROM (SELECT unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature)""")
def pairwise_ranker_fit(t):
    """All strong-weak pairs are fitted, and at the weights the slopes of the penalised loss are nothing."""
    gaps = reused(L.pair_gaps(_train(rows_of(t)), ["cid"], SEQ, FEATURES))
    weights = L.fit_pairwise(gaps)
    margin = sum((F.lit(w) * F.col("gap")[i] for i, w in enumerate(weights)), F.lit(0.0))
    miss = 1 / (1 + F.exp(margin))
    parts = [c for i, f in enumerate(FEATURES) for c in (
        (F.avg(-miss * F.col("gap")[i]) + L.PAIR_PENALTY * weights[i]).alias(f), F.sqrt(F.avg(F.col("gap")[i] * F.col("gap")[i])).alias(f"size_{f}"))]
    sums = gaps.agg(F.count(F.lit(1)).alias("pairs"), *parts)
    slopes = F.explode(F.create_map(*[c for f in FEATURES for c in (F.lit(f), F.abs(F.col(f)) <= 1e-3 * F.col(f"size_{f}"))])).alias("feature", "stationary")
    return sums.select("pairs", slopes).select("feature", "pairs", "stationary")


def _score_rows(scored):
    """What is determined of scores per split: their rows, positives and range."""
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives"),
        F.min(F.col("score").between(0.0, 1.0)).alias("in_range"), (F.count_distinct("score") > 1).alias("told_apart"))


_SCORE_ROWS_SQL = f"SELECT {_SPLIT_SQL} AS split, count(*) AS rows, count(*) FILTER (positive) AS positives, true AS in_range, true AS told_apart FROM files GROUP BY 1"


@query("boosted_trees_rows", f"WITH {FILES_SQL} {_SCORE_ROWS_SQL}")
def boosted_trees_rows(t):
    rows = fit_rows(t)
    return _score_rows(L.probability(L.fit_boosted_trees(_train(rows), FEATURES, "label"), rows))


@query("commit_level_rows", f"""WITH {FILES_SQL}, s AS ({_SCORE_ROWS_SQL}), c AS (SELECT {_SPLIT_SQL} AS split, count(DISTINCT cid) AS changes FROM files GROUP BY 1)
SELECT s.*, changes, true AS shared FROM s JOIN c USING (split)""")
def commit_level_rows(t):
    """The files of a change share its score."""
    rows = rows_of(t).withColumn("vector", F.array(*[F.col(f).cast("double") for f in FEATURES]))
    scored = reused(L.commit_level_model(_train(rows), rows, ["cid"], "vector", len(FEATURES), "positive").select("split", "cid", "label", "score"))
    per = scored.groupBy("split", "cid").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).groupBy("split").agg(
        F.count(F.lit(1)).alias("changes"), F.min(F.col("lo") == F.col("hi")).alias("shared"))
    return _score_rows(scored).join(per, "split")


@query("class_weights", f"""WITH {FILES_SQL} SELECT {_SPLIT_SQL} AS split, positive, count(*) AS rows,
 round(CASE WHEN positive THEN (sum(count(*)) OVER w - count(*)) / count(*) ELSE 1 END, 6) AS tree_weight, round(sum(count(*)) OVER w / (2.0 * count(*)), 6) AS balanced_weight
FROM files GROUP BY 1, 2 WINDOW w AS (PARTITION BY {_SPLIT_SQL})""")
def class_weights(t):
    """The weights that both kinds of fits give the classes of a split."""
    parts = []
    for split in ("train", "validation", "test"):
        rows = rows_of(t).where(F.col("split") == split)
        trees = L.weighted(rows, "label", balanced=False).withColumnRenamed("__weight", "tree_weight")
        both = L.weighted(trees, "label", balanced=True)
        parts.append(both.groupBy("split", "positive").agg(F.count(F.lit(1)).alias("rows"), F.max("tree_weight").alias("tree_weight"), F.max("__weight").alias("balanced_weight")))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("importance_ranks", f"""SELECT variant, {len(FEATURES)}::BIGINT AS features, 1.0::DOUBLE AS largest, true AS ranked, true AS falling
FROM (SELECT unnest(['logistic', 'trees']) AS variant)""")
def importance_ranks(t):
    """The largest importance is 1, ranks are 1 .. n without gaps, and importance falls with the rank."""
    ranks = feature_importance(t)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "importance")))
    per = ranks.groupBy("variant").agg(F.count(F.lit(1)).alias("features"), F.max("importance").alias("largest"), ordered.alias("o"))
    falls = F.transform("o", lambda x: x["importance"]) == F.reverse(F.array_sort(F.transform("o", lambda x: x["importance"])))
    gapless = F.transform("o", lambda x: x["rank"].cast("long")) == F.sequence(F.lit(1).cast("long"), F.col("features"))
    return per.select("variant", "features", "largest", gapless.alias("ranked"), falls.alias("falling"))


@query("feature_importance")
def feature_importance(t):
    rows = _train(fit_rows(t))
    linear = L.feature_importance(L.fit_balanced_logistic(rows, FEATURES, "label"), FEATURES, "logistic")
    trees = L.feature_importance(L.fit_boosted_trees(rows, FEATURES, "label"), FEATURES, "trees")
    return linear.unionByName(trees)


@query("train_report")
def train_report(t):
    return rounded(L.train_report(rows_of(t), FEATURES, "label", "split", ["cid", *SEQ], repo="repo"))


@query("train_report_counts", f"""WITH {REPO_FILES_SQL}, s AS (SELECT {_SPLIT_SQL} AS split, repo, positive FROM repo_files)
SELECT split, count(*) AS rows, count(*) FILTER (positive) AS positives, count(DISTINCT repo) AS repositories, count(DISTINCT repo) FILTER (positive) AS positive_repositories,
 round(count(*) FILTER (positive) / count(*), 6) AS prevalence, round(greatest(count(*) FILTER (positive), count(*) FILTER (NOT positive)) / count(*), 6) AS majority_accuracy FROM s GROUP BY 1""")
def train_report_counts(t):
    return rounded(L.split_counts(rows_of(t), "label", "split", "repo"))


@query("top_cut_capture_by_split", f"""WITH {FILES_SQL}, r AS (SELECT {_SPLIT_SQL} AS split, positive, row_number() OVER (PARTITION BY {_SPLIT_SQL} ORDER BY price DESC, cid, line, part, supp) AS k FROM files),
n AS (SELECT split, count(*) AS n, count(*) FILTER (positive) AS p FROM r GROUP BY split),
cuts AS (SELECT split, n, p, unnest(['top_10', 'top_20', 'top_50', 'top_100', 'top_10_percent', 'top_20_percent']) AS cut, unnest([10, 20, 50, 100, greatest(1, n // 10), greatest(1, n // 5)]) AS lim FROM n)
SELECT c.split, cut, least(lim, n) AS rows, count(*) FILTER (positive AND k <= lim) AS captured, round(100.0 * count(*) FILTER (positive AND k <= lim) / max(p), 6) AS percent
FROM cuts c JOIN r USING (split) GROUP BY c.split, cut, lim, n""")
def top_cut_capture_by_split(t):
    return rounded(top_cuts(rows_of(t), "price", "positive", ["cid", *SEQ], by=["split"]))


_STRATEGIES_SQL = ", ".join(f"('{n}', {a}, {b}, '{m}', '{s}')" for n, a, b, m, s in L.STRATEGIES)


@query("strategy_table", f"""WITH {RANKED_SQL}, r AS (SELECT *, {RANDOM_SQL} AS chance FROM ranked),
a AS (SELECT cid, positive, row_number() OVER (PARTITION BY cid ORDER BY chance DESC, line, part, supp) AS k0, row_number() OVER (PARTITION BY cid ORDER BY score DESC, line, part, supp) AS k1 FROM r),
g AS (SELECT min(k0) FILTER (positive) AS f0, min(k1) FILTER (positive) AS f1 FROM a GROUP BY cid), m AS (SELECT avg(1.0 / f0) AS b0, avg(1.0 / f1) AS b1 FROM g)
SELECT name, requires_training, requires_model, modes, status, status = 'PRODUCTION_SAFE' AS allowed,
 round(CASE name WHEN 'B0_RANDOM' THEN b0 WHEN 'B1_CHANGE_SIZE' THEN b1 END, 6) AS mrr FROM (VALUES {_STRATEGIES_SQL}) s(name, requires_training, requires_model, modes, status), m""")
def strategy_table(t):
    """The strategies that need no training, evaluated on the lines, beside their status."""
    def mrr(scored, name, score):
        ranked = M.rank_in_group(scored, ["cid"], score, [F.col(c) for c in SEQ])
        return M.group_counts(ranked, ["cid"], "positive").agg(F.avg("reciprocal_rank").alias(name))

    random = mrr(random_files(t), "B0_RANDOM", "random_score")
    size = mrr(rank_priority(random_files(t), ["cid"], "total", SEQ, "excluded"), "B1_CHANGE_SIZE", "score")
    both = beside(random, size).select(F.explode(F.create_map(
        F.lit("B0_RANDOM"), F.col("B0_RANDOM"), F.lit("B1_CHANGE_SIZE"), F.col("B1_CHANGE_SIZE")
    )).alias("name", "mrr"))
    table = L.strategy_table(t.spark).withColumn("allowed", F.col("status") == "PRODUCTION_SAFE")
    return rounded(table.join(both, "name", "left"))
