"""Statistics queries on order lines, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.operators import attribution as A
from patchsieve.operators import metrics as M
from patchsieve.operators import stats as S
from patchsieve.operators.frames import beside
from patchsieve.plans.attribution import LINKS_SQL, linked_files, links
from patchsieve.plans.bindings import FILES_SQL, REPO_FILES_SQL, SEQ, files, repo_files
from patchsieve.plans.metrics import KS, counts_sql, metric_sql
from patchsieve.plans.ranking import hash_sql
from patchsieve.plans.registry import query, rounded

REPLICATES = 1000

# ---- bootstrap: the lines of a customer are one group ---------------------------

CUSTOMER_SQL = f"""{FILES_SQL}, cfiles AS (SELECT files.*, o_custkey AS cust FROM files JOIN orders ON cid = o_orderkey),
{counts_sql('cfiles', 'price', 'cust', 'cid, line, part, supp', 'ca')}, {counts_sql('cfiles', 'total', 'cust', 'cid, line, part, supp', 'cb')}"""


def customer_files(t):
    orders = t.orders.select(F.col("o_orderkey").alias("cid"), F.col("o_custkey").alias("cust"))
    return files(t).join(orders, "cid")


def customer_counts(t, score):
    ranked = M.rank_in_group(customer_files(t).select("cust", "cid", *SEQ, score, "positive"), ["cust"], score, [F.col(c) for c in ["cid", *SEQ]])
    return M.group_counts(ranked, ["cust"], "positive")


def metric_list(names):
    out = []
    for name in names:
        if name == "mrr":
            out.append(("mrr", "reciprocal_rank"))
        elif name == "first_rank":
            out.append((name, "first_rank::DOUBLE"))
        else:
            kind, k = name.rsplit("_", 1)
            e = metric_sql(int(k))[{"recall": 0, "enrichment": 1, "captured": 2}[kind]]
            out.append((name, f"CASE WHEN n_positive > 0 THEN ({e})::DOUBLE END"))
    return out


_ALL = ["mrr", "first_rank", *[f"{m}_{k}" for k in KS for m in ("recall", "enrichment", "captured")]]
_PAIR = ["mrr", *[f"enrichment_{k}" for k in KS], *[f"recall_{k}" for k in KS]]


def _boot_sql(names, tables, distinct, per):
    cols = []
    for mark, table in tables:
        cols.append(f"m{mark} AS (SELECT cust, row_number() OVER (ORDER BY cust) - 1 AS idx, "
                    + ", ".join(f"{e} AS {mark}_{n}" for n, e in metric_list(names)) + f" FROM {table})")
    draw = f"SELECT {'DISTINCT' if distinct else ''} r AS replicate, ({hash_sql('42::BIGINT', 'r', 'd')}) % n AS idx FROM g, (SELECT unnest(range({REPLICATES})) AS r)"
    joins = " ".join(f"JOIN m{mark} USING (idx)" for mark, _ in tables)
    return (f"WITH {CUSTOMER_SQL}, {', '.join(cols)}, g AS (SELECT idx AS d, (SELECT count(*) FROM ma) AS n FROM ma), draws AS ({draw}), "
            f"rep AS (SELECT replicate, {', '.join(f'{per(n)} AS {n}' for n in names)} FROM draws {joins} GROUP BY replicate), "
            "l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value FROM rep" for n in names) + ") "
            "SELECT metric, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.025), 5) AS ci_lower, round(quantile_cont(value, 0.975), 5) AS ci_upper FROM l GROUP BY metric")


@query("bootstrap_ci", _boot_sql(_ALL, [("a", "ca")], False, lambda n: f"coalesce(avg(a_{n}), 0)"))
def bootstrap_ci(t):
    return rounded(S.bootstrap_ci(customer_counts(t, "price"), ["cust"], REPLICATES), 5)


@query("paired_bootstrap", _boot_sql(_PAIR, [("a", "ca"), ("b", "cb")], True, lambda n: f"coalesce(avg(a_{n}), 0) - coalesce(avg(b_{n}), 0)"))
def paired_bootstrap(t):
    out = S.paired_bootstrap(
        customer_counts(t, "price"), customer_counts(t, "total"), ["cust"], REPLICATES, with_recall=True
    )
    return rounded(out, 5)


# ---- two samples -------------------------------------------------------------------

_EV_SQL = "ev AS (SELECT value, event_type = 'error' AS positive FROM events)"


def _event_scores(t):
    return t.events.select("value", (F.col("event_type") == "error").alias("positive"))


@query("ks_two_sample", f"""WITH {_EV_SQL}, s AS (SELECT value, count(*) AS n, count(*) FILTER (positive) AS p FROM ev GROUP BY value),
c AS (SELECT sum(p) OVER w AS pc, sum(n - p) OVER w AS nc, sum(p) OVER () AS pa, sum(n - p) OVER () AS na FROM s WINDOW w AS (ORDER BY value DESC)),
k AS (SELECT max(pa)::BIGINT AS n1, max(na)::BIGINT AS n2, max(abs(pc / pa - nc / na)) AS ks FROM c)
SELECT n1, n2, round(ks, 6) AS ks, round(CASE WHEN sqrt(n1 * n2 / (n1 + n2)) * ks > 0.2 THEN greatest(0, least(1, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * n1 * n2 / (n1 + n2) * ks * ks)) FROM range(1, 101) x(j)))) ELSE 1 END, 6) AS p_value FROM k""")
def ks_two_sample(t):
    return rounded(S.ks_two_sample(_event_scores(t), "value", "positive"))


_TAIL_SQL = "t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)"


def _mw_sql(source, by=""):
    lead = by + "," if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""mw0 AS (SELECT {lead} value, count(*)::DOUBLE AS n, count(*) FILTER (positive) AS p FROM {source} GROUP BY {lead} value),
mw1 AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM mw0),
mw2 AS (SELECT {lead} sum(p)::DOUBLE AS n1, sum(n) - sum(p) AS n2, sum(p * (b + (n + 1) / 2)) - sum(p) * (sum(p) + 1)::DOUBLE / 2 AS u, sum(n * n * n - n) AS ties FROM mw1 {group}),
mw3 AS (SELECT *, greatest(0, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))))) / sqrt(2) AS x, 1 / (1 + 0.3275911 * x) AS t FROM mw2),
mw AS (SELECT {lead} n1, n2, u, 1 - 2 * u / (n1 * n2) AS effect_size, least(1, {_TAIL_SQL}) AS p_value FROM mw3)"""


@query("mann_whitney", f"WITH {_EV_SQL}, {_mw_sql('ev')} SELECT n1, n2, round(u, 3) AS u, round(effect_size, 6) AS effect_size, round(p_value, 6) AS p_value FROM mw")
def mann_whitney(t):
    out = S.mann_whitney(_event_scores(t), "value", "positive")
    return rounded(out.withColumn("u", F.round("u", 3)))


# ---- one sample ----------------------------------------------------------------------

_DIST = """count(value) AS count, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max,
 round(quantile_cont(value, .5), 5) AS median, round(quantile_cont(value, .1), 5) AS p10, round(quantile_cont(value, .25), 5) AS p25, round(quantile_cont(value, .75), 5) AS p75,
 round(quantile_cont(value, .9), 5) AS p90, round(quantile_cont(value, .75) - quantile_cont(value, .25), 5) AS iqr"""


@query("distribution", f"SELECT event_type, {_DIST} FROM events GROUP BY event_type")
def distribution(t):
    return rounded(S.distribution(t.events, "value", ["event_type"]), 5)


@query("distribution_overall", f"SELECT {_DIST} FROM (SELECT n_chars::DOUBLE AS value FROM documents)")
def distribution_overall(t):
    return rounded(S.distribution(t.documents.select(F.col("n_chars").cast("double").alias("value")), "value"), 5)


@query("seed_stability", f"""WITH {REPO_FILES_SQL}, r AS (SELECT repo % 2 AS mode, repo // 2 AS seed, avg(price) AS mean_price, count(*) FILTER (positive)::DOUBLE AS positives FROM repo_files GROUP BY 1, 2),
l AS (SELECT mode, 'mean_price' AS metric, mean_price AS value FROM r UNION ALL SELECT mode, 'positives', positives FROM r)
SELECT mode, metric, count(*) AS n_seeds, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(stddev_pop(value) / avg(value), 4) AS cv FROM l GROUP BY ALL HAVING count(*) >= 2""")
def seed_stability(t):
    runs = repo_files(t).groupBy((F.col("repo") % 2).alias("mode"), F.floor(F.col("repo") / 2).alias("seed")).agg(
        F.avg("price").alias("mean_price"), F.count_if("positive").cast("double").alias("positives")
    )
    return rounded(S.seed_stability(runs, ["mode"], "seed", ["mean_price", "positives"]), 4)


@query("score_gap", f"""WITH {FILES_SQL} SELECT round(avg(price) FILTER (positive), 4) AS positive_mean, round(stddev_pop(price) FILTER (positive), 4) AS positive_std,
 round(avg(price) FILTER (NOT positive), 4) AS unlabeled_mean, round(stddev_pop(price) FILTER (NOT positive), 4) AS unlabeled_std, round(avg(price) FILTER (positive) - avg(price) FILTER (NOT positive), 4) AS score_gap FROM files""")
def score_gap(t):
    return rounded(S.score_gap(files(t), "price", "positive"), 4)


_FEATURES = ["added", "deleted", "hunks", "total", "price"]
LONG_SQL = FILES_SQL + ", long AS (" + " UNION ALL ".join(f"SELECT positive, '{c}' AS feature, {c}::DOUBLE AS value FROM files" for c in _FEATURES) + ")"


def long_features(t):
    return S.unpivoted(files(t), ["positive"], _FEATURES)


@query("class_mean_ratio", f"""WITH {LONG_SQL} SELECT feature, round(avg(value) FILTER (positive), 5) AS positive_mean, round(avg(value) FILTER (NOT positive), 5) AS negative_mean,
 round(avg(value) FILTER (positive) / avg(value) FILTER (NOT positive), 5) AS ratio FROM long GROUP BY feature""")
def class_mean_ratio(t):
    return rounded(S.class_mean_ratio(long_features(t), "positive"), 5)


@query("ablation_delta", f"""WITH {FILES_SQL}, a AS (SELECT 'roc' AS metric, avg(added) AS a, avg(total) AS b FROM files UNION ALL SELECT 'zero', 0, avg(hunks) FROM files)
SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, CASE WHEN a <> 0 THEN round((b - a) / a * 100, 2) END AS pct_change FROM a""")
def ablation_delta(t):
    base = files(t)
    run = lambda c, z: base.agg(F.avg(c).alias("roc"), F.avg(z).alias("zero"))
    a, b = run(F.col("added"), F.lit(0.0)), run(F.col("total"), F.col("hunks"))
    return S.ablation_delta(*[S.unpivoted(x, [], ["roc", "zero"], "metric") for x in (a, b)])


# ---- observed positives --------------------------------------------------------------

_OB = S.POSITIVE_BUDGETS


@query("observed_positive_ranking", f"""WITH {FILES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY price DESC, cid, line, part, supp) AS rank FROM files),
f AS (SELECT cid, part, min(rank) AS rank FROM r WHERE positive GROUP BY ALL), c AS (SELECT count(*) AS n FROM files)
SELECT max(n) AS n_total, count(*) AS n_positive, round(avg(rank), 4) AS mean_rank, round(quantile_cont(rank, .5), 4) AS median_rank, count(*) FILTER (rank <= 10) AS top_10,
{', '.join(f"round(count(*) FILTER (rank <= {k}) / count(*), 4) AS recall_{k}, round((count(*) FILTER (rank <= {k}) / {k}) / (count(*) / max(n)), 4) AS enrichment_{k}" for k in _OB)} FROM f, c""")
def observed_positive_ranking(t):
    return rounded(S.observed_positive_ranking(files(t), "price", "positive", ["cid", "part"], ["cid", *SEQ]), 4)


@query("expected_random", f"""WITH {FILES_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (positive) AS p FROM files), k AS (SELECT unnest({list(_OB)}) AS k)
SELECT n, p, k, round(least(k, n) / n, 6) AS expected_recall, round(least(k, n) * p / n, 6) AS expected_positives, 1.0 AS expected_enrichment, (n + 1) / 2 AS expected_mean_rank FROM c, k""")
def expected_random(t):
    return rounded(S.expected_random(files(t), "positive"))


_LEVEL = "CASE WHEN supp % 5 = 0 THEN 'FILE_STRONG' WHEN supp % 5 < 3 THEN 'FILE_WEAK' WHEN supp % 5 = 3 THEN 'UNKNOWN' ELSE 'FILE_MODERATE' END"


def leveled(t):
    m = F.col("supp") % 5
    return repo_files(t).withColumn(
        "level", F.when(m == 0, A.STRONG).when(m < 3, A.WEAK).when(m == 3, A.UNKNOWN).otherwise(A.MODERATE)
    ).withColumn("identity", F.col("hunks") > 0)


LEVEL_SQL = REPO_FILES_SQL + f", lev AS (SELECT *, {_LEVEL} AS level, hunks > 0 AS identity FROM repo_files)"


@query("pairwise_accuracy", f"""WITH {LEVEL_SQL} SELECT count(*) AS pairs, round(avg((s.total > w.total)::INT), 6) AS accuracy FROM lev s JOIN lev w ON s.cid = w.cid AND s.level = 'FILE_STRONG' AND w.level = 'FILE_WEAK'""")
def pairwise_accuracy(t):
    return rounded(S.pairwise_accuracy(leveled(t), ["cid"], "total", "level", A.STRONG, A.WEAK, SEQ))


# ---- concentration over parts and nations -----------------------------------------------

_PART_SQL = "pc AS (SELECT p_partkey AS name, count(l_orderkey) FILTER (l_returnflag = 'R' AND l_discount > 0.08) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1)"


def part_counts(t):
    hits = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)).groupBy(
        F.col("l_partkey").alias("name")
    ).agg(F.count(F.lit(1)).alias("n"))
    return t.part.select(F.col("p_partkey").alias("name")).join(hits, "name", "left").fillna(0, ["n"])


CONC_SQL = f"""{_PART_SQL}, s AS (SELECT n / sum(n) OVER () AS s, n, row_number() OVER (ORDER BY n, name) AS i, count(*) OVER () AS m FROM pc),
conc AS (SELECT count(*) AS total, count(*) FILTER (n > 0) AS with_signal, sum(s) FILTER (m - i < 5) AS top_5_share, sum(s) FILTER (m - i < 10) AS top_10_share,
 2 * sum(i * s) / (max(m) * sum(s)) - (max(m) + 1) / max(m) AS gini, sum(s * s) AS herfindahl, -sum(CASE WHEN s > 0 THEN s * ln(s) ELSE 0 END) / ln(count(*) FILTER (n > 0)) AS entropy FROM s)"""


@query("concentration", f"""WITH {CONC_SQL} SELECT total, with_signal, round(top_5_share, 6) AS top_5_share, round(top_10_share, 6) AS top_10_share, round(gini, 6) AS gini,
 round(herfindahl, 6) AS herfindahl, round(entropy, 6) AS entropy FROM conc""")
def concentration(t):
    return rounded(S.concentration(part_counts(t), "name", "n"))


@query("gini_variants", f"""WITH {_PART_SQL}, c AS (SELECT n, n / sum(n) OVER () AS f, row_number() OVER (ORDER BY n, name) AS i, count(*) OVER () AS m FROM pc WHERE n > 0)
SELECT round(sum((2 * i - m - 1) * n) / (max(m) * sum(n)), 6) AS gini_index, (SELECT round(sum(abs(a.f - b.f)) / (2 * max(a.m)), 6) FROM c a, c b) AS gini_pairwise FROM c""")
def gini_variants(t):
    return rounded(S.gini_variants(part_counts(t), "name", "n"))


def levels_by_repo(t):
    over = A.commit_evidence_level(A.path_overlap(links(t), linked_files(t)))
    return over.withColumn("repo", F.col("sha") % 25).withColumn(
        "split", F.when(F.col("sha") % 10 < 7, "train").when(F.col("sha") % 10 < 8, "validation").otherwise("test")
    )


REPO_TABLE_SQL = f"""{LINKS_SQL}, lv AS (SELECT *, sha % 25 AS repo, CASE WHEN sha % 10 < 7 THEN 'train' WHEN sha % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
 CASE WHEN corrective IS NOT NULL THEN 'COMMIT_STRONG' WHEN prefix IS NOT NULL THEN 'COMMIT_WEAK' ELSE 'COMMIT_NONE' END AS cl, CASE WHEN overlap_files > 0 THEN 'FILE_WEAK' ELSE 'UNKNOWN' END AS fl FROM overlap)"""


@query("repo_concentration_table", f"""WITH {REPO_TABLE_SQL} SELECT repo, count(*) AS commits, sum(candidate_files)::BIGINT AS files, sum(overlap_files)::BIGINT AS attributed_files, sum(unknown_files)::BIGINT AS unknown_files,
 count(*) FILTER (cl = 'COMMIT_STRONG') AS commit_strong, count(*) FILTER (fl = 'FILE_WEAK') AS file_weak, string_agg(DISTINCT split, ',' ORDER BY split) AS splits,
 round(count(*) / sum(count(*)) OVER (), 4) AS commit_fraction FROM lv GROUP BY repo""")
def repo_concentration_table(t):
    return S.repo_table(levels_by_repo(t))


@query("top_share", f"""WITH {REPO_TABLE_SQL}, c AS (SELECT repo, count(*) AS n FROM lv GROUP BY 1) SELECT round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC LIMIT 5)) / (SELECT sum(n) FROM c), 6) AS top_5_share""")
def top_share(t):
    return rounded(S.top_share(levels_by_repo(t).groupBy("repo").agg(F.count(F.lit(1)).alias("n")), "n"))


# ---- comparing populations ---------------------------------------------------------------

COVER_SQL = f"""{LONG_SQL}, {_mw_sql('long', 'feature')}, d AS (SELECT feature, positive, count(*) AS count, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, .5) AS median,
 quantile_cont(value, .75) - quantile_cont(value, .25) AS iqr FROM long GROUP BY ALL),
cover AS (SELECT feature, {', '.join(f"{m}.{c} AS {n}_{c}" for m, n in (('o', 'observed'), ('u', 'unlabeled')) for c in ('count', 'mean', 'median', 'std', 'iqr'))}, mw.u, effect_size, p_value,
 o.median / nullif(u.median, 0) AS median_ratio, o.iqr / nullif(u.iqr, 0) AS iqr_ratio, o.median <> u.median AS notable FROM d o JOIN d u USING (feature) JOIN mw USING (feature) WHERE o.positive AND NOT u.positive)"""
_COVER = [f"{n}_{c}" for n in ("observed", "unlabeled") for c in ("mean", "median", "std", "iqr")] + ["effect_size", "p_value", "median_ratio", "iqr_ratio"]


@query("coverage_numeric", f"WITH {COVER_SQL} SELECT feature, observed_count, unlabeled_count, round(u, 1) AS u, notable, {', '.join(f'round({c}, 4) AS {c}' for c in _COVER)} FROM cover")
def coverage_numeric(t):
    out = S.coverage_numeric(long_features(t), "positive")
    return rounded(out.withColumn("u", F.round("u", 1)), 4)


CATEGORY_SQL = """doc AS (SELECT d.source, d.lang, coalesce(quality = 0, false) AS positive FROM documents d LEFT JOIN labels l USING (doc_id)),
cc AS (SELECT source, count(*) FILTER (positive) AS observed, count(*) FILTER (NOT positive) AS unlabeled FROM doc GROUP BY source),
cat AS (SELECT source, observed, unlabeled, observed / sum(observed) OVER () AS os, unlabeled / sum(unlabeled) OVER () AS us FROM cc)"""


def doc_flags(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.select("source", "lang", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("positive"))


@query("coverage_categories", f"""WITH {CATEGORY_SQL} SELECT source, observed, unlabeled, round(os, 6) AS observed_share, round(us, 6) AS unlabeled_share,
 observed > 0 AND unlabeled > 0 AND (os / nullif(us, 0) > 3 OR os / nullif(us, 0) < 0.33) AS notable FROM cat""")
def coverage_categories(t):
    return rounded(S.coverage_categories(doc_flags(t), "source", "positive"))


@query("selection_dependence", f"""WITH {CONC_SQL}, {COVER_SQL}, {CATEGORY_SQL}, k AS (SELECT (SELECT count(*) FROM cover WHERE notable) +
 (SELECT count(*) FROM cat WHERE observed > 0 AND unlabeled > 0 AND (os / us > 3 OR os / us < 0.33)) AS n)
SELECT round(top_5_share, 6) AS top_5_share, n AS notable_count, round(with_signal / total, 6) AS signal_ratio, CASE WHEN top_5_share > .7 THEN 'high' WHEN top_5_share > .5 THEN 'medium' ELSE 'low' END AS repo_severity,
 CASE WHEN n > 5 THEN 'high' WHEN n > 2 THEN 'medium' ELSE 'low' END AS feature_severity, (with_signal / total > .3)::INT + (top_5_share < .4)::INT AS evidence_for,
 (with_signal / total <= .3)::INT + (top_5_share > .6)::INT + (n > 3)::INT AS evidence_against FROM conc, k""")
def selection_dependence(t):
    return rounded(_selection(t))


def _selection(t):
    numeric = S.coverage_numeric(long_features(t), "positive").agg(F.count_if("notable").alias("a"))
    named = S.coverage_categories(doc_flags(t), "source", "positive").agg(F.count_if("notable").alias("b"))
    notable = beside(numeric, named).select((F.col("a") + F.col("b")).alias("notable_count"))
    return S.selection_dependence(S.concentration(part_counts(t), "name", "n"), notable)


_REC_SQL = f"""{LINKS_SQL}, one AS (SELECT count(*) FILTER (category = 'FILE_PARTIAL') AS partial_commits, sum(unknown_files)::BIGINT AS unknown_files, sum(candidate_files)::BIGINT AS candidate_files,
 0 AS negatives, count(*) FILTER (overlap_files > 0) AS file_weak FROM overlap)"""


def _one_row(t):
    return A.path_overlap(links(t), linked_files(t)).agg(
        F.count_if(F.col("category") == A.PARTIAL).alias("partial_commits"), F.sum("unknown_files").alias("unknown_files"),
        F.sum("candidate_files").alias("candidate_files"), F.lit(0).alias("negatives"), F.count_if(F.col("overlap_files") > 0).alias("file_weak"),
    )


@query("path_recommendation", f"""WITH {_REC_SQL} SELECT *, round(unknown_files / candidate_files, 6) AS unknown_rate, CASE WHEN partial_commits = 0 THEN 'FILE_LEVEL_ATTRIBUTION_NOT_FEASIBLE'
 WHEN unknown_files / candidate_files > .8 OR negatives = 0 THEN 'PATH_LEVEL_EVIDENCE_ONLY' ELSE 'FILE_LEVEL_ATTRIBUTION_FEASIBLE_WITH_RESTRICTIONS' END AS recommendation FROM one""")
def path_recommendation(t):
    return rounded(S.path_recommendation(_one_row(t)))


@query("proceed_recommendation", f"""WITH {_REC_SQL} SELECT *, true AS requires_repo_access, CASE WHEN file_weak > partial_commits * 1.2 OR file_weak > 0 THEN 'PROCEED' ELSE 'DO_NOT_PROCEED' END AS decision FROM one""")
def proceed_recommendation(t):
    return S.proceed_recommendation(_one_row(t).withColumn("requires_repo_access", F.lit(True)))


@query("pu_recommendation", f"""WITH {CONC_SQL}, {FILES_SQL}, o AS (SELECT count(*) FILTER (positive) AS observed, count(DISTINCT l) FILTER (positive) AS s FROM (SELECT positive, line % 3 AS l FROM files)),
i AS (SELECT 0 AS negatives, observed, with_signal / total AS signal_ratio, 3 - s AS empty_splits, 4 AS notable_count, true AS selection_untestable, CASE WHEN top_5_share > .7 THEN 'high' WHEN top_5_share > .5 THEN 'medium' ELSE 'low' END AS repo_severity, 2 AS diagnostics FROM conc, o),
k AS (SELECT *, (signal_ratio < .2)::INT + empty_splits + (notable_count > 5)::INT + 1 + (repo_severity = 'high')::INT + (diagnostics < 3)::INT AS concerns FROM i)
SELECT negatives, observed, round(signal_ratio, 6) AS signal_ratio, empty_splits, notable_count, repo_severity, concerns, CASE WHEN observed = 0 OR concerns >= 4 THEN 'IMPROVE_ATTRIBUTION_FIRST' WHEN concerns >= 2 THEN 'PU_LEARNING_FEASIBLE_WITH_RESTRICTIONS' ELSE 'PU_LEARNING_FEASIBLE' END AS recommendation FROM k""")
def pu_recommendation(t):
    seen = files(t).agg(
        F.count_if("positive").alias("observed"), F.count_distinct(F.when(F.col("positive"), F.col("line") % 3)).alias("s")
    )
    conc = S.concentration(part_counts(t), "name", "n")
    top = F.col("top_5_share")
    row = beside(conc, seen).select(
        F.lit(0).alias("negatives"), "observed", (F.col("with_signal") / F.col("total")).alias("signal_ratio"), (3 - F.col("s")).alias("empty_splits"),
        F.lit(4).alias("notable_count"), F.lit(True).alias("selection_untestable"),
        F.when(top > 0.7, "high").when(top > 0.5, "medium").otherwise("low").alias("repo_severity"), F.lit(2).alias("diagnostics"),
    )
    return rounded(S.pu_recommendation(row).drop("selection_untestable", "diagnostics"))


# every input from the tables: defensible negatives, notable differences, what of selection can be tested, diagnostics at hand
@query("pu_recommendation_computed", f"""WITH {CONC_SQL}, {COVER_SQL}, {CATEGORY_SQL}, {LINKS_SQL.replace("files AS (", "lfiles AS (").replace("FROM files", "FROM lfiles")},
neg AS (SELECT count(*) FILTER (status <> 'CANDIDATE_NEGATIVE') AS negatives FROM (SELECT 'CANDIDATE_NEGATIVE' AS status FROM ctrl c WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.sha = c.sha AND p.path = c.path))),
k0 AS (SELECT (SELECT count(*) FROM cover WHERE notable) + (SELECT count(*) FROM cat WHERE observed > 0 AND unlabeled > 0 AND (os / us > 3 OR os / us < 0.33)) AS notable_count),
o AS (SELECT count(*) FILTER (positive) AS observed, count(*) FILTER (NOT positive) AS others, count(DISTINCT l) FILTER (positive) AS s FROM (SELECT positive, line % 3 AS l FROM files)),
i AS (SELECT negatives, observed, with_signal / total AS signal_ratio, 3 - s AS empty_splits, notable_count, negatives = 0 AS selection_untestable,
  CASE WHEN top_5_share > .7 THEN 'high' WHEN top_5_share > .5 THEN 'medium' ELSE 'low' END AS repo_severity, (observed > 0 AND others > 0)::INT * 2 + (observed > 0)::INT AS diagnostics FROM conc, o, neg, k0),
k AS (SELECT *, (signal_ratio < .2)::INT + empty_splits + (notable_count > 5)::INT + selection_untestable::INT + (repo_severity = 'high')::INT + (diagnostics < 3)::INT AS concerns FROM i)
SELECT negatives, observed, round(signal_ratio, 6) AS signal_ratio, empty_splits, notable_count, selection_untestable, repo_severity, diagnostics, concerns,
 CASE WHEN negatives > 0 THEN 'BINARY_SUPERVISION_NOT_SUPPORTED' WHEN observed = 0 OR concerns >= 4 THEN 'IMPROVE_ATTRIBUTION_FIRST' WHEN concerns >= 2 THEN 'PU_LEARNING_FEASIBLE_WITH_RESTRICTIONS' ELSE 'PU_LEARNING_FEASIBLE' END AS recommendation FROM k""")
def pu_recommendation_computed(t):
    seen = files(t).agg(
        F.count_if("positive").alias("observed"), F.count_if(~F.col("positive")).alias("others"),
        F.count_distinct(F.when(F.col("positive"), F.col("line") % 3)).alias("s"))
    negative = A.candidate_negatives(links(t), linked_files(t)).agg(F.count_if(F.col("status") != "CANDIDATE_NEGATIVE").alias("negatives"))
    return rounded(S.pu_recommendation(S.recommendation_inputs(_selection(t), seen, negative)))


# ---- label composition ----------------------------------------------------------------------

LABELED_SQL = REPO_FILES_SQL + """, lab AS (SELECT repo, cid AS sha, part AS path, ts, line, supp, CASE WHEN excluded THEN -1 WHEN positive THEN 1 ELSE 0 END AS defect_label,
 CASE WHEN cid % 7 < 4 THEN 'train' WHEN cid % 7 < 6 THEN 'validation' ELSE 'test' END AS split,
 CASE line % 3 WHEN 0 THEN 'explicit_sha_reference' WHEN 1 THEN 'revert' ELSE 'line_overlap' END AS label_source FROM repo_files),
cl AS (SELECT repo, split, sha, count(*) AS files, count(*) FILTER (defect_label = 1) AS positive, count(*) FILTER (defect_label = 0) AS negative, count(*) FILTER (defect_label = -1) AS ambiguous FROM lab GROUP BY ALL),
cls AS (SELECT *, CASE WHEN positive > 0 AND negative = 0 THEN 'all_positive' WHEN positive > 0 THEN 'mixed' WHEN negative > 0 THEN 'all_negative' ELSE 'all_ambiguous' END AS composition, positive / files AS ratio FROM cl)"""


def labeled_rows(t, also=None):
    line, cid = F.col("line"), F.col("cid")
    return repo_files(t, also).select(
        "repo", cid.alias("sha"), F.col("part").alias("path"), "ts", "line", "supp",
        F.when(F.col("excluded"), -1).when(F.col("positive"), 1).otherwise(0).alias("defect_label"),
        F.when(cid % 7 < 4, "train").when(cid % 7 < 6, "validation").otherwise("test").alias("split"),
        F.when(line % 3 == 0, "explicit_sha_reference").when(line % 3 == 1, "revert").otherwise("line_overlap").alias("label_source"), *(also or {}),
    )


KEY = ["repo", "split", "sha"]


@query("classify_changes", f"WITH {LABELED_SQL} SELECT repo, split, sha, files, positive, negative, ambiguous, composition, round(ratio, 6) AS ratio FROM cls")
def classify_changes(t):
    return rounded(S.classify_changes(labeled_rows(t), KEY))


def _composition_sql(group):
    lead = ", ".join(group) + "," if group else ""
    by = f"GROUP BY CUBE ({', '.join(group)})" if group else ""
    c = lambda x: f"count(*) FILTER (composition = '{x}')"
    pos = f"({c('all_positive')} + {c('mixed')})"
    return f"""SELECT {lead} count(*) AS commits, sum(files)::BIGINT AS rows, sum(positive)::BIGINT AS positive_rows, {c('all_positive')} AS all_positive, {c('mixed')} AS mixed, {c('all_negative')} AS all_negative,
 {c('all_ambiguous')} AS all_ambiguous, {pos} AS positive_commits, round(coalesce(100.0 * {c('all_positive')} / nullif({pos}, 0), 0), 6) AS all_positive_pct, round(coalesce(100.0 * {c('mixed')} / nullif({pos}, 0), 0), 6) AS mixed_pct FROM cls {by}"""


@query("label_composition", f"WITH {LABELED_SQL} {_composition_sql(['split', 'repo'])}")
def label_composition(t):
    return rounded(S.label_composition(S.classify_changes(labeled_rows(t), KEY), ["split", "repo"]))


@query("attribution_by_source", f"""WITH {LABELED_SQL}, s AS (SELECT DISTINCT repo, split, sha, label_source FROM lab WHERE defect_label = 1)
SELECT label_source, count(*) AS positive_commits, sum(positive)::BIGINT AS positive_rows, count(*) FILTER (composition = 'all_positive') AS all_positive, count(*) FILTER (composition = 'mixed') AS mixed
FROM s JOIN cls USING (repo, split, sha) GROUP BY 1""")
def attribution_by_source(t):
    return S.attribution_by_source(labeled_rows(t), KEY)


GRAN_SQL = """gran AS (SELECT count(*) FILTER (c) AS commit_level, count(*) FILTER (f) AS file_level, count(*) AS positive_commits, 100.0 * count(*) FILTER (c) / count(*) AS pct_commit_level FROM (
 SELECT sha, bool_or(label_source <> 'line_overlap') AS c, bool_or(label_source = 'line_overlap') AS f FROM lab WHERE defect_label = 1 GROUP BY repo, split, sha))"""


@query("labeling_granularity", f"WITH {LABELED_SQL}, {GRAN_SQL} SELECT commit_level, file_level, positive_commits, round(pct_commit_level, 6) AS pct_commit_level FROM gran")
def labeling_granularity(t):
    return rounded(S.labeling_granularity(labeled_rows(t), KEY))


@query("size_bucket_profile", f"""WITH {LABELED_SQL}, b AS (SELECT unnest(['1', '2-3', '4-5', '6-10', '11-20', '>20']) AS bucket),
p AS (SELECT CASE WHEN files = 1 THEN '1' WHEN files <= 3 THEN '2-3' WHEN files <= 5 THEN '4-5' WHEN files <= 10 THEN '6-10' WHEN files <= 20 THEN '11-20' ELSE '>20' END AS bucket, * FROM cls WHERE positive > 0)
SELECT b.bucket, count(sha) AS commits, count(*) FILTER (composition = 'all_positive') AS all_positive, count(*) FILTER (composition = 'mixed') AS mixed, round(coalesce(avg(ratio), 0), 6) AS mean_ratio
FROM b LEFT JOIN p ON p.bucket = b.bucket GROUP BY 1""")
def size_bucket_profile(t):
    return rounded(S.size_bucket_profile(S.classify_changes(labeled_rows(t), KEY)))


@query("suitability", f"""WITH {LABELED_SQL}, {GRAN_SQL}, m AS (SELECT count(*) FILTER (composition = 'mixed') AS mixed FROM cls)
SELECT mixed, round(pct_commit_level, 6) AS pct_commit_level, CASE WHEN mixed > 0 THEN 'conditionally_suitable' ELSE 'not_suitable' END AS suitability,
 CASE WHEN mixed = 0 AND pct_commit_level = 100 THEN 'commit_level_only' WHEN mixed > 0 AND pct_commit_level > 80 THEN 'mostly_commit_level' WHEN mixed > 0 THEN 'some_file_level' ELSE 'no_mixed_commits' END AS reason FROM gran, m""")
def suitability(t):
    rows = labeled_rows(t)
    return rounded(S.suitability(S.label_composition(S.classify_changes(rows, KEY)), S.labeling_granularity(rows, KEY)))


def _diversity_sql(name, where):
    return f"""{name} AS (SELECT sum(c)::BIGINT AS positive_commits, sum(f)::BIGINT AS positive_files, count(*) AS repos_1, count(*) FILTER (c >= 3) AS repos_3, count(*) FILTER (c >= 5) AS repos_5, max(c) AS largest_repo_commits,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM lab WHERE defect_label = 1 {where} GROUP BY sha)) AS largest_commit_files, 100.0 * max(c) / sum(c) AS largest_repo_pct,
 100.0 * (SELECT max(n) FROM (SELECT count(*) AS n FROM lab WHERE defect_label = 1 {where} GROUP BY sha)) / sum(f) AS largest_commit_pct
 FROM (SELECT repo, count(DISTINCT sha) AS c, count(*) AS f FROM lab WHERE defect_label = 1 {where} GROUP BY repo))"""


_DIV = ["positive_commits", "positive_files", "repos_1", "repos_3", "repos_5", "largest_repo_commits", "largest_commit_files", "largest_repo_pct", "largest_commit_pct"]


@query("dataset_diversity", f"WITH {LABELED_SQL}, {_diversity_sql('dv', '')} SELECT {', '.join(f'round({c}, 6) AS {c}' if 'pct' in c else c for c in _DIV)} FROM dv")
def dataset_diversity(t):
    return rounded(S.dataset_diversity(labeled_rows(t)))


_BREAKDOWN_SQL = " UNION ALL ".join(
    f"""SELECT '{part}' AS part, {name} AS name, count(*) AS positive_commits, sum(n)::BIGINT AS positive_files, max(n) AS largest_commit_files,
 round(100.0 * count(*) / (SELECT count(DISTINCT sha) FROM lab WHERE defect_label = 1), 6) AS commits_pct
 FROM (SELECT {column} AS c, sha, count(*) AS n FROM lab WHERE defect_label = 1 GROUP BY ALL) GROUP BY c"""
    for part, column, name in (("repo", "repo", "c::VARCHAR"), ("label_source", "label_source", "c"), ("split", "split", "c"), ("all", "1", "'all'")))


@query("diversity_breakdown", f"WITH {LABELED_SQL} {_BREAKDOWN_SQL}")
def diversity_breakdown(t):
    return rounded(S.diversity_breakdown(labeled_rows(t)))


_V1 = "AND ts < TIMESTAMP '1998-01-01'"


@query("version_delta", f"""WITH {LABELED_SQL}, {_diversity_sql('dv', '')}, {_diversity_sql('d1', _V1)}
{' UNION ALL '.join(f"SELECT '{c}' AS metric, round(d1.{c}::DOUBLE, 6) AS before, round(dv.{c}::DOUBLE, 6) AS after, round(dv.{c}::DOUBLE - d1.{c}::DOUBLE, 6) AS delta FROM dv, d1" for c in _DIV)}""")
def version_delta(t):
    rows = labeled_rows(t)
    before = S.dataset_diversity(rows.where(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return rounded(S.version_delta(before, S.dataset_diversity(rows)))
