"""Evaluation queries: the priority score against the returned order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.operators import metrics as M
from patchsieve.operators.frames import reused
from patchsieve.operators.ranking import rank_priority
from patchsieve.plans.bindings import FILES_SQL, RANKED_SQL, REPO_FILES_SQL, SEQ, files, repo_files
from patchsieve.plans.ranking import ranked
from patchsieve.plans.registry import query, rounded

KS = M.BUDGETS


def counts_sql(source: str, score: str, group: str = "cid", ties: str = "line, part, supp", name: str = "counts") -> str:
    hits = ", ".join(f"count(*) FILTER (positive AND rank <= {k}) AS hits_{k}" for k in KS)
    return f"""{name} AS (
  SELECT {group}, count(*) AS n_files, count(*) FILTER (positive) AS n_positive,
    min(rank) FILTER (positive) AS first_rank, 1.0 / min(rank) FILTER (positive) AS reciprocal_rank, {hits}
  FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {score} DESC, {ties}) AS rank FROM {source})
  GROUP BY {group})"""


def metric_sql(k):
    recall = f"CASE WHEN n_positive > 0 THEN hits_{k}::DOUBLE / n_positive ELSE 0.0 END"
    return recall, f"({recall}) / (least({k}, n_files)::DOUBLE / n_files)", f"hits_{k} >= n_positive"


COUNTS_SQL = RANKED_SQL + ", " + counts_sql("ranked", "score")


def long_sql(keep: str, source: str = "counts") -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, {k} AS k, {metric_sql(k)[0]} AS recall, {metric_sql(k)[1]} AS enrichment,"
        f" {metric_sql(k)[2]} AS all_captured FROM {source}" for k in KS)


def counts(t):
    return M.group_counts(
        M.rank_in_group(ranked(t).select("cid", *SEQ, "score", "positive"), ["cid"], "score", [F.col(c) for c in SEQ]), ["cid"], "positive"
    )


@query("within_group_metrics", f"""WITH {COUNTS_SQL}, l AS ({long_sql('cid, n_files, n_positive, first_rank, reciprocal_rank')})
SELECT cid, n_files, n_positive, first_rank, round(reciprocal_rank, 6) AS reciprocal_rank, k,
  round(recall, 6) AS recall, round(enrichment, 6) AS enrichment, all_captured FROM l""")
def within_group_metrics(t):
    return rounded(M.within_group_metrics(ranked(t), ["cid"], "score", "positive", SEQ))


def aggregate_sql(by: str = "", where: str = "") -> str:
    per_k = ", ".join(
        f"round(coalesce(avg({r}) FILTER (n_positive > 0), 0), 6) AS recall_{k},"
        f" round(coalesce(avg({e}) FILTER (n_positive > 0), 0), 6) AS enrichment_{k},"
        f" round(coalesce(avg(({c})::INT) FILTER (n_positive > 0), 0), 6) AS captured_{k}"
        for k in KS for r, e, c in [metric_sql(k)])
    return f"""SELECT {by + ',' if by else ''} count(*) AS groups, count(*) FILTER (n_positive > 0) AS groups_with_positive,
  round(avg((n_positive > 0)::INT), 6) AS coverage, round(avg(n_files), 6) AS mean_files,
  round(coalesce(avg(reciprocal_rank), 0), 6) AS mrr, round(coalesce(avg(first_rank), 0), 6) AS mean_first_rank, {per_k},
  round(coalesce(quantile_cont(first_rank, 0.5), 0), 6) AS median_first_rank,
  round(coalesce(quantile_cont(reciprocal_rank, 0.5), 0), 6) AS median_reciprocal_rank
FROM counts {'GROUP BY ' + by if by else ''}"""


@query("aggregate_group_metrics", f"WITH {COUNTS_SQL} {aggregate_sql()}")
def aggregate_group_metrics(t):
    return rounded(M.aggregate_group_metrics(counts(t)))



@query("budget_curve", f"""WITH {COUNTS_SQL}, l AS ({long_sql('n_positive')})
SELECT k, round(avg(all_captured::INT), 6) AS fraction_captured, round(avg(recall), 6) AS mean_recall,
  round(avg(enrichment), 6) AS mean_enrichment FROM l WHERE n_positive > 0 GROUP BY k""")
def budget_curve(t):
    return rounded(M.budget_curve(counts(t)))


def precision_sql(group: str, score: str, source: str) -> str:
    cuts = ", ".join(
        f"CASE WHEN p > 0 THEN h{k}::DOUBLE / least({k}, n) END AS precision_{k},"
        f" CASE WHEN p > 0 THEN h{k}::DOUBLE / p END AS recall_{k}" for k in (1, 2, 3, 5))
    caps = ", ".join(f"CASE WHEN p > 0 THEN (h{k} > 0)::INT END AS capture_{k}" for k in (1, 3, 5))
    hits = ", ".join(f"count(*) FILTER (positive AND rank <= {k}) AS h{k}" for k in (1, 2, 3, 5))
    return f"""pc0 AS (SELECT {group}, count(*) AS n, count(*) FILTER (positive) AS p, min(rank) FILTER (positive) AS fr, {hits}
  FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {score} DESC, part, supp, line) AS rank FROM {source}) GROUP BY {group}),
pc AS (SELECT {group}, n AS n_files, p AS n_positive, fr AS first_rank, 1.0 / fr AS reciprocal_rank, {cuts}, {caps} FROM pc0)"""


_P_COLS = [f"{m}_{k}" for m in ("precision", "recall") for k in (1, 2, 3, 5)]
_C_COLS = [f"capture_{k}" for k in (1, 3, 5)]


@query("per_commit_precision", f"""WITH {FILES_SQL}, {precision_sql('cid', 'total', 'files')}
SELECT cid, n_files, n_positive, first_rank, round(reciprocal_rank, 6) AS reciprocal_rank,
{', '.join(f'round({c}, 6) AS {c}' for c in _P_COLS)}, {', '.join(_C_COLS)} FROM pc""")
def per_commit_precision(t):
    return rounded(M.per_commit_precision(files(t), ["cid"], "total", "positive", ["part", "supp", "line"]))


@query("per_commit_precision_summary", f"""WITH {FILES_SQL}, {precision_sql('cid', 'total', 'files')}, l AS (
{' UNION ALL '.join(f"SELECT '{c}' AS metric, {c}::DOUBLE AS value, n_positive FROM pc" for c in [*_P_COLS, *_C_COLS, 'first_rank', 'reciprocal_rank'])})
SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM l WHERE n_positive > 0 GROUP BY metric""")
def per_commit_precision_summary(t):
    per = M.per_commit_precision(files(t), ["cid"], "total", "positive", ["part", "supp", "line"])
    return rounded(M.precision_summary(per))


@query("global_topk", f"""WITH {FILES_SQL}, r AS (SELECT positive, row_number() OVER (ORDER BY price DESC, cid, line, part, supp) AS rank FROM files),
k AS (SELECT unnest([{', '.join(map(str, KS))}]) AS k)
SELECT k::INT AS k, count(*) FILTER (positive AND rank <= k) AS hits,
 round(count(*) FILTER (positive AND rank <= k)::DOUBLE / count(*) FILTER (positive), 6) AS recall,
 round(count(*) FILTER (positive AND rank <= k)::DOUBLE / k, 6) AS precision FROM r, k GROUP BY k""")
def global_topk(t):
    return rounded(M.global_topk(files(t), "price", "positive", ["cid", *SEQ]))


def areas_sql(source: str, score: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = by + "," if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""steps AS (SELECT {lead} {score} AS s, count(*) AS n, count(*) FILTER (positive) AS p FROM {source} GROUP BY {lead} {score}),
cum AS (SELECT *, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS nc, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS pc,
  sum(n) OVER ({part}) AS na, sum(p) OVER ({part}) AS pa FROM steps WINDOW w AS ({part} ORDER BY s DESC)),
areas AS (SELECT {lead} max(na)::BIGINT AS n, max(pa)::BIGINT AS n_positive, max(pa)::DOUBLE / max(na) AS prevalence,
  CASE WHEN max(pa) > 0 AND max(na) > max(pa) THEN sum((n - p) * (pc - p) + 0.5 * (n - p) * p)::DOUBLE / (max(pa) * (max(na) - max(pa))) ELSE 0 END AS roc_auc,
  CASE WHEN max(pa) > 0 AND max(na) > max(pa) THEN sum(p * pc::DOUBLE / nc) / max(pa) ELSE 0 END AS average_precision FROM cum {group})"""


@query("global_classification", f"""WITH {FILES_SQL}, {areas_sql('files', 'price')}
SELECT n, n_positive, round(prevalence, 6) AS prevalence, round(roc_auc, 6) AS roc_auc,
  round(average_precision, 6) AS average_precision, round(average_precision / prevalence, 6) AS lift FROM areas""")
def global_classification(t):
    return rounded(M.ranking_areas(files(t), "price", "positive"))


@query("threshold_metrics", f"""WITH {RANKED_SQL}, c AS (SELECT count(*) FILTER (score >= .5 AND positive) AS tp,
  count(*) FILTER (score >= .5 AND NOT positive) AS fp, count(*) FILTER (score < .5 AND NOT positive) AS tn,
  count(*) FILTER (score < .5 AND positive) AS fn FROM ranked)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def threshold_metrics(t):
    return rounded(M.threshold_metrics(ranked(t), "score", "positive"))


_AT = ", ".join(
    f"round(count(*) FILTER (positive AND k <= {k}) / {k}, 6) AS precision_at_{k}, round(count(*) FILTER (positive AND k <= {k}) / nullif(count(*) FILTER (positive), 0), 6) AS recall_at_{k}"
    for k in (5, 10, 20, 50, 100))
_TOP = ", ".join(f"round(count(*) FILTER (positive AND k <= {k}) / nullif(count(*) FILTER (positive), 0), 6) AS captured_top_{k}" for k in (10, 20, 50, 100))


@query("classification_report", f"""WITH {RANKED_SQL}, {areas_sql('ranked', 'score')}, c AS (SELECT count(*) FILTER (score >= .5 AND positive) AS tp,
  count(*) FILTER (score >= .5 AND NOT positive) AS fp, count(*) FILTER (score < .5 AND NOT positive) AS tn,
  count(*) FILTER (score < .5 AND positive) AS fn FROM ranked),
o AS (SELECT positive, row_number() OVER (ORDER BY score DESC, cid, line, part, supp) AS k FROM ranked), t AS (SELECT {_AT}, {_TOP} FROM o)
SELECT n, n_positive, round(prevalence, 6) AS prevalence, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision,
  round(average_precision / prevalence, 6) AS lift, c.*, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, t.* FROM areas, c, t""")
def classification_report(t):
    return rounded(M.classification_report(reused(ranked(t)), "score", "positive", ["cid", *SEQ]))


@query("majority_baseline", f"""WITH {FILES_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (positive) AS p FROM files)
SELECT n AS total, CASE WHEN p > n - p THEN 1 ELSE 0 END AS majority_class, round(greatest(p, n - p) / n, 6) AS accuracy FROM c""")
def majority_baseline(t):
    return rounded(M.majority_baseline(files(t), "positive"))


REPO_COUNTS_SQL = REPO_FILES_SQL + ", " + counts_sql("repo_files", "total", "repo, cid")


def repo_counts(t):
    base = M.rank_in_group(repo_files(t).select("repo", "cid", *SEQ, "total", "positive"), ["repo", "cid"], "total", [F.col(c) for c in SEQ])
    return M.group_counts(base, ["repo", "cid"], "positive")


@query("repo_metrics", f"WITH {REPO_COUNTS_SQL} {aggregate_sql('repo')}")
def repo_metrics(t):
    return rounded(M.aggregate_group_metrics(repo_counts(t), ["repo"]))


REPO_PRECISION_SQL = f"""{REPO_FILES_SQL}, {areas_sql('repo_files', 'total', 'repo')}, {precision_sql('repo, cid', 'total', 'repo_files')},
m AS (SELECT repo, count(*) AS changes, count(*) FILTER (n_positive > 0) AS positive_changes, avg(precision_1) AS mean_precision_1,
  avg(recall_1) AS mean_recall_1, avg(reciprocal_rank) AS mrr FROM pc GROUP BY repo),
rp AS (SELECT repo, n, n_positive, changes, positive_changes, prevalence,
  CASE WHEN n_positive >= 3 AND n_positive < n THEN average_precision END AS average_precision,
  mean_precision_1, mean_recall_1, mrr FROM areas JOIN m USING (repo))"""


@query("repo_precision", f"""WITH {REPO_PRECISION_SQL}
SELECT repo, n, n_positive, changes, positive_changes, round(prevalence, 6) AS prevalence, round(average_precision, 6) AS average_precision,
 round(mean_precision_1, 6) AS mean_precision_1, round(mean_recall_1, 6) AS mean_recall_1, round(mrr, 6) AS mrr FROM rp""")
def repo_precision(t):
    return rounded(_repo_precision(t))


def _repo_precision(t):
    return M.repo_precision(repo_files(t), "repo", ["cid"], "total", "positive", ["part", "supp", "line"])


_MACRO = ["prevalence", "average_precision", "mean_precision_1", "mean_recall_1", "mrr"]


@query("macro_average", f"""WITH {REPO_PRECISION_SQL}
SELECT count(*) AS repos, {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in _MACRO)} FROM rp""")
def macro_average(t):
    return rounded(M.macro_average(_repo_precision(t), _MACRO))


_SUMMARY = ["mrr", *[f"enrichment_{k}" for k in KS]]


@query("summarize_repos", f"""WITH {REPO_COUNTS_SQL}, a AS ({aggregate_sql('repo')}), l AS (
{' UNION ALL '.join(f"SELECT '{c}' AS metric, {c} AS value FROM a WHERE groups_with_positive > 0" for c in _SUMMARY)})
SELECT metric, round(quantile_cont(value, .5), 4) AS median, round(quantile_cont(value, .75) - quantile_cont(value, .25), 4) AS iqr,
  round(min(value), 4) AS min, round(max(value), 4) AS max FROM l GROUP BY metric""")
def summarize_repos(t):
    per_repo = rounded(M.aggregate_group_metrics(repo_counts(t), ["repo"]))
    return rounded(M.summarize_repos(per_repo, _SUMMARY), 4)


@query("dominance", f"""WITH {REPO_FILES_SQL}, c AS (SELECT repo, count(*) AS positives FROM repo_files WHERE positive GROUP BY repo)
SELECT repo, positives, round(positives / sum(positives) OVER (), 6) AS share, positives / sum(positives) OVER () > 0.5 AS dominant FROM c""")
def dominance(t):
    return rounded(M.dominance(repo_files(t), "repo", "positive"))


def flagship(t):
    """Rank, evaluate within each change, aggregate."""
    scored = rank_priority(files(t), ["cid"], "total", SEQ, "excluded").select("cid", *SEQ, "score", "positive")
    by_rank = M.rank_in_group(scored, ["cid"], "score", [F.col(c) for c in SEQ])
    return rounded(M.aggregate_group_metrics(M.group_counts(by_rank, ["cid"], "positive")))


query("flagship", f"WITH {COUNTS_SQL} {aggregate_sql()}")(flagship)
