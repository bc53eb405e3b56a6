"""Ranking queries on order lines: an order is a change, a line is a changed file."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.operators import ranking as R
from patchsieve.plans.bindings import FILES_SQL, RANKED_SQL, REPO_FILES_SQL, SEQ, files, repo_files
from patchsieve.plans.registry import query, rounded


def ranked(t):
    return R.rank_priority(files(t), ["cid"], "total", SEQ, "excluded")


@query("rank_priority", f"""WITH {RANKED_SQL}
SELECT cid, line, part, supp, position, round(score, 6) AS score FROM ranked""")
def rank_priority(t):
    return rounded(ranked(t).select("cid", *SEQ, "position", "score"))


@query("risk_output", f"""WITH {RANKED_SQL}
SELECT cid, line, part, supp, CASE WHEN excluded THEN 0 ELSE position + 1 END AS rank,
  CASE WHEN excluded THEN 'Binary file ' || part || ' not scored' END AS warning,
  count(*) FILTER (NOT excluded) OVER (PARTITION BY cid) AS files_analyzed,
  count(*) FILTER (excluded) OVER (PARTITION BY cid) AS files_skipped
FROM ranked""")
def risk_output(t):
    base = ranked(t)
    out = R.risk_output(base, "part", "excluded").join(R.risk_counts(base, ["cid"], "excluded"), "cid")
    return out.select("cid", *SEQ, "rank", "warning", "files_analyzed", "files_skipped")


@query("rank_normalize", f"""WITH {FILES_SQL}
SELECT cid, line, part, supp, round(1.0 - (row_number() OVER (PARTITION BY cid ORDER BY price DESC, line, part, supp) - 1)
  / greatest(count(*) OVER (PARTITION BY cid) - 1, 1)::DOUBLE, 6) AS score FROM files""")
def rank_normalize(t):
    return rounded(R.rank_normalize(files(t), ["cid"], "price", SEQ).select("cid", *SEQ, "score"))


SIGNALS_SQL = FILES_SQL + """, sig AS (
  SELECT cid, line, part, supp, total::DOUBLE AS s0, (added % 7 + deleted)::DOUBLE AS s1,
         (hunks + deleted % 3)::DOUBLE AS s2, hunks::DOUBLE AS s3, positive FROM files)"""


def _signals(t):
    base = files(t).select(
        "*", (F.col("added") % 7).alias("function_declarations_added"), F.col("deleted").alias("function_declarations_deleted"),
        F.col("hunks").alias("imports_added"), (F.col("deleted") % 3).alias("imports_deleted"),
        F.col("hunks").alias("hunk_count"),
    )
    return R.signals(base).withColumn("s0", F.col("total").cast("double"))


@query("signals", f"WITH {SIGNALS_SQL} SELECT cid, line, part, supp, s1, s2, s3 FROM sig")
def signals(t):
    return _signals(t).select("cid", *SEQ, "s1", "s2", "s3")


def _norm_sql(c):
    return (f"1.0 - (row_number() OVER (PARTITION BY cid ORDER BY {c} DESC, line, part, supp) - 1)"
            f" / greatest(count(*) OVER (PARTITION BY cid) - 1, 1)::DOUBLE")


@query("blend_scores", f"""WITH {SIGNALS_SQL}, n AS (SELECT cid, line, part, supp, {_norm_sql('s0')} AS b1,
  {_norm_sql('s1')} AS b2, {_norm_sql('s2')} AS b3, {_norm_sql('s3')} AS b4 FROM sig)
SELECT cid, line, part, supp, round(b1, 6) AS c1, round(.7*b1+.3*b2, 6) AS c2,
  round(.5*b1+.2*b2+.15*b3+.15*b4, 6) AS c3, round(.2*b2+.15*b3+.15*b4, 6) AS c3_without_b1,
  round(.5*b1+.15*b3+.15*b4, 6) AS c3_without_b2, round(.5*b1+.2*b2+.15*b4, 6) AS c3_without_b3,
  round(.5*b1+.2*b2+.15*b3, 6) AS c3_without_b4 FROM n""")
def blend_scores(t):
    parts = {"b1": "s0", "b2": "s1", "b3": "s2", "b4": "s3"}
    out = R.blend_scores(R.normalized_signals(_signals(t), ["cid"], parts, SEQ), list(parts))
    names = ["c1", "c2", "c3", *[f"c3_without_{b}" for b in parts]]
    return rounded(out.select("cid", *SEQ, *names))


def hash_sql(seed, *keys):
    m = R.MODULUS
    h = f"({seed} % {m})"
    for k in keys:
        h = f"(({h} * 48271 + ({k} % {m}) * 16807 + 12345) % {m})"
    return f"((({h} * 69621 + 7919) % {m}) * 48271 + 11) % {m}"


RANDOM_SQL = f"({hash_sql('42::BIGINT', 'cid', 'line', 'part', 'supp')}) / {R.MODULUS}.0::DOUBLE"


def random_files(t, seed=42):
    return R.random_baseline(files(t), seed, ["cid", *SEQ], "random_score")


@query("random_baseline", f"""WITH {FILES_SQL}
SELECT cid, line, part, supp, round({RANDOM_SQL}, 6) AS random_score FROM files""")
def random_baseline(t):
    return rounded(random_files(t).select("cid", *SEQ, "random_score"))


BANDED_SQL = RANKED_SQL + """, banded AS (
  SELECT *, CASE WHEN excluded THEN 'low' WHEN position = 0 THEN 'highest' WHEN position <= n_ranked // 4 THEN 'high'
    WHEN position <= n_ranked // 2 THEN 'medium' ELSE 'low' END AS band FROM ranked)"""


@query("priority_band", f"WITH {BANDED_SQL} SELECT cid, line, part, supp, band FROM banded")
def priority_band(t):
    return R.priority_band(ranked(t), "excluded").select("cid", *SEQ, "band")


@query("priority_summary", f"""WITH {BANDED_SQL}
SELECT cid, count(*) AS total_files, count(*) FILTER (NOT excluded) AS files_ranked,
  count(*) FILTER (excluded) AS files_binary, count(*) FILTER (band = 'highest') AS highest_count,
  count(*) FILTER (band = 'high') AS high_count, count(*) FILTER (band = 'medium') AS medium_count,
  count(*) FILTER (band = 'low') AS low_count, count(*) FILTER (hunks > 0) AS evidence_available,
  count(*) FILTER (hunks = 0) AS evidence_unavailable FROM banded GROUP BY cid""")
def priority_summary(t):
    return R.priority_summary(R.priority_band(ranked(t), "excluded"), ["cid"], "excluded", "hunks")


@query("rank_predictions", f"""WITH {FILES_SQL}
SELECT cid, line, part, supp, row_number() OVER (PARTITION BY cid ORDER BY price DESC, line, part, supp) AS rank,
  count(*) OVER (PARTITION BY cid) AS group_size FROM files""")
def rank_predictions(t):
    return R.rank_predictions(files(t), ["cid"], "price", SEQ).select("cid", *SEQ, "rank", "group_size")


@query("minmax_normalize", f"""WITH {FILES_SQL}, e AS (SELECT cid, min(price) AS lo, max(price) AS hi FROM files GROUP BY cid),
g AS (SELECT min(price) AS lo, max(price) AS hi FROM files)
SELECT cid, line, part, supp, round((price - g.lo) / (g.hi - g.lo), 6) AS overall,
  round(CASE WHEN e.hi - e.lo = 0 THEN 0.5 ELSE (price - e.lo) / (e.hi - e.lo) END, 6) AS in_group
FROM files JOIN e USING (cid), g""")
def minmax_normalize(t):
    out = R.minmax_normalize(files(t), "price", "overall")
    out = R.minmax_normalize(out, "price", "in_group", ["cid"], tolerance=0.0)
    return rounded(out.select("cid", *SEQ, "overall", "in_group"))


@query("top_cut_capture", f"""WITH {FILES_SQL}, r AS (
  SELECT positive, row_number() OVER (ORDER BY price DESC, line, part, supp, cid) AS rank, count(*) OVER () AS n,
    count(*) FILTER (positive) OVER () AS p FROM files),
c AS (SELECT * FROM (VALUES ('top_10', 10, 0), ('top_20', 20, 0), ('top_50', 50, 0), ('top_100', 100, 0),
  ('top_10_percent', 0, 10), ('top_20_percent', 0, 5)) v(cut, k, d))
SELECT cut, max(CASE WHEN d > 0 THEN greatest(1, n // nullif(d, 0)) ELSE least(k, n) END)::BIGINT AS rows,
  count(*) FILTER (positive AND rank <= CASE WHEN d > 0 THEN greatest(1, n // nullif(d, 0)) ELSE k END) AS captured,
  round(100.0 * count(*) FILTER (positive AND rank <= CASE WHEN d > 0 THEN greatest(1, n // nullif(d, 0)) ELSE k END) / max(p), 6) AS percent
FROM r, c GROUP BY cut""")
def top_cut_capture(t):
    return rounded(R.top_cut_capture(files(t), "price", "positive", [*SEQ, "cid"]))


@query("rank_importance", """WITH w AS (SELECT p_brand AS name, sum(l_quantity * (l_discount - 0.05)) AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT name, round(abs(weight) / max(abs(weight)) OVER (), 6) AS importance,
  row_number() OVER (ORDER BY round(abs(weight), 4) DESC, name) AS rank FROM w""")
def rank_importance(t):
    weights = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("name")
    ).agg(F.sum(F.col("l_quantity") * (F.col("l_discount") - 0.05)).alias("weight"))
    return rounded(R.rank_importance(weights, "name", "weight").select("name", "importance", "rank"))


@query("candidate_ranking", f"""WITH {REPO_FILES_SQL}, c AS (
  SELECT repo, cid, count(*) AS f, count(*) FILTER (positive) AS p FROM repo_files GROUP BY repo, cid)
SELECT repo, count(*) AS changes, sum(f)::BIGINT AS files, count(*) FILTER (p > 0) AS positive_changes,
  coalesce(sum(f) FILTER (p > 0), 0)::BIGINT AS positive_files FROM c GROUP BY repo HAVING count(*) >= 50""")
def candidate_ranking(t):
    return R.candidate_ranking(repo_files(t), "repo", "cid", "positive")


@query("top_k_eligible", f"""WITH {FILES_SQL}, r AS (
  SELECT cid, line, part, supp, row_number() OVER (PARTITION BY cid ORDER BY line, part, supp) AS slot
  FROM files WHERE NOT excluded AND deleted <> 8) SELECT * FROM r WHERE slot <= 10""")
def top_k_eligible(t):
    out = R.top_k_eligible(files(t), ["cid"], SEQ, "excluded", F.col("deleted") == 8)
    return out.select("cid", *SEQ, "slot")
