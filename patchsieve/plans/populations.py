"""Population queries: documents are files, their labels the evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.operators import attribution as A
from patchsieve.operators import populations as P
from patchsieve.operators.diffs import FILE_VECTOR
from patchsieve.operators.features import CHANGE_VECTOR
from patchsieve.plans.attribution import LINKS_SQL, REPORT_SQL, linked_files, links, report
from patchsieve.plans.bindings import SEQ
from patchsieve.plans.registry import query, rounded
from patchsieve.plans.sources import NAMES as EXPERIMENTAL
from patchsieve.plans.stats import LABELED_SQL, LEVEL_SQL, labeled_rows, leveled


def rows_of(t):
    d = F.col("doc_id")
    return t.documents.select(
        F.col("source").alias("repo"), (d % 400).alias("sha"),
        F.when(F.col("n_chars") % 37 == 0, "a//dev/null").otherwise(F.concat(F.lit("f"), d % 1000)).alias("path"),
        "doc_id", F.timestamp_seconds(d * 3600).alias("ts"),
        F.when(d % 20 < 14, "train").when(d % 20 < 17, "validation").otherwise("test").alias("split"),
    )


def evidence_of(t):
    q, x = F.col("quality"), F.col("toxic")
    level = F.when((q == 0) & (x == 0), A.STRONG).when((q == 0) & (x == 1), A.MODERATE).when((q == 1) & (x == 0), A.WEAK).otherwise(A.UNKNOWN)
    level = F.when(F.col("doc_id") % 50 == 7, "OTHER").otherwise(level)
    joined = t.labels.join(rows_of(t), "doc_id").withColumn("level", level)
    return joined.groupBy("repo", "sha", "path").agg(F.min_by("level", "doc_id").alias("level"))


POP_SQL = """rw AS (SELECT source AS repo, doc_id % 400 AS sha, CASE WHEN n_chars % 37 = 0 THEN 'a//dev/null' ELSE 'f' || doc_id % 1000 END AS path, doc_id, to_timestamp(doc_id * 3600)::TIMESTAMP AS ts,
 CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation' ELSE 'test' END AS split FROM documents),
ev AS (SELECT repo, sha, path, arg_min(CASE WHEN doc_id % 50 = 7 THEN 'OTHER' WHEN quality = 0 AND toxic = 0 THEN 'FILE_STRONG' WHEN quality = 0 THEN 'FILE_MODERATE' WHEN toxic = 0 THEN 'FILE_WEAK' ELSE 'UNKNOWN' END, doc_id) AS level
 FROM labels JOIN rw USING (doc_id) GROUP BY ALL),
pop AS (SELECT rw.*, CASE WHEN contains(path, '/dev/null') THEN 'OUT_OF_SCOPE' WHEN level IS NULL THEN 'UNLABELED' WHEN level = 'FILE_STRONG' THEN 'OBSERVED_POSITIVE' WHEN level = 'FILE_MODERATE' THEN 'EVIDENCE_MODERATE'
 WHEN level = 'FILE_WEAK' THEN 'EVIDENCE_WEAK' WHEN level = 'UNKNOWN' THEN 'EVIDENCE_UNKNOWN' ELSE 'UNLABELED' END AS population FROM rw LEFT JOIN ev USING (repo, sha, path))"""


def populated(t):
    return P.supervision_populations(rows_of(t), evidence_of(t))


@query("supervision_populations", f"WITH {POP_SQL} SELECT doc_id, population FROM pop")
def supervision_populations(t):
    return populated(t).select("doc_id", "population")


@query("population_metadata", f"""WITH {POP_SQL} SELECT population, count(*) AS rows, count(DISTINCT sha) AS commits, count(DISTINCT repo) AS repos, min(ts) AS first, max(ts) AS last FROM pop GROUP BY 1""")
def population_metadata(t):
    out = P.population_metadata(populated(t))
    return out.withColumn("first", F.col("first").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz"))


_CHECKS = [("OP_intersect_EW", "OBSERVED_POSITIVE", "EVIDENCE_WEAK"), ("OP_intersect_EU", "OBSERVED_POSITIVE", "EVIDENCE_UNKNOWN"),
           ("EW_intersect_EU", "EVIDENCE_WEAK", "EVIDENCE_UNKNOWN"), ("OP_intersect_EM", "OBSERVED_POSITIVE", "EVIDENCE_MODERATE"),
           ("EM_intersect_EW", "EVIDENCE_MODERATE", "EVIDENCE_WEAK"), ("EM_intersect_EU", "EVIDENCE_MODERATE", "EVIDENCE_UNKNOWN")]


def _overlap_sql(name, a, b):
    keys = lambda p: f"SELECT repo, path FROM pop WHERE population = '{p}'"
    return f"SELECT '{name}' AS \"check\", count(*) AS keys, count(*) = 0 AS ok FROM ({keys(a)} INTERSECT {keys(b)})"


@query("disjointness", f"WITH {POP_SQL} " + " UNION ALL ".join(_overlap_sql(*c) for c in _CHECKS))
def disjointness(t):
    return P.disjointness(populated(t), ["repo", "path"])


_POPS = list(P.POPULATIONS)


@query("reconcile", f"""WITH {POP_SQL}, r AS (SELECT grouping(split) AS o, split, count(*) AS raw_total, {', '.join(f"count(*) FILTER (population = '{p}') AS {p.lower()}" for p in _POPS)},
 count(DISTINCT CASE WHEN population = 'OBSERVED_POSITIVE' THEN repo END) AS repos_with_signal, count(DISTINCT repo) AS repos FROM pop GROUP BY ROLLUP (split))
SELECT CASE WHEN o = 1 THEN 'all' ELSE split END AS split, raw_total, {', '.join(p.lower() for p in _POPS)}, repos_with_signal, repos, {' + '.join(p.lower() for p in _POPS)} = raw_total AS reconciled,
 CASE WHEN observed_positive = 0 THEN 'zero observed rows' WHEN repos_with_signal = 0 THEN 'no repositories with signal' END AS warning FROM r""")
def reconcile(t):
    return P.reconcile(populated(t))


def _pu_sql(primary):
    aside = "(w OR u)" if primary else "false"
    return f"""WITH {POP_SQL}, fl AS (SELECT sha, path, bool_or(population = 'OBSERVED_POSITIVE') AS p, bool_or(population = 'EVIDENCE_WEAK') AS w, bool_or(population = 'EVIDENCE_UNKNOWN') AS u,
 bool_or(population = 'OUT_OF_SCOPE') AS o FROM pop GROUP BY ALL) SELECT doc_id, (p AND NOT o)::INT AS label, NOT o AND (p OR NOT {aside}) AS included FROM rw JOIN fl USING (sha, path)"""


@query("pu_labels_primary", _pu_sql(True))
def pu_labels_primary(t):
    return P.pu_labels(rows_of(t), populated(t)).select("doc_id", "label", "included")


@query("pu_labels_sensitivity", _pu_sql(False))
def pu_labels_sensitivity(t):
    return P.pu_labels(rows_of(t), populated(t), "sensitivity").select("doc_id", "label", "included")


@query("matched_controls", f"WITH {POP_SQL} SELECT repo, count(*) FILTER (population = 'OBSERVED_POSITIVE') AS positive, count(*) FILTER (population = 'UNLABELED') AS unlabeled FROM pop GROUP BY 1")
def matched_controls(t):
    return P.matched_controls(populated(t))


@query("observation_time", f"""WITH {POP_SQL}, ch AS (SELECT repo, sha, max(ts) AS ts FROM pop GROUP BY ALL), e AS (SELECT repo, max(ts) AS e FROM ch GROUP BY 1),
a AS (SELECT repo, sha, (epoch_us(e) - epoch_us(ts)) / 86400000000.0 AS value FROM ch JOIN e USING (repo)),
b AS (SELECT 'all' AS population, value FROM a UNION ALL SELECT 'positive', a.value FROM pop p JOIN a USING (repo, sha) WHERE population = 'OBSERVED_POSITIVE'),
m AS (SELECT quantile_cont(value, .5) AS m, count(*) AS n FROM a), x AS (SELECT (SELECT count(*) FROM b WHERE population = 'positive') AS event_observed, (SELECT count(*) FROM a, m WHERE value > m.m) AS right_censored, (SELECT n FROM m) AS n),
d AS (SELECT population, count(value) AS count, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, .5) AS median, quantile_cont(value, .1) AS p10, quantile_cont(value, .25) AS p25,
 quantile_cont(value, .75) AS p75, quantile_cont(value, .9) AS p90, quantile_cont(value, .75) - quantile_cont(value, .25) AS iqr FROM b GROUP BY 1)
SELECT population, count, {', '.join(f'round({c}, 4) AS {c}' for c in ('mean', 'std', 'min', 'max', 'median', 'p10', 'p25', 'p75', 'p90', 'iqr'))}, event_observed, right_censored, greatest(0, n - event_observed - right_censored) AS insufficient_history FROM d, x""")
def observation_time(t):
    pop = populated(t)
    changes = pop.groupBy("repo", "sha").agg(F.max("ts").alias("ts"))
    return rounded(P.observation_time(changes, pop.where(F.col("population") == P.POSITIVE)), 4)


# ---- path based roles of order lines -------------------------------------------------------

SETS_SQL = f"""{LINKS_SQL}, role AS (SELECT f.sha, f.path, f.seq, CASE WHEN f.part % 29 = 0 THEN 'out_of_scope' WHEN category = 'FILE_PARTIAL' AND shared THEN 'observed_path_associated'
 WHEN category = 'COMMIT_ONLY' AND shared THEN 'sensitivity_commit_only_overlap' ELSE 'unlabeled' END AS role, CASE WHEN f.sha % 10 < 7 THEN 'train' WHEN f.sha % 10 < 8 THEN 'validation' ELSE 'test' END AS split
 FROM files f LEFT JOIN overlap o ON o.sha = f.sha LEFT JOIN cand c ON c.sha = f.sha AND c.path = f.path)"""


def roles(t):
    f, k = linked_files(t), links(t)
    over = A.path_overlap(k, f)
    shared = A.candidate_paths(k, f).where("shared")
    rows = f.withColumn("split", F.when(F.col("sha") % 10 < 7, "train").when(F.col("sha") % 10 < 8, "validation").otherwise("test"))
    rows = rows.withColumn("real", F.col("path")).withColumn("path", F.when(F.col("part") % 29 == 0, "/dev/null").otherwise(F.col("path")))
    return P.supervision_sets(rows, over, shared)


@query("supervision_sets", f"WITH {SETS_SQL} SELECT split, role, count(*) AS n FROM role GROUP BY ALL")
def supervision_sets(t):
    return roles(t).groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"))


@query("supervision_set_rows", f"WITH {SETS_SQL} SELECT sha, seq, role FROM role")
def supervision_set_rows(t):
    return roles(t).select("sha", "seq", "role")


@query("pu_dataset_accounting", f"""WITH {SETS_SQL}, l AS (SELECT split, sha, path, arg_max(role, seq) AS role FROM role GROUP BY ALL)
SELECT split, count(*) AS keys, count(*) FILTER (role = 'observed_path_associated') AS p, count(*) FILTER (role = 'unlabeled') AS u, count(*) FILTER (role = 'sensitivity_commit_only_overlap') AS s, count(*) FILTER (role = 'out_of_scope') AS o FROM l GROUP BY split""")
def pu_dataset_accounting(t):
    return P.pu_accounting(roles(t).drop("path").withColumnRenamed("real", "path"), ["seq"])


# ---- pairs ------------------------------------------------------------------------------------

PAIR_SQL = f"""{LEVEL_SQL}, lc AS (SELECT repo, cid AS sha, count(*) FILTER (level = 'FILE_STRONG') AS s, count(*) FILTER (level = 'FILE_WEAK') AS w, count(*) FILTER (level = 'UNKNOWN') AS u,
 count(*) FILTER (level = 'FILE_MODERATE') AS m FROM lev WHERE identity GROUP BY ALL),
pairs AS (SELECT repo, sha, 'STRONG_vs_WEAK' AS category, s * w AS pairs FROM lc UNION ALL SELECT repo, sha, 'STRONG_vs_UNKNOWN', s * u FROM lc
 UNION ALL SELECT repo, sha, 'WEAK_vs_UNKNOWN', w * u FROM lc UNION ALL SELECT repo, sha, 'STRONG_vs_MODERATE', s * m FROM lc)"""


def pairs(t):
    return P.pair_counts(leveled(t).withColumnRenamed("cid", "sha"), ["repo", "sha"])


@query("evidence_pairs", f"WITH {PAIR_SQL} SELECT * FROM pairs WHERE pairs > 0")
def evidence_pairs(t):
    return pairs(t)


@query("pair_stats", f"WITH {PAIR_SQL} SELECT category, sum(pairs)::BIGINT AS pairs, count(DISTINCT repo) AS repos, count(DISTINCT sha) AS commits FROM pairs WHERE pairs > 0 GROUP BY 1")
def pair_stats(t):
    return P.pair_stats(pairs(t))


def _leaders_sql(column):
    return f"""WITH {PAIR_SQL}, c AS (SELECT category, {column}, sum(pairs)::BIGINT AS pairs FROM pairs WHERE pairs > 0 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pairs DESC, {column}) AS place FROM c) WHERE place <= 5"""


@query("pair_leading_repos", _leaders_sql("repo"))
def pair_leading_repos(t):
    return P.pair_leaders(pairs(t), "repo")


@query("pair_leading_commits", _leaders_sql("sha"))
def pair_leading_commits(t):
    return P.pair_leaders(pairs(t), "sha")


@query("pairs_by_split", f"""WITH {PAIR_SQL} SELECT category, CASE n_regionkey WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, sum(pairs)::BIGINT AS pairs, count(DISTINCT sha) AS commits, count(DISTINCT repo) AS repos
FROM pairs JOIN nation ON repo = n_nationkey WHERE pairs > 0 GROUP BY 1, 2""")
def pairs_by_split(t):
    r = F.col("n_regionkey")
    manifest = t.nation.select(F.col("n_nationkey").alias("repo"), F.when(r == 0, "test").when(r == 1, "validation").otherwise("train").alias("split"))
    return P.pairs_by_split(pairs(t), manifest)


@query("aligned_pairs", f"""WITH {LEVEL_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY cid, level ORDER BY line, part, supp) - 1 AS i, count(*) OVER (PARTITION BY cid, level) AS m FROM lev WHERE identity AND level IN ('FILE_STRONG', 'FILE_WEAK'))
SELECT s.cid, s.part AS strong_part, s.line AS strong_line, w.part AS weak_part, w.line AS weak_line FROM i s JOIN i w ON s.cid = w.cid AND s.level = 'FILE_STRONG' AND w.level = 'FILE_WEAK'
 AND CASE WHEN s.m >= w.m THEN s.i % w.m = w.i ELSE w.i % s.m = s.i END""")
def aligned_pairs(t):
    out = P.aligned_pairs(leveled(t), ["cid"], SEQ)
    return out.select("cid", F.col("s.part").alias("strong_part"), F.col("s.line").alias("strong_line"),
                      F.col("w.part").alias("weak_part"), F.col("w.line").alias("weak_line"))


@query("signal_coverage", f"""WITH {REPORT_SQL}, u AS (SELECT sha, path, unnest(types) AS a FROM report)
SELECT x.a, y.a AS b, count(*) AS files FROM u x JOIN u y ON x.sha = y.sha AND x.path = y.path AND x.a <= y.a GROUP BY 1, 2""")
def signal_coverage(t):
    return P.signal_coverage(report(t))


# ---- audits --------------------------------------------------------------------------------------


_AUDITED = [*CHANGE_VECTOR, *FILE_VECTOR, *EXPERIMENTAL, *P.FORBIDDEN, P.REPOSITORY]
_AUDITED_SQL = "[" + ", ".join(f"'{n}'" for n in _AUDITED) + "]"


@query("leakage_audit", f"""WITH used AS (SELECT DISTINCT {_AUDITED_SQL}[p_partkey % {len(_AUDITED)} + 1] AS feature FROM part)
SELECT feature, feature IN ({', '.join(f"'{n}'" for n in P.FORBIDDEN)}) AS forbidden, feature = '{P.REPOSITORY}' AS repository,
 CASE WHEN feature IN ({', '.join(f"'{n}'" for n in P.FORBIDDEN)}) OR feature = '{P.REPOSITORY}' THEN 'FAIL' ELSE 'PASS' END AS result FROM used""")
def leakage_audit(t):
    name = F.element_at(F.array(*map(F.lit, _AUDITED)), (F.col("p_partkey") % len(_AUDITED) + 1).cast("int"))
    return P.leakage_audit(t.part.select(name.alias("feature")))


@query("split_audit", f"""WITH {LABELED_SQL} SELECT split, count(*) AS rows, count(*) FILTER (defect_label = 1) AS positive, count(*) FILTER (defect_label = 0) AS negative, count(*) FILTER (defect_label = -1) AS ambiguous,
 count(DISTINCT repo) AS repos, count(DISTINCT CASE WHEN defect_label = 1 THEN sha END) AS positive_commits, round(count(*) FILTER (defect_label = 1) / count(*), 6) AS prevalence FROM lab GROUP BY split""")
def split_audit(t):
    return rounded(P.split_audit(labeled_rows(t)))


def _split_overlap_sql(column):
    return f"""WITH {LABELED_SQL}, f AS (SELECT {column}, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS b, bool_or(split = 'test') AS c FROM lab GROUP BY 1)
SELECT count(*) FILTER (a AND b) AS train_val, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS val_test, count(*) FILTER (a AND b AND c) AS all_three FROM f"""


@query("split_overlap_repos", _split_overlap_sql("repo"))
def split_overlap_repos(t):
    return P.split_overlap(labeled_rows(t), "repo")


@query("split_overlap_paths", _split_overlap_sql("path"))
def split_overlap_paths(t):
    return P.split_overlap(labeled_rows(t), "path")


@query("positives_in_several_splits", f"WITH {LABELED_SQL} SELECT repo, count(DISTINCT split) AS splits, count(*) AS positive FROM lab WHERE defect_label = 1 GROUP BY 1 HAVING count(DISTINCT split) > 1")
def positives_in_several_splits(t):
    return P.positives_in_several_splits(labeled_rows(t))
