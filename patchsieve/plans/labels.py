"""Label queries: documents are changes that quote each other's ids; a source is a path."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.functions import messages as M
from patchsieve.operators import labels as B
from patchsieve.operators.frames import number_rows, reused, written
from patchsieve.plans.functions import FIX_SQL
from patchsieve.plans.registry import query

REPO = ["repo"]


def changes(t):
    c = F.col
    sha = lambda back: F.md5((c("doc_id") - back).cast("string"))
    kind = c("doc_id") % 8
    text = F.concat(F.lit(" "), c("text"))
    message = (
        F.when(kind == 0, F.concat(F.lit("Fix "), sha(3), text))
        .when(kind == 1, F.concat(F.lit("fixes "), F.substring(sha(2), 1, 12), text))
        .when(kind == 2, F.concat(F.lit("bug "), F.substring(sha(5), 1, 7), text))
        .when(kind == 3, F.concat(F.lit("patch "), sha(1), F.lit(" and "), F.upper(sha(2)), text))
        .when(kind == 4, F.concat(F.lit('Revert "note '), c("doc_id") - 5, F.lit('"')))
        .when(kind == 5, F.concat(F.lit("revert this "), F.substring(sha(3), 1, 20), text))
        .when(kind == 6, F.concat(F.lit("feature"), text))
        .otherwise(F.concat(F.lit("  note "), c("doc_id"), F.lit("\n")))
    )
    base = t.documents.select(
        c("lang").alias("repo"), c("doc_id").alias("doc"), c("source").alias("path"), "n_chars",
        F.md5(c("doc_id").cast("string")).alias("sha"), message.alias("message"),
        F.size(F.split("text", "\n")).alias("n_files"), M.is_bug_fix(message, c("n_chars")).alias("is_fix"),
    )
    # ids alone are numbered: a slice of an ordered frame has a bounded number of rows, not of bytes
    ids = t.documents.select(c("lang").alias("__repo"), c("doc_id").alias("__doc"))
    places = number_rows(ids, ["__repo"], [c("__doc")], "pos")
    place = c("repo").eqNullSafe(c("__repo")) & c("doc").eqNullSafe(c("__doc"))
    # what is read off a message is found in the scan, so that no message is shuffled to its position
    return base.withColumns(B.said(c("message"))).drop("message").join(places, place).drop("__repo", "__doc")


CHANGES_SQL = rf"""m0 AS (SELECT lang AS repo, doc_id AS doc, source AS path, n_chars, md5(doc_id::VARCHAR) AS sha,
  len(string_split(text, chr(10))) AS n_files, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos,
  CASE doc_id % 8 WHEN 0 THEN 'Fix ' || md5((doc_id - 3)::VARCHAR) || ' ' || text
   WHEN 1 THEN 'fixes ' || substr(md5((doc_id - 2)::VARCHAR), 1, 12) || ' ' || text
   WHEN 2 THEN 'bug ' || substr(md5((doc_id - 5)::VARCHAR), 1, 7) || ' ' || text
   WHEN 3 THEN 'patch ' || md5((doc_id - 1)::VARCHAR) || ' and ' || upper(md5((doc_id - 2)::VARCHAR)) || ' ' || text
   WHEN 4 THEN 'Revert "note ' || (doc_id - 5) || '"' WHEN 5 THEN 'revert this ' || substr(md5((doc_id - 3)::VARCHAR), 1, 20) || ' ' || text
   WHEN 6 THEN 'feature ' || text ELSE '  note ' || doc_id || chr(10) END AS message FROM documents),
changes AS (SELECT *, {FIX_SQL} AND n_chars <> 0 AS is_fix FROM m0),
tok AS (SELECT DISTINCT repo, sha, lower(unnest(regexp_extract_all(message, '(?i)[0-9a-f]{{7,40}}'))) AS token FROM changes),
hit AS (SELECT t.repo, t.sha, t.token, c.sha AS id, c.pos FROM tok t JOIN changes c ON c.repo = t.repo AND starts_with(c.sha, t.token)),
per AS (SELECT repo, sha, token, count(*) AS n, min(id) AS one, arg_max(id, pos) AS newest,
  count(*) FILTER (id <> sha) AS n2, min(id) FILTER (id <> sha) AS one2 FROM hit GROUP BY ALL),
refs AS (SELECT repo, sha, min(h) AS resolved FROM (SELECT repo, sha, CASE WHEN len(token) = 12 THEN newest WHEN n = 1 THEN one END AS h, len(token) <> 12 AND n > 1 AS u FROM per)
  GROUP BY repo, sha HAVING NOT bool_or(u) AND min(h) = max(h)),
refs2 AS (SELECT repo, sha, min(h) AS resolved FROM (SELECT repo, sha, CASE WHEN len(token) = 12 THEN newest WHEN n2 = 1 THEN one2 END AS h, len(token) <> 12 AND n2 > 1 AS u FROM per)
  GROUP BY repo, sha HAVING NOT bool_or(u) AND min(h) = max(h)),
rev AS (SELECT repo, sha, pos, message FROM changes WHERE regexp_matches(trim(message), '(?i)^revert\s')),
titles AS (SELECT repo, trim(message, ' ' || chr(10)) AS title, arg_max(sha, pos) AS titled FROM changes GROUP BY 1, 2),
reverted AS (SELECT repo, reverted, arg_max(sha, pos) AS reverting FROM (
  SELECT rev.repo, rev.sha, rev.pos, coalesce(r.resolved, t.titled) AS reverted FROM rev LEFT JOIN refs r ON r.repo = rev.repo AND r.sha = rev.sha
  LEFT JOIN titles t ON t.repo = rev.repo AND r.resolved IS NULL AND t.title = trim(regexp_extract(message, '(?i)Revert\s+["''](.+?)["'']', 1)) AND t.title <> '')
  WHERE reverted IS NOT NULL GROUP BY ALL),
fixes AS (SELECT * FROM changes WHERE is_fix AND n_files <= 20),
explicit AS (SELECT f.repo, r.resolved AS sha, arg_min(f.sha, f.pos) AS cause FROM fixes f JOIN refs2 r ON f.repo = r.repo AND f.sha = r.sha WHERE r.resolved <> f.sha GROUP BY 1, 2),
by_revert AS (SELECT repo, reverted AS sha, reverting AS cause FROM reverted r WHERE NOT EXISTS (SELECT 1 FROM explicit e WHERE e.repo = r.repo AND e.sha = r.reverted))"""


@query("resolve_refs", f"WITH {CHANGES_SQL} SELECT repo, sha, resolved FROM refs")
def resolve_refs(t):
    c = changes(t)
    return B.resolve_refs(c, c, REPO)


@query("revert_map", f"WITH {CHANGES_SQL} SELECT repo, reverted, reverting FROM reverted")
def revert_map(t):
    return B.revert_map(changes(t), REPO)


@query("active_fixes", f"WITH {CHANGES_SQL} SELECT repo, sha, pos FROM fixes")
def active_fixes(t):
    return B.active_fixes(changes(t)).select("repo", "sha", "pos")


@query("explicit_attribution", f"WITH {CHANGES_SQL} SELECT repo, sha, cause FROM explicit")
def explicit_attribution(t):
    return B.explicit_attribution(changes(t), REPO)


@query("revert_attribution", f"WITH {CHANGES_SQL} SELECT repo, sha, cause FROM by_revert")
def revert_attribution(t):
    c = changes(t)
    return B.revert_attribution(c, REPO, B.explicit_attribution(c, REPO))


@query("resolve_prefix", """WITH ids AS (SELECT lang AS repo, md5(doc_id::VARCHAR) AS sha FROM documents),
asked AS (SELECT DISTINCT lang AS repo, substr(md5((doc_id // 2)::VARCHAR), 1, (8 + doc_id % 9)::INT) AS prefix FROM documents)
SELECT a.repo, prefix, min(sha) AS resolved FROM asked a JOIN ids i ON a.repo = i.repo AND starts_with(sha, prefix) GROUP BY a.repo, prefix HAVING count(*) = 1""")
def resolve_prefix(t):
    doc = F.col("doc_id")
    ids = t.documents.select(F.col("lang").alias("repo"), F.md5(doc.cast("string")).alias("sha"))
    half = F.md5(F.floor(doc / 2).cast("string"))
    asked = t.documents.select(
        F.col("lang").alias("repo"), half.substr(F.lit(1), (doc % 9 + 8).cast("int")).alias("prefix")
    )
    return B.resolve_prefix(asked, ids, REPO, "prefix")


# ---- later fixes on the same path: events of a user are changes ---------------

EVENTS_SQL = """ev AS (SELECT user_id AS repo, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, ts,
  CAST(props->>'$.k' AS INT) % 10 AS path, event_type = 'error' AS is_fix FROM events)"""


def event_changes(t):
    rows = t.events.select(
        F.col("user_id").alias("repo"), "ts", "event_id",
        (F.get_json_object("props", "$.k").cast("int") % 10).alias("path"),
        (F.col("event_type") == "error").alias("is_fix"),
    )
    return number_rows(rows, ["repo"], [F.col("ts"), F.col("event_id")], "pos")


@query("ambiguous_evidence", f"""WITH {EVENTS_SQL} SELECT DISTINCT c.repo, c.pos FROM ev c JOIN ev f ON f.repo = c.repo AND f.path = c.path AND f.is_fix
  AND f.pos BETWEEN c.pos + 1 AND c.pos + 20 WHERE NOT EXISTS (SELECT 1 FROM ev q WHERE q.repo = c.repo AND q.pos > c.pos AND q.pos <= f.pos
  AND q.ts >= c.ts + INTERVAL 3 DAY)""")
def ambiguous_evidence(t):
    ev = event_changes(t)
    return B.ambiguous_evidence(
        ev.select("repo", "pos", "path", "is_fix"), ev.select("repo", "pos", "ts"), REPO, window=20, days=2
    )


# ---- lines put back by a small later fix: order lines are hunks ---------------

OVERLAP_SQL = """ords AS (SELECT o_orderkey AS sha, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos, o_orderpriority = '1-URGENT' AS is_fix FROM orders),
hunks AS (SELECT 0 AS repo, l_orderkey AS sha, pos, l_partkey % 400 AS path, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS hunk,
  l_linenumber * 10 AS old_start, CAST(l_quantity AS BIGINT) % 8 + 1 AS old_count, l_suppkey AS supp, is_fix FROM lineitem JOIN ords ON l_orderkey = sha),
sizes AS (SELECT l_orderkey AS sha, count(*) AS n_files, sum(CAST(l_quantity AS BIGINT)) AS n_lines FROM lineitem GROUP BY 1),
fx AS (SELECT h.* FROM hunks h JOIN sizes USING (sha) WHERE is_fix AND n_files <= 5 AND n_lines <= 200),
added AS (SELECT sha, path, hunk, old_start + j AS at, 'L' || ((old_start + j) * 7 + path) % 4 AS text FROM fx, (SELECT unnest([0, 1, 2]) AS j)),
parent AS (SELECT DISTINCT sha, path, old_start + j AS line_no, 'L' || ((old_start + j) * 7 + path + supp % 3) % 4 AS text FROM hunks, (SELECT unnest(range(10)) AS j)),
pairs AS (SELECT c.sha, c.path, c.hunk AS ch, f.sha AS fix, f.pos AS fp, f.hunk AS fh, greatest(c.old_start, f.old_start) AS s,
  least(c.old_start + c.old_count, f.old_start + f.old_count) AS e FROM fx f JOIN hunks c ON c.path = f.path AND c.pos BETWEEN f.pos - 100 AND f.pos - 1
  AND c.old_start < f.old_start + f.old_count AND f.old_start < c.old_start + c.old_count WHERE c.sha % 10 <> 0),
held AS (SELECT p.*, EXISTS (SELECT 1 FROM parent b WHERE b.sha = p.sha AND b.path = p.path AND b.text = a.text AND b.line_no BETWEEN s AND e) AS ok
  FROM pairs p JOIN added a ON a.sha = p.fix AND a.path = p.path AND a.hunk = p.fh AND a.at BETWEEN s AND e),
good AS (SELECT sha, path, fix, fp FROM held GROUP BY sha, path, ch, fix, fp, fh HAVING bool_and(ok))"""


def hunk_tables(t):
    c = F.col
    ords = number_rows(
        t.orders.select(c("o_orderkey").alias("sha"), "o_orderdate", (c("o_orderpriority") == "1-URGENT").alias("is_fix")),
        [], [c("o_orderdate"), c("sha")], "pos",
    )
    # the changes are numbered and met by their hunks once
    hunks = written(t.lineitem.join(ords, c("l_orderkey") == c("sha")).select(
        F.lit(0).alias("repo"), "sha", "pos", (c("l_partkey") % 400).alias("path"),
        (c("l_linenumber") * 1000000 + c("l_partkey") * 10 + c("l_suppkey") % 10).alias("hunk"),
        (c("l_linenumber") * 10).alias("old_start"), (c("l_quantity").cast("long") % 8 + 1).alias("old_count"),
        c("l_suppkey").alias("supp"), "is_fix",
    ), "hunks")
    sizes = t.lineitem.groupBy(c("l_orderkey").alias("sha")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(c("l_quantity").cast("long")).alias("n_lines"))
    fixes = hunks.where("is_fix").select("repo", "sha").distinct().join(sizes, "sha").select("repo", "sha", "n_files", "n_lines")
    text = lambda at, more: F.concat(F.lit("L"), (at * 7 + c("path") + more) % 4)
    added = hunks.where("is_fix").select(
        "repo", "sha", "path", "hunk", F.explode(F.sequence(c("old_start"), c("old_start") + 2)).alias("at")
    ).withColumn("text", text(c("at"), 0))

    def parent(wanted):
        """The lines of the files before the change, made only for those that are asked for."""
        return hunks.join(wanted, ["repo", "sha", "path"], "left_semi").select(
            "repo", "sha", "path", "supp", F.explode(F.sequence(c("old_start"), c("old_start") + 9)).alias("line_no")
        ).withColumn("text", text(c("line_no"), c("supp") % 3))

    positive = t.orders.where(c("o_orderkey") % 10 == 0).select(F.lit(0).alias("repo"), c("o_orderkey").alias("sha"))
    return hunks, fixes, added, parent, positive


@query("line_overlap_attribution", f"WITH {OVERLAP_SQL} SELECT 0 AS repo, sha, path, arg_min(fix, fp) AS cause FROM good GROUP BY sha, path")
def line_overlap_attribution(t):
    return B.line_overlap_attribution(*hunk_tables(t), repo=REPO)


MERGE_SQL = f"""{CHANGES_SQL}, amb AS (SELECT DISTINCT c.repo, c.pos FROM changes c JOIN fixes f ON f.repo = c.repo AND f.path = c.path AND f.pos BETWEEN c.pos + 1 AND c.pos + 20
   WHERE f.doc - c.doc < 91),
labels_ AS (SELECT c.repo, c.sha, c.path, CASE WHEN e.cause IS NOT NULL THEN 'explicit_sha_reference' WHEN r.cause IS NOT NULL THEN 'revert'
   WHEN n_chars % 11 = 0 THEN 'line_overlap' WHEN a.pos IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS label_source, coalesce(e.cause, r.cause, CASE WHEN n_chars % 11 = 0 THEN 'fix' END) AS cause
 FROM changes c LEFT JOIN explicit e ON e.repo = c.repo AND e.sha = c.sha LEFT JOIN by_revert r ON r.repo = c.repo AND r.sha = c.sha
 LEFT JOIN amb a ON a.repo = c.repo AND a.pos = c.pos)"""


def labelled(t):
    c = reused(changes(t))
    explicit = B.explicit_attribution(c, REPO)
    reverted = B.revert_attribution(c, REPO, explicit)
    overlap = c.where(F.col("n_chars") % 11 == 0).select("repo", "sha", "path", F.lit("fix").alias("cause"))
    active = c.withColumn("is_fix", F.col("is_fix") & (F.col("n_files") <= B.EXCLUDE_FILES))
    timed = c.select("repo", "pos", F.timestamp_seconds(F.col("doc") * 86400).alias("ts"))
    amb = B.ambiguous_evidence(active.select("repo", "pos", "path", "is_fix"), timed, REPO, window=20)
    return B.merge_labels(c, c, REPO, explicit, reverted, overlap, amb)


@query("merge_labels", f"""WITH {MERGE_SQL} SELECT repo, sha, path, label_source, CASE label_source WHEN 'none' THEN 'negative' WHEN 'ambiguous' THEN 'ambiguous' ELSE 'positive' END AS label_status,
  CASE label_source WHEN 'none' THEN 0 WHEN 'ambiguous' THEN -1 ELSE 1 END AS defect_label,
  CASE label_source WHEN 'explicit_sha_reference' THEN 1.0 WHEN 'revert' THEN 1.0 WHEN 'line_overlap' THEN 0.7 ELSE 0 END AS label_confidence, cause FROM labels_""")
def merge_labels(t):
    return labelled(t)


SPLIT_CASE = """CASE WHEN i < CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN i < CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'validation' ELSE 'test' END AS split"""
ORDER_REPO_SQL = """oc AS (SELECT o_orderkey AS sha, o_orderdate AS ts, c_nationkey AS repo FROM orders JOIN customer ON o_custkey = c_custkey)"""


def order_changes(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), F.col("c_nationkey").alias("repo")
    )


@query("chrono_split", f"""WITH {ORDER_REPO_SQL} SELECT repo, sha, {SPLIT_CASE} FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts, sha) - 1 AS i,
  (count(*) OVER (PARTITION BY repo))::DOUBLE AS n FROM oc)""")
def chrono_split(t):
    return B.chrono_split(order_changes(t), ["ts", "sha"], ["repo"]).select("repo", "sha", "split")


GLOBAL_SPLIT_SQL = f"""{ORDER_REPO_SQL}, gs AS (SELECT repo, sha, ts, {SPLIT_CASE} FROM (SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, repo, sha) - 1 AS i,
  (count(*) OVER ())::DOUBLE AS n FROM (SELECT repo, sha, CASE WHEN sha % 50 <> 0 THEN ts END AS ts FROM oc)))"""


def global_split(t):
    rows = order_changes(t).withColumn("ts", F.when(F.col("sha") % 50 != 0, F.col("ts")))
    return B.global_chrono_split(rows, "ts", "repo", "sha")


@query("global_chrono_split", f"WITH {GLOBAL_SPLIT_SQL} SELECT repo, sha, split FROM gs")
def global_chrono_split(t):
    return global_split(t).select("repo", "sha", "split")


@query("split_by_lookup", f"""WITH {ORDER_REPO_SQL} SELECT repo, sha, CASE n_regionkey WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split
  FROM oc JOIN nation ON repo = n_nationkey""")
def split_by_lookup(t):
    r = F.col("n_regionkey")
    manifest = t.nation.select(
        F.col("n_nationkey").alias("repo"), F.when(r == 0, "test").when(r == 1, "validation").otherwise("train").alias("split")
    )
    return B.split_by_lookup(order_changes(t), manifest, "repo").select("repo", "sha", "split")
