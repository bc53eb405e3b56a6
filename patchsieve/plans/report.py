"""The attribution report on contents: conversations are changes, pairs of turns their files.

Turn 2j of conversation c is what change c adds to file j, turn 2j + 1 what stands below it afterwards. A
file starts from what the change before left: file 0 is set back to the state before that change, file 1
loses what that change added, the others keep it. Conversation c + 1 corrects conversation c.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.operators import attribution as A
from patchsieve.operators import report as R
from patchsieve.operators.frames import reused
from patchsieve.plans.registry import query

VECTOR_SIZE = 64


def _sha(number):
    return F.sha1(number.cast("string").cast("binary"))


def report_files(t):
    """One row per file of a change: texts of both sides, names, and what its diff and its functions are read off."""
    c = F.col
    turns = t.conversations.select(c("conv_id").cast("long").alias("c"), F.floor(c("turn") / 2).alias("j"), (c("turn") % 2).alias("odd"), "text")
    # both turns of a file in one row, then the rows of the two changes before
    own = turns.groupBy("c", "j").agg(F.max(F.when(c("odd") == 0, c("text"))).alias("own"), F.max(F.when(c("odd") == 1, c("text"))).alias("nxt")).where("own IS NOT NULL")
    own = reused(own)
    before = own.select((c("c") + 1).alias("c"), "j", c("own").alias("p_own"), c("nxt").alias("p_nxt"))
    earlier = own.select((c("c") + 2).alias("c"), "j", c("nxt").alias("q_nxt"))
    name = F.concat(F.lit("f"), c("j"), F.lit(".py"))
    path = F.when(c("c") % 7 == 3, F.concat(F.lit("moved/"), name)).when(c("c") % 7 == 5, F.concat(F.lit("lib/g"), c("j"), F.lit(".py"))).otherwise(F.concat(F.lit("src/"), name))
    old = F.when(c("c") % 7 == 5, F.concat(F.lit("src/"), name)).when(c("c") % 7 == 4, name).otherwise("")
    after = (
        F.when((c("j") == 0) & c("p_own").isNotNull(), F.concat_ws("\n", "q_nxt", "p_own")).when(c("nxt").isNull(), F.lit(None))
        .when(c("j") == 1, F.concat_ws("\n", "own", "nxt")).otherwise(F.concat_ws("\n", "p_nxt", "own", "nxt"))
    )
    return own.join(before, ["c", "j"], "left").join(earlier, ["c", "j"], "left").select(
        "c", _sha(c("c")).alias("sha"), c("j").alias("seq"), path.alias("path"), old.alias("old_path"),
        F.when(old != "", "renamed").when(c("nxt").isNull(), "deleted").otherwise("modified").alias("status"), (c("j") == 2).cast("double").alias("test_flag"),
        F.concat_ws("\n", "p_nxt", "own").alias("before"), after.alias("after"),
        F.length("own").alias("a"), F.coalesce(F.length("nxt"), F.lit(0)).alias("b"),
    )


def report_links(t, files):
    """Evidence texts name the next change by a prefix, name one that does not exist, or name none."""
    c, kind = F.col, F.col("c") % 6
    named = F.when(kind % 2 == 0, F.concat(F.lit("bug-fix "), F.substring(_sha(c("c") + 1), 1, 12))).otherwise(F.concat(F.lit("reverted by "), F.substring(_sha(c("c") + 1), 1, 10)))
    changes = files.select("c", "sha").distinct()
    positives = changes.select(
        "sha", F.when(kind == 5, "line_overlap").when(kind % 2 == 0, "explicit_sha_reference").otherwise("revert").alias("label_source"),
        F.when(kind == 5, "changed lines").when(kind == 4, "bug-fix 00000000ffff").otherwise(named).alias("label_evidence"))
    return R.corrective_links(positives, changes)


def listed_files(files):
    return files.where("NOT (c % 11 = 4 AND seq = 1)")


def hunks_of(files):
    spans = F.array(F.struct((1 + F.col("a") % 10).alias("new_start"), (F.col("b") % 6).alias("new_count")),
                    F.struct((8 + F.col("a") % 10).alias("new_start"), (1 + F.col("a") % 4).alias("new_count")))
    return files.select("sha", "path", F.explode(spans).alias("h")).select("sha", "path", "h.*")


def functions_of(files):
    ranges = F.array(F.struct(F.concat(F.lit("fn"), F.col("a") % 3).alias("name"), F.lit(1).alias("start"), (1 + F.col("a") % 3).alias("end")),
                     F.struct(F.concat(F.lit("fm"), F.col("b") % 2).alias("name"), F.lit(2).alias("start"), F.lit(4).alias("end")))
    return files.select("sha", "path", F.explode(ranges).alias("f")).select("sha", "path", "f.*")


FILES_OF_SQL = r"""f0 AS MATERIALIZED (
  SELECT a.conv_id AS c, a.turn // 2 AS j, a.text AS own, b.text AS nxt FROM conversations a
  LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0 AND a.text IS NOT NULL
), fc AS MATERIALIZED (
  SELECT f0.c, sha1(f0.c::VARCHAR) AS sha, f0.j AS seq,
    CASE f0.c % 7 WHEN 3 THEN 'moved/f' || f0.j || '.py' WHEN 5 THEN 'lib/g' || f0.j || '.py' ELSE 'src/f' || f0.j || '.py' END AS path,
    CASE f0.c % 7 WHEN 5 THEN 'src/f' || f0.j || '.py' WHEN 4 THEN 'f' || f0.j || '.py' ELSE '' END AS old_path,
    CASE WHEN f0.c % 7 IN (4, 5) THEN 'renamed' WHEN f0.nxt IS NULL THEN 'deleted' ELSE 'modified' END AS status, (f0.j = 2)::INT AS test_flag,
    concat_ws(chr(10), p.nxt, f0.own) AS before,
    CASE WHEN f0.j = 0 AND p.own IS NOT NULL THEN concat_ws(chr(10), q.nxt, p.own) WHEN f0.nxt IS NULL THEN NULL
      WHEN f0.j = 1 THEN concat_ws(chr(10), f0.own, f0.nxt) ELSE concat_ws(chr(10), p.nxt, f0.own, f0.nxt) END AS after,
    length(f0.own) AS a, coalesce(length(f0.nxt), 0) AS b
  FROM f0 LEFT JOIN f0 p ON p.c = f0.c - 1 AND p.j = f0.j LEFT JOIN f0 q ON q.c = f0.c - 2 AND q.j = f0.j
), listed AS (SELECT * FROM fc WHERE NOT (c % 11 = 4 AND seq = 1)),
positives AS (
  SELECT DISTINCT sha, CASE WHEN c % 6 = 5 THEN 'line_overlap' WHEN c % 2 = 0 THEN 'explicit_sha_reference' ELSE 'revert' END AS label_source,
    CASE WHEN c % 6 = 5 THEN NULL WHEN c % 6 = 4 THEN '00000000ffff' WHEN c % 2 = 0 THEN substr(sha1((c + 1)::VARCHAR), 1, 12) ELSE substr(sha1((c + 1)::VARCHAR), 1, 10) END AS prefix FROM fc
), links AS MATERIALIZED (
  SELECT p.sha, p.prefix, any_value(k.sha) AS corrective, p.label_source FROM positives p
  LEFT JOIN (SELECT DISTINCT sha FROM fc) k ON starts_with(k.sha, p.prefix) GROUP BY p.sha, p.prefix, p.label_source HAVING count(k.sha) <= 1
)"""

REPORT_FILES_SQL = FILES_OF_SQL + r""", hits AS (
  SELECT m.sha, m.path, 1 AS rule, f.seq, f.path AS target FROM links l JOIN fc m USING (sha) JOIN fc f ON f.sha = l.corrective AND f.path = m.path
  UNION ALL SELECT m.sha, m.path, 2, f.seq, f.path FROM links l JOIN fc m USING (sha) JOIN fc f ON f.sha = l.corrective AND f.old_path <> '' AND ends_with(m.path, f.old_path)
  UNION ALL SELECT m.sha, m.path, 3, f.seq, f.path FROM links l JOIN fc m USING (sha) JOIN fc f ON f.sha = l.corrective AND f.path <> m.path AND string_split(f.path, '/')[-1] = string_split(m.path, '/')[-1]
), best AS (SELECT sha, path, arg_min(rule, (rule, seq)) AS rule, arg_min(target, (rule, seq)) AS target FROM hits GROUP BY ALL),
known AS MATERIALIZED (
  SELECT l.sha, l.corrective, m.path, CASE rule WHEN 1 THEN 'exact_path' WHEN 2 THEN 'git_rename' WHEN 3 THEN 'path_transform' ELSE 'none' END AS method, target,
    EXISTS (SELECT 1 FROM listed r WHERE r.sha = l.corrective AND r.path = target) AS listed
  FROM links l JOIN listed m USING (sha) LEFT JOIN best b ON b.sha = m.sha AND b.path = m.path
), texts AS (SELECT sha, path, a, b,
  [regexp_replace(x, '\s+$', '') for x in string_split(before, chr(10))] AS was, [regexp_replace(x, '\s+$', '') for x in string_split(after, chr(10))] AS now FROM fc
), pairs AS MATERIALIZED (
  SELECT k.sha, k.path, x.was AS c_was, x.now AS c_now, y.was AS r_was, y.now AS r_now, x.a AS ca, x.b AS cb, y.a AS ra, y.b AS rb,
    coalesce(list_sort(list_filter(list_distinct(x.now), lambda z: NOT list_contains(x.was, z))), []) AS introduced,
    CASE WHEN y.now IS NULL THEN [] ELSE list_sort(list_filter(list_distinct(y.was), lambda z: NOT list_contains(y.now, z))) END AS removed
  FROM known k JOIN texts x ON x.sha = k.sha AND x.path = k.path JOIN texts y ON y.sha = k.corrective AND y.path = k.target WHERE listed
), loose AS MATERIALIZED (
  SELECT sha, path, [list_distinct(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) for x in list_sort(list_filter(introduced, lambda z: NOT list_contains(removed, z)))] AS l,
    [list_distinct(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) for x in list_sort(list_filter(removed, lambda z: NOT list_contains(introduced, z)))] AS r FROM pairs
), greedy AS (
  SELECT sha, path, l, r, 0 AS i, []::BIGINT[] AS used FROM loose
  UNION ALL
  SELECT sha, path, l, r, i + 1, CASE WHEN best[1] > 0.3 THEN list_append(used, -best[2]::BIGINT) ELSE used END FROM (
    SELECT *, list_max([CASE WHEN list_contains(used, n) OR len(l[i + 1]) = 0 OR len(r[n]) = 0 THEN [0.0, -n]
      ELSE [(len(list_intersect(l[i + 1], r[n])) / len(list_distinct(list_concat(l[i + 1], r[n]))))::DOUBLE, -n] END for n in range(1, len(r) + 1)]) AS best
    FROM greedy WHERE i < len(l))
), partial AS (SELECT sha, path, len(used) AS partial_match_count FROM greedy WHERE i = len(l)),
lines AS (
  SELECT sha, path, ours, unnest(range(s, s + n)) AS line FROM (
    SELECT sha, path, true AS ours, 1 + ca % 10 AS s, cb % 6 AS n FROM pairs UNION ALL SELECT sha, path, true, 8 + ca % 10, 1 + ca % 4 FROM pairs
    UNION ALL SELECT sha, path, false, 1 + ra % 10, rb % 6 FROM pairs UNION ALL SELECT sha, path, false, 8 + ra % 10, 1 + ra % 4 FROM pairs)
), region AS (
  SELECT sha, path, count(*) AS overlap_lines, min(line) AS overlap_start, max(line) AS overlap_end FROM (
    SELECT sha, path, line FROM lines GROUP BY ALL HAVING bool_or(ours) AND bool_or(NOT ours)) GROUP BY ALL
), fns AS (
  SELECT sha, path, ours, name, len(list_intersect(list_slice(now, s, least(e, len(now))), wanted)) > 0 AS hit FROM (
    SELECT sha, path, true AS ours, 'fn' || ca % 3 AS name, 1 AS s, 1 + ca % 3 AS e, c_now AS now, introduced AS wanted FROM pairs
    UNION ALL SELECT sha, path, true, 'fm' || cb % 2, 2, 4, c_now, introduced FROM pairs
    UNION ALL SELECT sha, path, false, 'fn' || ra % 3, 1, 1 + ra % 3, r_now, removed FROM pairs
    UNION ALL SELECT sha, path, false, 'fm' || rb % 2, 2, 4, r_now, removed FROM pairs) WHERE now IS NOT NULL
), names AS (
  SELECT sha, path, name, bool_or(hit) FILTER (ours) AS c_hit, bool_or(hit) FILTER (NOT ours) AS r_hit FROM fns GROUP BY ALL HAVING bool_or(ours) AND bool_or(NOT ours)
), same AS (
  SELECT sha, path, coalesce(min(name) FILTER (c_hit AND r_hit), min(name)) AS function_name,
    coalesce(bool_or(c_hit AND r_hit), false) OR arg_min(c_hit, name) AS structural FROM names GROUP BY ALL
), facts AS (
  SELECT p.sha, p.path, len(list_intersect(introduced, removed)) AS exact_match_count, partial_match_count, greatest(len(introduced), len(removed), 1) AS most,
    coalesce(c_was = r_now, false) AS restored, coalesce(overlap_lines, 0) AS overlap_lines, overlap_start, overlap_end, function_name, coalesce(structural, false) AS structural,
    CASE WHEN c_was IS NULL OR r_now IS NULL THEN -1 ELSE greatest(len(c_was), len(r_now)) - len(list_filter(list_zip(c_was, r_now), lambda z: z[1] = z[2])) END AS line_diff_count,
    CASE WHEN c_was IS NULL OR r_now IS NULL THEN 0 ELSE round(len(list_filter(list_zip(c_was, r_now), lambda z: z[1] = z[2])) / greatest(len(c_was), len(r_now)), 4) END AS similarity_ratio
  FROM pairs p JOIN partial USING (sha, path) LEFT JOIN region USING (sha, path) LEFT JOIN same USING (sha, path)
), report AS MATERIALIZED (
  SELECT k.sha, k.path, k.corrective, method, target AS corrective_path, listed, exact_match_count, partial_match_count,
    round(exact_match_count / most, 4) AS exact_match_ratio, round((exact_match_count + partial_match_count) / most, 4) AS partial_match_ratio,
    CASE WHEN exact_match_count > 0 THEN 'exact_removal' WHEN partial_match_count > 0 THEN 'partial_overlap' WHEN most IS NOT NULL THEN 'none' END AS correspondence_type,
    coalesce(restored, false) AS restored, line_diff_count, similarity_ratio, overlap_lines, overlap_start, overlap_end, function_name,
    CASE WHEN NOT listed THEN 'UNKNOWN' WHEN restored OR exact_match_count > 0 THEN 'FILE_STRONG' ELSE 'FILE_WEAK' END AS level,
    list_filter([CASE WHEN restored THEN 'CONTENT_RESTORATION' END, CASE WHEN exact_match_count > 0 THEN 'EXACT_CANDIDATE_CONTENT_REMOVAL' END,
      CASE WHEN overlap_lines > 0 THEN 'SAME_REGION_OVERLAP' END,
      CASE WHEN structural THEN 'SAME_FUNCTION_CANDIDATE_CONTENT' WHEN function_name IS NOT NULL THEN 'SAME_FUNCTION_ONLY' END], lambda x: x IS NOT NULL) AS types,
    CASE WHEN method = 'none' THEN 'File identity not established' WHEN NOT listed THEN 'File ' || k.path || ' not in corrective commit ' || k.corrective || ' file list'
      WHEN restored THEN 'Corrective restored parent-of-C content (exact)' WHEN exact_match_count > 0 THEN 'Exact candidate-content removal: ' || exact_match_count || ' lines matched'
      ELSE 'Path overlap or file association only' END AS rationale
  FROM known k LEFT JOIN facts USING (sha, path)
)"""


def contents_report(t):
    files = reused(report_files(t))
    return R.file_report(report_links(t, files), files, listed_files(files), files, hunks_of(files), functions_of(files))


FILE_COLUMNS = ["sha", "path", "corrective", "method", "corrective_path", "listed", "exact_match_count", "partial_match_count", "exact_match_ratio", "partial_match_ratio",
                "correspondence_type", "restored", "line_diff_count", "similarity_ratio", "overlap_lines", "overlap_start", "overlap_end", "function_name", "level", "rationale"]


@query("attribution_report_files", f"WITH RECURSIVE {REPORT_FILES_SQL} SELECT {', '.join(FILE_COLUMNS)}, array_to_string(types, ',') AS types FROM report")
def attribution_report_files(t):
    return contents_report(t).select(*FILE_COLUMNS, F.array_join("evidence_types", ",").alias("types"))


@query("attribution_report_levels", f"WITH RECURSIVE {REPORT_FILES_SQL} SELECT method, listed, level, count(*) AS n FROM report GROUP BY ALL")
def attribution_report_levels(t):
    return contents_report(t).groupBy("method", "listed", "level").agg(F.count(F.lit(1)).alias("n"))


@query("attribution_report_types", f"WITH RECURSIVE {REPORT_FILES_SQL} SELECT evidence_type, count(*) AS n FROM (SELECT unnest(types) AS evidence_type FROM report) GROUP BY 1")
def attribution_report_types(t):
    return A.type_distribution(contents_report(t))


@query("attribution_report_units", f"""WITH RECURSIVE {REPORT_FILES_SQL} SELECT count(DISTINCT sha) AS commits, count(*) AS files, count(*) FILTER (level = 'FILE_STRONG') AS file_strong,
 count(*) FILTER (level = 'FILE_MODERATE') AS file_moderate, count(*) FILTER (level = 'FILE_WEAK') AS file_weak, count(*) FILTER (level = 'UNKNOWN') AS file_unknown,
 count(*) FILTER (function_name IS NOT NULL) AS same_function FROM report""")
def attribution_report_units(t):
    return A.prediction_units(contents_report(t))


REPORT_CHANGES_SQL = FILES_OF_SQL + """, mine AS (SELECT l.sha, m.path, EXISTS (SELECT 1 FROM listed r WHERE r.sha = l.corrective AND r.path = m.path) AS shared FROM links l JOIN listed m USING (sha)),
sizes AS (SELECT sha, count(*) AS n, count(*) FILTER (test_flag > 0.5) AS tests FROM listed GROUP BY sha),
overlap AS (SELECT l.*, count(*) AS candidate_files, any_value(coalesce(s.n, 0)) AS corrective_files, count(*) FILTER (shared) AS overlap_files
  FROM links l JOIN mine USING (sha) LEFT JOIN sizes s ON s.sha = l.corrective GROUP BY ALL),
st AS (SELECT sha, list_distinct(list(status)) AS kinds FROM listed GROUP BY sha),
mv AS (SELECT c, sha1(c::VARCHAR) AS sha, i, avg(x) AS x FROM (SELECT vec_id // 5 AS c, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY c, i),
near AS (SELECT l.sha, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS cosine, sqrt(sum((a.x - b.x) ** 2)) AS distance
  FROM links l JOIN mv a ON a.sha = l.sha JOIN mv b ON b.sha = l.corrective AND b.i = a.i GROUP BY l.sha)
SELECT o.sha, o.prefix, o.corrective, o.label_source, candidate_files, corrective_files, overlap_files,
  CASE WHEN corrective_files = 0 THEN 'NO_ATTRIBUTION' WHEN overlap_files > 0 AND overlap_files < candidate_files THEN 'FILE_PARTIAL' ELSE 'COMMIT_ONLY' END AS category,
  CASE WHEN o.corrective IS NOT NULL THEN 'COMMIT_STRONG' WHEN o.prefix IS NOT NULL THEN 'COMMIT_WEAK' ELSE 'COMMIT_NONE' END AS commit_evidence_level,
  CASE WHEN overlap_files > 0 THEN 'FILE_WEAK' ELSE 'UNKNOWN' END AS file_evidence_level,
  (o.prefix IS NOT NULL)::INT + (l2.prefix IS NOT NULL)::INT + (l3.prefix IS NOT NULL)::INT AS chain_depth,
  CASE WHEN l3.prefix IS NOT NULL THEN l3.corrective WHEN l2.prefix IS NOT NULL THEN l2.corrective WHEN o.prefix IS NOT NULL THEN o.corrective END AS chain_end,
  chain_end IS NOT NULL AS chain_terminates,
  array_to_string(list_sort(list_filter(['added', 'deleted', 'renamed', 'modified'], lambda s: list_contains(st.kinds, s) AND list_contains(coalesce(sc.kinds, []), s))), ',') AS status_overlap,
  round(cosine, 6) AS cosine_similarity, round(distance, 6) AS euclidean_distance, tests AS test_count, sizes.n - tests AS prod_count,
  tests > 0 AND tests < sizes.n AS has_both,
  CASE WHEN corrective_files > 0 THEN round(overlap_files / corrective_files, 4) END AS overlap_ratio,
  CASE WHEN corrective_files > 0 THEN round(overlap_files / candidate_files, 4) END AS narrowing_ratio
FROM overlap o LEFT JOIN links l2 ON o.prefix IS NOT NULL AND l2.sha = o.corrective AND l2.sha <> o.sha LEFT JOIN links l3 ON l2.prefix IS NOT NULL AND l3.sha = l2.corrective AND l3.sha NOT IN (o.sha, l2.sha)
JOIN st ON st.sha = o.sha LEFT JOIN st sc ON sc.sha = o.corrective LEFT JOIN near ON near.sha = o.sha JOIN sizes ON sizes.sha = o.sha"""


def changes_report(t):
    files = reused(report_files(t))
    vectors = t.embeddings.select(_sha(F.floor(F.col("vec_id") / 5)).alias("sha"), F.col("embedding").cast("array<double>").alias("vector"))
    return R.change_report(reused(report_links(t, files)), listed_files(files), vectors, VECTOR_SIZE)


@query("attribution_report_changes", f"WITH {REPORT_CHANGES_SQL}")
def attribution_report_changes(t):
    return changes_report(t).drop("added_in_both", "deleted_in_both", "renamed_in_both")


@query("attribution_report_nested", f"""WITH RECURSIVE {REPORT_FILES_SQL}
SELECT l.sha, l.label_source, l.corrective, count(*) AS files, coalesce(string_agg(path || ':' || level, ',' ORDER BY path), '') AS levels,
  coalesce(string_agg(path, ',' ORDER BY path) FILTER (level = 'UNKNOWN'), '') AS unknown_files
FROM links l JOIN report r ON r.sha = l.sha GROUP BY ALL""")
def attribution_report_nested(t):
    """The report of a change as one nested row, shown by the levels of its files."""
    out = R.nested_report(changes_report(t), contents_report(t))
    levels = F.transform("file_results", lambda f: F.concat_ws(":", f["path"], f["level"]))
    return out.select("sha", "label_source", "corrective", F.size("file_results").cast("long").alias("files"), F.array_join(levels, ",").alias("levels"), F.array_join("unknown_files", ",").alias("unknown_files"))
