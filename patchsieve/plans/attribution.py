"""Attribution queries: order k is corrected by order k + 1, parts give the paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.operators import attribution as A
from patchsieve.operators.frames import beside, number_rows
from patchsieve.plans.registry import query, rounded


def linked_files(t):
    c = F.col
    status = c("l_suppkey") % 5
    path = F.concat(F.lit("dir"), c("l_partkey") % 3, F.lit("/f"), c("l_partkey") % 30, F.lit(".py"))
    return t.lineitem.select(
        c("l_orderkey").alias("sha"), path.alias("path"),
        (c("l_linenumber").cast("long") * 1_000_000_000 + c("l_partkey") * 10_000 + c("l_suppkey") % 10_000).alias("seq"),
        F.when(status == 0, "added").when(status == 1, "deleted").when(status == 2, "renamed").otherwise("modified").alias("status"),
        F.when(status == 2, F.concat(F.lit("f"), c("l_partkey") % 30, F.lit(".py")))
        .when(status == 3, path).otherwise("").alias("old_path"),
        (c("l_returnflag") == "R").alias("positive"), (c("l_discount") * 10).alias("test_flag"),
        c("l_quantity").alias("q"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"),
    )


def links(t):
    files = linked_files(t)
    sha = F.col("sha")
    nxt = files.select(F.col("sha").alias("next")).distinct()
    some = files.where("positive").select("sha").distinct().withColumn("want", F.when(sha % 5 < 3, sha + 1))
    return some.join(nxt, F.col("want") == F.col("next"), "left").select(
        "sha", F.when(sha % 5 != 4, (sha + 1).cast("string")).alias("prefix"), F.col("next").alias("corrective"),
        F.when(sha % 2 == 0, "revert").when(sha % 3 == 0, "explicit_sha_reference").otherwise("line_overlap").alias("label_source"),
    )


LINKS_SQL = """files AS (SELECT l_orderkey AS sha, 'dir' || l_partkey % 3 || '/f' || l_partkey % 30 || '.py' AS path,
  l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 AS seq,
  CASE l_suppkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status,
  CASE l_suppkey % 5 WHEN 2 THEN 'f' || l_partkey % 30 || '.py' WHEN 3 THEN 'dir' || l_partkey % 3 || '/f' || l_partkey % 30 || '.py' ELSE '' END AS old_path,
  l_returnflag = 'R' AS positive, l_discount * 10 AS test_flag, l_quantity AS q, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp FROM lineitem),
shas AS (SELECT DISTINCT sha FROM files),
links AS (SELECT p.sha, CASE WHEN p.sha % 5 <> 4 THEN (p.sha + 1)::VARCHAR END AS prefix, n.sha AS corrective,
  CASE WHEN p.sha % 2 = 0 THEN 'revert' WHEN p.sha % 3 = 0 THEN 'explicit_sha_reference' ELSE 'line_overlap' END AS label_source
  FROM (SELECT DISTINCT sha FROM files WHERE positive) p LEFT JOIN shas n ON n.sha = p.sha + 1 AND p.sha % 5 < 3),
paths AS (SELECT DISTINCT sha, path FROM files),
cand AS (SELECT l.sha, l.corrective, p.path, EXISTS (SELECT 1 FROM paths q WHERE q.sha = l.corrective AND q.path = p.path) AS shared FROM links l JOIN paths p ON p.sha = l.sha),
ctrl AS (SELECT l.sha, l.corrective, p.path FROM links l JOIN paths p ON p.sha = l.corrective),
overlap AS (SELECT l.*, candidate_files, coalesce(corrective_files, 0) AS corrective_files, overlap_files, candidate_files - overlap_files AS unknown_files,
  CASE WHEN coalesce(corrective_files, 0) = 0 THEN 'NO_ATTRIBUTION' WHEN overlap_files > 0 AND overlap_files < candidate_files THEN 'FILE_PARTIAL' ELSE 'COMMIT_ONLY' END AS category
  FROM links l JOIN (SELECT sha, count(*) AS candidate_files, count(*) FILTER (shared) AS overlap_files FROM cand GROUP BY sha) USING (sha)
  LEFT JOIN (SELECT sha, count(*) AS corrective_files FROM ctrl GROUP BY sha) USING (sha))"""


@query("path_overlap_category", f"""WITH {LINKS_SQL} SELECT sha, prefix, corrective, candidate_files, corrective_files, overlap_files, unknown_files, category FROM overlap""")
def path_overlap_category(t):
    return A.path_overlap(links(t), linked_files(t))


@query("path_overlap_category_later", f"""WITH {LINKS_SQL} SELECT CASE category WHEN 'NO_ATTRIBUTION' THEN 'COMMIT_ONLY' ELSE category END AS category, count(*) AS n FROM overlap GROUP BY 1""")
def path_overlap_category_later(t):
    out = A.path_overlap(links(t), linked_files(t), missing=A.COMMIT_ONLY)
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("path_overlap_files", f"WITH {LINKS_SQL} SELECT sha, path, shared FROM cand")
def path_overlap_files(t):
    return A.candidate_paths(links(t), linked_files(t)).select("sha", "path", "shared")


@query("candidate_negatives", f"""WITH {LINKS_SQL} SELECT sha, path, 'unaffected_in_corrective' AS strategy, 'CANDIDATE_NEGATIVE' AS status FROM ctrl c
  WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.sha = c.sha AND p.path = c.path)""")
def candidate_negatives(t):
    return A.candidate_negatives(links(t), linked_files(t))


@query("corrective_controls", f"WITH {LINKS_SQL} SELECT sha, corrective, path FROM ctrl")
def corrective_controls(t):
    return A.corrective_controls(links(t), linked_files(t)).select("sha", "corrective", "path")


def _spread(files):
    """The same names in other folders for odd suppliers."""
    return files.withColumn(
        "path", F.when(F.col("supp") % 2 == 1, F.concat(F.lit("moved/"), F.element_at(F.split("path", "/"), -1))).otherwise(F.col("path"))
    )


SPREAD_SQL = LINKS_SQL.replace(
    "paths AS (SELECT DISTINCT sha, path FROM files)",
    "sfiles AS (SELECT * REPLACE (CASE WHEN supp % 2 = 1 THEN 'moved/' || string_split(path, '/')[-1] ELSE path END AS path) FROM files),\n"
    "paths AS (SELECT DISTINCT sha, path FROM sfiles)")


@query("path_transforms", f"""WITH {SPREAD_SQL}, last AS (SELECT sha, string_split(path, '/')[-1] AS name, max(path) AS candidate_path FROM paths GROUP BY 1, 2)
SELECT c.sha, c.corrective, name, candidate_path, c.path AS corrective_path FROM ctrl c JOIN last l ON l.sha = c.sha AND l.name = string_split(c.path, '/')[-1] WHERE candidate_path <> c.path""")
def path_transforms(t):
    return A.path_transforms(links(t), _spread(linked_files(t)))


IDENTITY_SQL = f"""{SPREAD_SQL}, cf AS (SELECT l.sha, l.corrective, f.path, max(f.seq) AS seq FROM links l JOIN sfiles f ON f.sha = l.sha WHERE l.corrective IS NOT NULL GROUP BY ALL),
named AS (SELECT sha, corrective, string_split(path, '/')[-1] AS name, arg_max(path, seq) AS path FROM cf GROUP BY ALL),
hits AS (SELECT c.sha, c.path, 1 AS rule, f.seq, f.path AS target FROM cf c JOIN sfiles f ON f.sha = c.corrective AND f.path = c.path
  UNION ALL SELECT c.sha, c.path, 2, f.seq, f.path FROM cf c JOIN sfiles f ON f.sha = c.corrective AND f.old_path <> '' AND (f.old_path = c.path OR ends_with(c.path, f.old_path))
  UNION ALL SELECT n.sha, n.path, 3, f.seq, f.path FROM named n JOIN sfiles f ON f.sha = n.corrective AND string_split(f.path, '/')[-1] = n.name AND f.path <> n.path),
best AS (SELECT sha, path, arg_min(rule, (rule, seq)) AS rule, arg_min(target, (rule, seq)) AS target FROM hits GROUP BY ALL),
identity AS (SELECT l.sha, p.path, CASE rule WHEN 1 THEN 'exact_path' WHEN 2 THEN 'git_rename' WHEN 3 THEN 'path_transform' ELSE 'none' END AS method, target AS corrective_path
  FROM links l JOIN paths p ON p.sha = l.sha LEFT JOIN best b ON b.sha = l.sha AND b.path = p.path)"""


@query("file_identity", f"WITH {IDENTITY_SQL} SELECT * FROM identity")
def file_identity(t):
    return A.file_identity(links(t), _spread(linked_files(t)))


@query("reference_chain", f"""WITH {LINKS_SQL}, e AS (SELECT sha, prefix, CASE WHEN sha % 7 = 0 THEN sha - 1 ELSE corrective END AS corrective FROM links),
j AS (SELECT a.sha, a.prefix AS p1, a.corrective AS c1, b.sha AS s2, b.corrective AS c2, c.sha AS s3, c.corrective AS c3 FROM e a
  LEFT JOIN e b ON a.prefix IS NOT NULL AND b.sha = a.corrective AND b.sha <> a.sha AND b.prefix IS NOT NULL
  LEFT JOIN e c ON c.sha = b.corrective AND c.sha <> a.sha AND c.sha <> a.corrective AND c.prefix IS NOT NULL)
SELECT sha, (p1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT AS depth,
 CASE WHEN s3 IS NOT NULL THEN c3 WHEN s2 IS NOT NULL THEN c2 WHEN p1 IS NOT NULL THEN c1 END AS final_sha, final_sha IS NOT NULL AS terminates FROM j""")
def reference_chain(t):
    back = F.when(F.col("sha") % 7 == 0, F.col("sha") - 1).otherwise(F.col("corrective"))
    return A.reference_chain(links(t).withColumn("corrective", back))


MENTION_SQL = r"""docs AS (SELECT doc_id // 3 AS sha, doc_id, text, lang || '/' || string_split(text, ' ')[2] || '.x' AS path FROM documents),
msgs AS (SELECT sha, 'Fix ' || arg_min(text, doc_id) AS message FROM docs GROUP BY sha),
dp AS (SELECT DISTINCT sha, path FROM docs),
named AS (SELECT dp.sha, path, contains(lower(message), lower(string_split(path, '/')[-1])) OR contains(lower(message), lower(regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]+$', '\1', 's')))
  OR len(list_filter(string_split(path, '/'), lambda p: len(p) > 3 AND contains(lower(message), lower(p)))) > 0 AS named FROM dp JOIN msgs USING (sha)),
counts AS (SELECT sha, count(*) AS files, count(*) FILTER (named) AS matched FROM named GROUP BY sha),
mentions AS (SELECT sha, files, matched, CASE WHEN matched = files AND matched > 0 THEN 'all_files_mentioned' WHEN matched > 0 THEN 'partial_files_mentioned' ELSE 'none' END AS signal_level FROM counts)"""


# every text of the three documents is part of the message
MENTION_WHOLE_SQL = MENTION_SQL.replace("'Fix ' || arg_min(text, doc_id)", "'Fix ' || string_agg(text, chr(10) ORDER BY doc_id)")


def mentions(t, whole=False):
    docs = t.documents.select(
        F.floor(F.col("doc_id") / 3).alias("sha"), "doc_id", "text",
        F.concat(F.col("lang"), F.lit("/"), F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit("")), F.lit(".x")).alias("path"),
    )
    ordered = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("doc_id", "text"))))
    text = F.array_join(F.transform(ordered, lambda d: d["text"]), "\n") if whole else F.min_by("text", "doc_id")
    messages = docs.groupBy("sha").agg(F.concat(F.lit("Fix "), text).alias("message"))
    return A.message_mentions(docs, messages)


@query("message_mentions", f"WITH {MENTION_SQL} SELECT * FROM mentions")
def message_mentions(t):
    return mentions(t).drop("words")


@query("message_mentions_whole", f"WITH {MENTION_WHOLE_SQL} SELECT * FROM mentions")
def message_mentions_whole(t):
    return mentions(t, whole=True).drop("words")


@query("mentioned_words", r"""SELECT doc_id, array_to_string((regexp_extract_all('Fix ' || text, '(?i)(?:^|[^\pL\pN_])(?:fix|patch|resolve|bug|issue|error)[^\pL\pN_\n]+([\pL\pN_]+)', 1))[1:5], ',') AS words FROM documents""")
def mentioned_words(t):
    from patchsieve.functions.messages import mentioned_words as words
    return t.documents.select("doc_id", F.array_join(words(F.concat(F.lit("Fix "), F.col("text"))), ",").alias("words"))


# ---- contents: a turn of a conversation is a file, the next turn its correction ----

TURNS_SQL = r"""turns AS (SELECT conv_id, turn, text, lead(text) OVER w AS after, lead(text, 2) OVER w AS later FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
arr AS (SELECT conv_id, turn, list_distinct([regexp_replace(x, '\s+$', '') for x in string_split(replace(text, '. ', chr(10)), chr(10))]) AS b,
  list_distinct([regexp_replace(x, '\s+$', '') for x in string_split(replace(after, '. ', chr(10)), chr(10))]) AS a,
  list_distinct([regexp_replace(x, '\s+$', '') for x in string_split(replace(later || chr(10) || text, '. ', chr(10)), chr(10))]) AS l FROM turns),
sets AS (SELECT conv_id, turn, CASE WHEN a IS NULL THEN [] ELSE list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) END AS added,
  CASE WHEN a IS NULL THEN [] ELSE list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) END AS gone,
  CASE WHEN a IS NULL OR l IS NULL THEN [] ELSE list_sort(list_filter(a, lambda x: NOT list_contains(l, x))) END AS undone FROM arr)"""


def numbered_turns(t):
    return number_rows(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], [F.col("turn")], "n")


def turn_after(t, k, name):
    """Text of the k-th next turn, to be joined on conversation and number."""
    return numbered_turns(t).select("conv_id", (F.col("n") - k).alias("n"), F.col("text").alias(name))


def turns(t):
    cut = lambda c: F.replace(c, F.lit(". "), F.lit("\n"))
    key = ["conv_id", "n"]
    base = numbered_turns(t).join(turn_after(t, 1, "after"), key, "left").join(turn_after(t, 2, "later"), key, "left")
    return base.select(
        "conv_id", "turn", cut(F.col("text")).alias("before"), cut(F.col("after")).alias("after"),
        cut(F.concat(F.col("later"), F.lit("\n"), F.col("text"))).alias("later"),
    )


def line_sets(t):
    b, a, later = F.col("before"), F.col("after"), F.col("later")
    return turns(t).withColumn("added", A.introduced(b, a)).withColumn("gone", A.removed(b, a)).withColumn(
        "undone", A.removed(a, later)
    )


@query("introduced_removed", f"WITH {TURNS_SQL} SELECT conv_id, turn, array_to_string(added, '|') AS added, array_to_string(gone, '|') AS removed FROM sets")
def introduced_removed(t):
    return line_sets(t).select("conv_id", "turn", F.array_join("added", "|").alias("added"), F.array_join("gone", "|").alias("removed"))


@query("content_correspondence_exact", f"""WITH {TURNS_SQL}, m AS (SELECT conv_id, turn, len(list_intersect(added, undone)) AS n, greatest(len(added), len(undone), 1) AS d FROM sets)
SELECT conv_id, turn, n AS exact_match_count, n > 0 AS correspondence_exists, round(n / d, 4) AS exact_match_ratio FROM m""")
def content_correspondence_exact(t):
    out = A.content_correspondence(line_sets(t), "added", "undone", pair_partially=False)
    return out.select("conv_id", "turn", "exact_match_count", "correspondence_exists", "exact_match_ratio")


# the greedy pass of the line pairs, one line of the left side a step
GREEDY_SQL = r"""loose AS MATERIALIZED (
  SELECT conv_id, turn, added, gone, [list_distinct(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) for x in list_sort(list_filter(added, lambda z: NOT list_contains(gone, z)))] AS l,
    [list_distinct(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) for x in list_sort(list_filter(gone, lambda z: NOT list_contains(added, z)))] AS r FROM sets
), greedy AS (
  SELECT conv_id, turn, l, r, 0 AS i, []::BIGINT[] AS used FROM loose
  UNION ALL
  SELECT conv_id, turn, l, r, i + 1, CASE WHEN best[1] > 0.3 THEN list_append(used, -best[2]::BIGINT) ELSE used END FROM (
    SELECT *, list_max([CASE WHEN list_contains(used, n) OR len(l[i + 1]) = 0 OR len(r[n]) = 0 THEN [0.0, -n]
      ELSE [(len(list_intersect(l[i + 1], r[n])) / len(list_distinct(list_concat(l[i + 1], r[n]))))::DOUBLE, -n] END for n in range(1, len(r) + 1)]) AS best
    FROM greedy WHERE i < len(l))
)"""


@query("content_correspondence_shared", f"""WITH RECURSIVE {TURNS_SQL.replace("sets AS (", "sets0 AS (")},
sets AS (SELECT conv_id, turn, added, list_sort(list_distinct(list_concat(gone, [regexp_replace(x, '([a-z]+)$', 'else') for x in added], added[1:2]))) AS gone FROM sets0), {GREEDY_SQL},
m AS (SELECT conv_id, turn, len(list_intersect(added, gone)) AS n, len(used) AS p, greatest(len(added), len(gone), 1) AS d FROM loose JOIN (SELECT conv_id, turn, used FROM greedy WHERE i = len(l)) USING (conv_id, turn))
SELECT conv_id, turn, n AS exact_match_count, p AS partial_match_count, CASE WHEN n > 0 THEN 'exact_removal' WHEN p > 0 THEN 'partial_overlap' ELSE 'none' END AS correspondence_type,
  round(n / d, 4) AS exact_match_ratio, round((n + p) / d, 4) AS partial_match_ratio FROM m""")
def content_correspondence_shared(t):
    """Sides that share lines and many words: what is gone holds two of the added lines and all of them with another last word."""
    other = F.transform("added", lambda x: F.regexp_replace(x, "([a-z]+)$", "else"))
    sets = line_sets(t).withColumn("gone", F.array_sort(F.array_distinct(F.concat("gone", other, F.slice("added", 1, 2)))))
    out = A.content_correspondence(sets, "added", "gone")
    return out.select("conv_id", "turn", "exact_match_count", "partial_match_count", "correspondence_type",
                      "exact_match_ratio", "partial_match_ratio")


@query("content_correspondence", f"""WITH RECURSIVE {TURNS_SQL}, {GREEDY_SQL},
m AS (SELECT conv_id, turn, len(list_intersect(added, gone)) AS n, len(used) AS p, greatest(len(added), len(gone), 1) AS d FROM loose JOIN (SELECT conv_id, turn, used FROM greedy WHERE i = len(l)) USING (conv_id, turn))
SELECT conv_id, turn, n AS exact_match_count, p AS partial_match_count, CASE WHEN n > 0 THEN 'exact_removal' WHEN p > 0 THEN 'partial_overlap' ELSE 'none' END AS correspondence_type,
  round(n / d, 4) AS exact_match_ratio, round((n + p) / d, 4) AS partial_match_ratio FROM m""")
def content_correspondence(t):
    out = A.content_correspondence(line_sets(t), "added", "gone")
    return out.select("conv_id", "turn", "exact_match_count", "partial_match_count", "correspondence_type",
                      "exact_match_ratio", "partial_match_ratio")


@query("content_restoration", r"""WITH p AS (SELECT conv_id, turn, text, lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS cur FROM conversations),
a AS (SELECT conv_id, turn, [regexp_replace(x, '\s+$', '') for x in string_split(text, chr(10))] AS x, [regexp_replace(x, '\s+$', '') for x in string_split(CASE WHEN turn % 3 = 0 AND cur IS NOT NULL THEN text ELSE cur END, chr(10))] AS y FROM p),
m AS (SELECT *, len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) AS same, greatest(len(x), len(y)) AS most FROM a)
SELECT conv_id, turn, coalesce(x = y, false) AS restored, CASE WHEN y IS NULL THEN -1 ELSE most - same END AS line_diff_count,
  CASE WHEN y IS NULL THEN 0 ELSE round(same / most, 4) END AS similarity_ratio FROM m""")
def content_restoration(t):
    base = numbered_turns(t).join(turn_after(t, 2, "c"), ["conv_id", "n"], "left").withColumn(
        "cur", F.when((F.col("turn") % 3 == 0) & F.col("c").isNotNull(), F.col("text")).otherwise(F.col("c"))
    )
    return A.content_restoration(base, "text", "cur").select("conv_id", "turn", "restored", "line_diff_count", "similarity_ratio")


# ---- regions and functions of order lines ------------------------------------------


def _regions(t):
    c = F.col
    return t.lineitem.select(
        (c("l_partkey") % 500).alias("file"), (c("l_linestatus") == "O").alias("is_candidate"),
        (c("l_linenumber") * 10 + c("l_suppkey") % 40).cast("int").alias("new_start"), (c("l_quantity") % 4).cast("int").alias("new_count"),
    )


@query("region_overlap", """WITH h AS (SELECT l_partkey % 500 AS file, l_linestatus = 'O' AS c, l_linenumber * 10 + l_suppkey % 40 AS s, CAST(l_quantity AS BIGINT) % 4 AS n FROM lineitem),
l AS (SELECT DISTINCT file, c, unnest(range(s, s + n)) AS line FROM h WHERE n > 0),
m AS (SELECT file, line, bool_or(c) AS c, bool_or(NOT c) AS r FROM l GROUP BY ALL)
SELECT file, count(*) FILTER (c AND r) AS overlap_lines, min(line) FILTER (c AND r) AS overlap_start, max(line) FILTER (c AND r) AS overlap_end,
  min(line) FILTER (c) AS candidate_start, max(line) FILTER (c) AS candidate_end, min(line) FILTER (r) AS corrective_start, max(line) FILTER (r) AS corrective_end,
  count(*) FILTER (c AND r) > 0 AS overlap_exists FROM m GROUP BY file""")
def region_overlap(t):
    return A.region_overlap(_regions(t), ["file"])


FUNCTIONS_SQL = """rng AS (SELECT l_partkey AS file, l_linestatus = 'O' AS c, 'fn' || l_suppkey % 9 AS name, arg_max(l_linenumber * 8, (l_orderkey, l_linenumber, l_suppkey)) AS s,
  arg_max(l_linenumber * 8 + CAST(round(l_discount * 100) AS BIGINT), (l_orderkey, l_linenumber, l_suppkey)) AS e FROM lineitem GROUP BY ALL),
lns AS (SELECT DISTINCT l_partkey AS file, l_linestatus = 'O' AS c, CAST(l_quantity AS BIGINT) AS line FROM lineitem WHERE l_returnflag = 'R'),
nm AS (SELECT file, name, bool_or(c) AS ic, bool_or(NOT c) AS ir, bool_or(c AND hit) AS hc, bool_or(NOT c AND hit) AS hr FROM (
  SELECT r.*, EXISTS (SELECT 1 FROM lns l WHERE l.file = r.file AND l.c = r.c AND l.line BETWEEN s AND e) AS hit FROM rng r) GROUP BY ALL),
fn AS (SELECT file, bool_or(ic) AND bool_or(ir) AS parsed, min(name) FILTER (hc AND hr) AS strong, min(name) FILTER (ic AND ir) AS weak,
  arg_min(hc, name) FILTER (ic AND ir) AS weak_hit FROM nm GROUP BY file),
same AS (SELECT file, parsed, coalesce(strong, weak) AS function_name, coalesce(strong, weak) IS NOT NULL AS same_function,
  strong IS NOT NULL OR coalesce(weak_hit, false) AS structural_relationship FROM fn)"""


def functions_of(t):
    c = F.col
    place = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    start = c("l_linenumber") * 8
    ranges = t.lineitem.groupBy(
        c("l_partkey").alias("file"), (c("l_linestatus") == "O").alias("c"), F.concat(F.lit("fn"), c("l_suppkey") % 9).alias("name")
    ).agg(F.max_by(F.struct(start.alias("start"), (start + F.round(c("l_discount") * 100).cast("int")).alias("end")), place).alias("at")
    ).select("file", "c", "name", "at.start", "at.end")
    lines = t.lineitem.where(c("l_returnflag") == "R").select(
        c("l_partkey").alias("file"), (c("l_linestatus") == "O").alias("c"), c("l_quantity").cast("long").alias("line")
    )
    return A.same_function(ranges.where("c"), lines.where("c"), ranges.where("not c"), lines.where("not c"), ["file"])


@query("same_function", f"WITH {FUNCTIONS_SQL} SELECT * FROM same")
def same_function(t):
    return functions_of(t)


# ---- levels, context and rollups ------------------------------------------------------

REPORT_SQL = f"""{IDENTITY_SQL}, {FUNCTIONS_SQL}, facts AS (SELECT sha, path, max(part) AS part, max(q) AS q, max(line) AS line, min(supp) AS supp FROM sfiles GROUP BY sha, path),
ev AS (SELECT i.sha, i.path, i.method, i.corrective_path, k.prefix, k.corrective, k.label_source, q % 10 = 0 AS restored, CASE WHEN q % 4 = 1 THEN q::INT % 3 ELSE 0 END AS exact_match_count,
  CASE WHEN q % 4 = 1 THEN q::INT % 3 ELSE 0 END > 0 AS correspondence_exists, line % 2 = 0 AS overlap_exists, coalesce(s.same_function, false) AS same_function,
  coalesce(s.structural_relationship, false) AS structural_relationship FROM identity i JOIN links k USING (sha) JOIN facts f ON f.sha = i.sha AND f.path = i.path LEFT JOIN same s ON s.file = f.part),
report AS (SELECT *, CASE WHEN method = 'none' THEN 'UNKNOWN' WHEN restored OR exact_match_count > 0 THEN 'FILE_STRONG' WHEN correspondence_exists AND (overlap_exists OR structural_relationship) THEN 'FILE_MODERATE' ELSE 'FILE_WEAK' END AS level,
  list_filter([CASE WHEN restored THEN 'CONTENT_RESTORATION' END, CASE WHEN exact_match_count > 0 THEN 'EXACT_CANDIDATE_CONTENT_REMOVAL' END,
   CASE WHEN overlap_exists THEN 'SAME_REGION_OVERLAP' END, CASE WHEN structural_relationship THEN 'SAME_FUNCTION_CANDIDATE_CONTENT' WHEN same_function THEN 'SAME_FUNCTION_ONLY' END], lambda x: x IS NOT NULL) AS types FROM ev)"""


def report(t):
    """Files of positive changes with identity, content facts, level and types."""
    facts = {name: F.max(name) for name in ("part", "q", "line")}
    return _evidence(t, A.identified(links(t), _spread(linked_files(t)), facts)).withColumn("level", A.evidence_level())


def _evidence(t, found):
    """Content facts and types of files, which need no identity."""
    q = F.col("q").cast("int")
    exact = F.when(F.col("q") % 4 == 1, q % 3).otherwise(0)
    return found.join(functions_of(t).withColumnRenamed("file", "part"), "part", "left").withColumns({
        "restored": F.col("q") % 10 == 0, "exact_match_count": exact, "correspondence_exists": exact > 0, "overlap_exists": F.col("line") % 2 == 0,
        "same_function": F.coalesce("same_function", F.lit(False)), "structural_relationship": F.coalesce("structural_relationship", F.lit(False)),
    }).withColumn("evidence_types", A.evidence_types())


@query("attribution_report", f"WITH {REPORT_SQL} SELECT sha, path, method, corrective_path, corrective, level, array_to_string(types, ',') AS types FROM report")
def attribution_report(t):
    return report(t).select("sha", "path", "method", "corrective_path", "corrective", "level", F.array_join("evidence_types", ",").alias("types"))


@query("evidence_level", f"WITH {REPORT_SQL} SELECT method, level, count(*) AS n FROM report GROUP BY ALL")
def evidence_level(t):
    return report(t).groupBy("method", "level").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_types", f"WITH {REPORT_SQL} SELECT evidence_type, count(*) AS n FROM (SELECT unnest(types) AS evidence_type FROM report) GROUP BY 1")
def evidence_types(t):
    found = _spread(linked_files(t)).join(links(t).select("sha"), "sha").groupBy("sha", "path").agg(*[F.max(name).alias(name) for name in ("part", "q", "line")])
    return A.type_distribution(_evidence(t, found))


@query("commit_evidence_level", f"""WITH {LINKS_SQL} SELECT sha, CASE WHEN corrective IS NOT NULL THEN 'COMMIT_STRONG' WHEN prefix IS NOT NULL THEN 'COMMIT_WEAK' ELSE 'COMMIT_NONE' END AS commit_evidence_level,
 CASE WHEN overlap_files > 0 THEN 'FILE_WEAK' ELSE 'UNKNOWN' END AS file_evidence_level FROM overlap""")
def commit_evidence_level(t):
    out = A.commit_evidence_level(A.path_overlap(links(t), linked_files(t)))
    return out.select("sha", "commit_evidence_level", "file_evidence_level")


REVERT_SQL = f"""{LINKS_SQL}, rv AS (SELECT *, CASE WHEN label_source <> 'line_overlap' THEN 'COMMIT_STRONG' ELSE 'COMMIT_NONE' END AS commit_evidence_level,
 CASE WHEN label_source <> 'line_overlap' AND overlap_files > 0 THEN 'FILE_WEAK' ELSE 'UNKNOWN' END AS file_evidence_level FROM overlap)"""


def _reverts(t):
    k = links(t)
    return A.revert_evidence(A.path_overlap(k, linked_files(t)).join(k.select("sha", "label_source"), "sha"))


@query("revert_evidence", f"WITH {REVERT_SQL} SELECT sha, label_source, commit_evidence_level, file_evidence_level FROM rv")
def revert_evidence(t):
    return _reverts(t).select("sha", "label_source", "commit_evidence_level", "file_evidence_level")


@query("source_breakdown", f"""WITH {REVERT_SQL} SELECT label_source, count(*) AS commits, count(*) FILTER (commit_evidence_level = 'COMMIT_STRONG') AS commit_strong,
 count(*) FILTER (file_evidence_level = 'FILE_WEAK') AS file_weak FROM rv GROUP BY 1""")
def source_breakdown(t):
    return A.source_breakdown(_reverts(t))


STATUS_SQL = f"""{LINKS_SQL}, st AS (SELECT DISTINCT sha, status FROM files), sp AS (SELECT k.sha,
  list_sort(list_filter(['added', 'deleted', 'renamed', 'modified'], lambda s: list_contains(a, s) AND list_contains(coalesce(b, []), s))) AS both_
  FROM links k JOIN (SELECT sha, list(status) AS a FROM st GROUP BY sha) USING (sha) LEFT JOIN (SELECT sha AS c, list(status) AS b FROM st GROUP BY sha) ON c = k.corrective)"""


@query("status_pattern", f"""WITH {STATUS_SQL} SELECT sha, array_to_string(both_, ',') AS status_overlap, list_contains(both_, 'added') AS added_in_both,
 list_contains(both_, 'deleted') AS deleted_in_both, list_contains(both_, 'renamed') AS renamed_in_both FROM sp""")
def status_pattern(t):
    return A.status_pattern(links(t), linked_files(t))


PROXIMITY_SQL = f"""{LINKS_SQL}, mv AS (SELECT l_orderkey AS sha, avg(l_quantity) AS a, avg(l_discount * 100) AS b, avg(l_tax * 100) AS c FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey % 11 <> 0 GROUP BY 1),
px AS (SELECT k.sha, x.a IS NOT NULL AND y.a IS NOT NULL AS available,
  CASE WHEN x.a IS NOT NULL AND y.a IS NOT NULL THEN round((x.a*y.a + x.b*y.b + x.c*y.c) / (sqrt(x.a*x.a + x.b*x.b + x.c*x.c) * sqrt(y.a*y.a + y.b*y.b + y.c*y.c)), 6) END AS cosine_similarity,
  round(sqrt((x.a-y.a)**2 + (x.b-y.b)**2 + (x.c-y.c)**2), 6) AS euclidean_distance
  FROM links k LEFT JOIN mv x ON x.sha = k.sha LEFT JOIN mv y ON y.sha = k.corrective)"""


def proximity(t):
    c = F.col
    vec = F.when(c("l_suppkey") % 11 != 0, F.array(c("l_quantity"), c("l_discount") * 100, c("l_tax") * 100)).otherwise(F.array(c("l_quantity")))
    return A.feature_proximity(links(t), t.lineitem.select(c("l_orderkey").alias("sha"), vec.alias("vector")), 3)


@query("feature_proximity", f"WITH {PROXIMITY_SQL} SELECT * FROM px")
def feature_proximity(t):
    return proximity(t)


TESTS_SQL = f"""{LINKS_SQL}, ts AS (SELECT sha, count(*) FILTER (test_flag > 0.5 OR contains(path, 'test_')) AS test_count, count(*) FILTER (NOT (test_flag > 0.5 OR contains(path, 'test_'))) AS prod_count FROM files GROUP BY sha)"""


@query("test_separation", f"WITH {TESTS_SQL} SELECT sha, test_count, prod_count, test_count > 0 AND prod_count > 0 AS has_both FROM ts")
def test_separation(t):
    return A.test_separation(linked_files(t))


EXCLUSIVE_SQL = f"""{LINKS_SQL}, ex AS (SELECT sha, corrective_files > 0 AS available, CASE WHEN corrective_files > 0 THEN round(overlap_files / corrective_files, 4) END AS overlap_ratio,
  CASE WHEN corrective_files > 0 THEN round(overlap_files / candidate_files, 4) END AS narrowing_ratio FROM overlap)"""


@query("exclusivity", f"WITH {EXCLUSIVE_SQL} SELECT * FROM ex")
def exclusivity(t):
    return A.exclusivity(A.path_overlap(links(t), linked_files(t)))


@query("attribution_rollups", f"""WITH {LINKS_SQL}, r AS (SELECT sha % 25 AS repo, CASE WHEN sha % 10 < 7 THEN 'train' ELSE 'test' END AS split, category FROM overlap)
SELECT repo, split, category, count(*) AS n, grouping_id(repo, split, category) AS level FROM r GROUP BY CUBE (repo, split, category)""")
def attribution_rollups(t):
    base = A.path_overlap(links(t), linked_files(t)).select(
        (F.col("sha") % 25).alias("repo"), F.when(F.col("sha") % 10 < 7, "train").otherwise("test").alias("split"), "category"
    )
    return A.attribution_rollups(base, ["repo", "split"], "category")


def _summary_sql(mention):
    return f"""WITH {PROXIMITY_SQL}, {STATUS_SQL[len(LINKS_SQL) + 2:]}, {TESTS_SQL[len(LINKS_SQL) + 2:]}, {EXCLUSIVE_SQL[len(LINKS_SQL) + 2:]}, {mention}
SELECT (SELECT count(*) FROM mentions) AS commits, (SELECT count(*) FROM mentions WHERE matched > 0) AS with_mention, (SELECT count(*) FROM sp WHERE len(both_) > 0) AS with_status_overlap,
 (SELECT count(*) FROM px WHERE available) AS with_vectors, (SELECT round(avg(cosine_similarity), 5) FROM px) AS mean_cosine,
 (SELECT count(*) FROM ts WHERE test_count > 0 AND prod_count > 0) AS mixed_commits, (SELECT count(*) FROM ex WHERE available) AS with_corrective, (SELECT round(avg(overlap_ratio), 4) FROM ex) AS mean_overlap_ratio"""


def _summary(t, said):
    k, f = links(t), linked_files(t)
    parts = A.contextual_summary(
        said, A.status_pattern(k, f), proximity(t), A.test_separation(f), A.exclusivity(A.path_overlap(k, f))
    )
    out = parts[0]
    for part in parts[1:]:
        out = beside(out, part)
    return rounded(out, 5)


@query("contextual_summary", _summary_sql(MENTION_SQL))
def contextual_summary(t):
    return _summary(t, mentions(t))


@query("contextual_summary_whole", _summary_sql(MENTION_WHOLE_SQL))
def contextual_summary_whole(t):
    return _summary(t, mentions(t, whole=True))


@query("prediction_units", f"""WITH {REPORT_SQL} SELECT count(DISTINCT sha) AS commits, count(*) AS files, count(*) FILTER (level = 'FILE_STRONG') AS file_strong,
 count(*) FILTER (level = 'FILE_MODERATE') AS file_moderate, count(*) FILTER (level = 'FILE_WEAK') AS file_weak, count(*) FILTER (level = 'UNKNOWN') AS file_unknown,
 count(*) FILTER (same_function) AS same_function FROM report""")
def prediction_units(t):
    return A.prediction_units(report(t))


@query("reference_lookup", """WITH r AS (SELECT c_nationkey AS repo, l_orderkey AS sha, l_partkey AS path, CASE WHEN l_suppkey % 3 > 0 THEN o_orderdate END AS ts, l_linenumber, l_suppkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
n AS (SELECT repo, sha, path, count(*) AS rows FROM r GROUP BY ALL), f AS (SELECT repo, sha, arg_min(ts, (l_linenumber, path, l_suppkey)) FILTER (ts IS NOT NULL) AS ts FROM r GROUP BY ALL)
SELECT n.*, f.ts FROM n LEFT JOIN f USING (repo, sha)""")
def reference_lookup(t):
    from patchsieve.plans.bindings import repo_files

    rows = repo_files(t).withColumnRenamed("cid", "sha").withColumn("path", F.col("part")).withColumn(
        "ts", F.when(F.col("supp") % 3 > 0, F.col("ts"))
    )
    supervised, ambiguous = rows.where("not excluded"), rows.where("excluded")
    both = supervised.unionByName(ambiguous)
    return A.reference_lookup(both).join(A.first_timestamps(both, ["line", "path", "supp"]), ["repo", "sha"], "left")
