"""Path, message and line functions on pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchsieve.functions import lines as L
from patchsieve.functions import messages as M
from patchsieve.functions import paths as P
from patchsieve.plans.registry import query, rounded

# a file path for every page: the path of its url plus a name that depends on the page
_NAMES = ["x.py", "X.JS", ".bashrc", "a.tar.gz", "Makefile", "..hidden.Rs", "test_a.go", "a_test.go",
          "testing.md", "a.spec.ts", "noext.", "a_spec.rb", "deep.CSS"]
_DIRS = ["src", "tests", "spec", "my_tests", "test_", "lib"]


def page_paths(t):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    top = F.element_at(F.array(*map(F.lit, _DIRS)), (F.col("page_id") % len(_DIRS) + 1).cast("int"))
    url = F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]*/|\?.*$", "")
    return t.pages.select("page_id", F.concat_ws("/", top, url, name).alias("path"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_EXT_SQL = "CASE ext " + " ".join(
    f"WHEN '{e}' THEN '{lang}'" for e, lang in P.LANGUAGE_OF.items()
) + " ELSE 'unknown' END"

PATHS_SQL = rf"""paths AS (SELECT page_id, {_list(_DIRS)}[page_id % {len(_DIRS)} + 1] || '/' || regexp_replace(url, '^[a-z]+://[^/]*/|\?.*$', '', 'g') || '/' || {_list(_NAMES)}[page_id % {len(_NAMES)} + 1] AS path FROM pages),
names AS (SELECT page_id, path, string_split(path, '/')[-1] AS base, regexp_replace(string_split(path, '/')[-1], '^\.+', '') AS nd FROM paths),
langs AS (SELECT *, CASE WHEN contains(nd, '.') THEN lower(string_split(nd, '.')[-1]) ELSE '' END AS ext FROM names),
named AS (SELECT *, {_EXT_SQL} AS language FROM langs)"""


@query("language", f"WITH {PATHS_SQL} SELECT page_id, path, language FROM named")
def language(t):
    return page_paths(t).withColumn("language", P.language(F.col("path")))


@query("language_index", f"""WITH {PATHS_SQL}
SELECT page_id, round((list_position({_list(P.LANGUAGES)}, language) - 1) / 23, 6) AS language_index, language AS decoded FROM named""")
def language_index(t):
    index = P.language_index(P.language(F.col("path")))
    return page_paths(t).select(
        "page_id", F.round(index, 6).alias("language_index"), P.language_name(index).alias("decoded")
    )


@query("test_file", rf"""WITH {PATHS_SQL}
SELECT page_id, regexp_matches(path, '(^|/)(tests?|test_|_test|spec)/') OR regexp_matches(base, '^test_\w+|^\w+_test\.\w+$|^\w+_spec\.\w+$|^\w+\.test\.\w+$|^\w+\.spec\.\w+$') AS is_test,
  NOT (regexp_matches(path, '(^|/)(tests?|test_|_test|spec)/') OR regexp_matches(base, '^test_\w+|^\w+_test\.\w+$|^\w+_spec\.\w+$|^\w+\.test\.\w+$|^\w+\.spec\.\w+$')) AS is_prod FROM named""")
def test_file(t):
    return page_paths(t).select(
        "page_id", P.is_test_file(F.col("path")).alias("is_test"), P.is_prod_file(F.col("path")).alias("is_prod")
    )


# a message for every document: a start that depends on its id, then its whole text
_STARTS = ["Fixes the thing: ", "prefix only ", "Revert \"old title\" ", "revert it: ", "Hotfix. resolves ", "debugging ",
           "resolved; ", "Correct this ", "  ", "patched\t", "regression in ", "unreverted "]


def messages(t):
    start = F.element_at(F.array(*map(F.lit, _STARTS)), (F.col("doc_id") % len(_STARTS) + 1).cast("int"))
    return t.documents.select("doc_id", "n_chars", F.concat(start, F.col("text")).alias("message"))


_STARTS_SQL = "[" + ", ".join("'" + s.replace("\t", "' || chr(9) || '") + "'" for s in _STARTS) + "]"
MESSAGES_SQL = f"""messages AS (SELECT doc_id, n_chars, {_STARTS_SQL}[doc_id % {len(_STARTS)} + 1] || text AS message FROM documents)"""
FIX_SQL = r"regexp_matches(message, '(?i)\b(fix(es|ed)?|bug|resolve[sd]?|patch(es|ed)?|hotfix|regression)\b')"


@query("is_bug_fix", f"""WITH {MESSAGES_SQL} SELECT doc_id, {FIX_SQL} AND n_chars % 10 <> 0 AS is_bug_fix, {FIX_SQL} AS says_fix,
 regexp_matches(lower(message), 'fix|bug|patch|hotfix|resolve|correct') AS loose FROM messages""")
def is_bug_fix(t):
    return messages(t).select(
        "doc_id", M.is_bug_fix(F.col("message"), F.col("n_chars") % 10).alias("is_bug_fix"),
        M.says_fix(F.col("message")).alias("says_fix"), M.is_bug_fix_loose(F.col("message")).alias("loose"),
    )


@query("is_revert", rf"""WITH {MESSAGES_SQL} SELECT doc_id, regexp_matches(trim(message), '(?i)^revert\s') AS is_revert,
 nullif(trim(regexp_extract(message, '(?i)Revert\s+["''](.+?)["'']', 1)), '') AS quoted FROM messages""")
def is_revert(t):
    return messages(t).select(
        "doc_id", M.is_revert(F.col("message")).alias("is_revert"), M.revert_quote(F.col("message")).alias("quoted")
    )


@query("hex_refs", """SELECT doc_id, lower(ref) AS ref, count(*) AS n FROM (
 SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[0-9a-f]{7,40}')) AS ref FROM documents) GROUP BY ALL""")
def hex_refs(t):
    refs = t.documents.select("doc_id", F.explode(M.hex_refs(F.col("text"))).alias("ref"))
    return refs.groupBy("doc_id", "ref").agg(F.count(F.lit(1)).alias("n"))


@query("fix_prefix", """WITH e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Commit x referenced by bug-fix ' || substr(md5(doc_id::VARCHAR), 1, 12) || ' via id'
  WHEN 1 THEN 'Commit x was reverted by ' || md5(doc_id::VARCHAR) WHEN 2 THEN 'reverted by abc1234' ELSE substr(text, 1) END AS evidence FROM documents)
SELECT doc_id, coalesce(nullif(regexp_extract(evidence, 'bug-fix ([0-9a-f]{8,40})', 1), ''), nullif(regexp_extract(evidence, 'reverted by ([0-9a-f]{8,40})', 1), '')) AS prefix FROM e""")
def fix_prefix(t):
    sha, kind = F.md5(F.col("doc_id").cast("string")), F.col("doc_id") % 4
    evidence = (
        F.when(kind == 0, F.concat(F.lit("Commit x referenced by bug-fix "), F.substring(sha, 1, 12), F.lit(" via id")))
        .when(kind == 1, F.concat(F.lit("Commit x was reverted by "), sha))
        .when(kind == 2, "reverted by abc1234").otherwise(F.col("text"))
    )
    return t.documents.select("doc_id", M.fix_prefix(evidence).alias("prefix"))


# the reference stands before the whole text
@query("fix_prefix_whole", """WITH e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Commit x referenced by bug-fix ' || substr(md5(doc_id::VARCHAR), 1, 12) || ' via id '
  WHEN 1 THEN 'Commit x was reverted by ' || md5(doc_id::VARCHAR) || ' ' WHEN 2 THEN 'reverted by abc1234 ' ELSE '' END || text AS evidence FROM documents)
SELECT doc_id, coalesce(nullif(regexp_extract(evidence, 'bug-fix ([0-9a-f]{8,40})', 1), ''), nullif(regexp_extract(evidence, 'reverted by ([0-9a-f]{8,40})', 1), '')) AS prefix FROM e""")
def fix_prefix_whole(t):
    sha, kind = F.md5(F.col("doc_id").cast("string")), F.col("doc_id") % 4
    reference = (
        F.when(kind == 0, F.concat(F.lit("Commit x referenced by bug-fix "), F.substring(sha, 1, 12), F.lit(" via id ")))
        .when(kind == 1, F.concat(F.lit("Commit x was reverted by "), sha, F.lit(" ")))
        .when(kind == 2, "reverted by abc1234 ").otherwise("")
    )
    return t.documents.select("doc_id", M.fix_prefix(F.concat(reference, "text")).alias("prefix"))


@query("declaration_counts", r"""WITH d AS (SELECT doc_id, array_to_string([CASE i % 4 WHEN 1 THEN 'def ' WHEN 2 THEN '  class ' WHEN 3 THEN 'import ' ELSE 'f(x) {' END || l for l, i in string_split(text, chr(10))], chr(10)) AS body FROM documents)
SELECT doc_id, greatest(len(regexp_extract_all(body, '(?m)^\s*def\s+[\pL\pN_]+')), len(regexp_extract_all(body, '(?m)^\s*[\pL\pN_]+\s*\(.*\)\s*\{'))) AS functions,
  len(regexp_extract_all(body, '(?m)^\s*class\s+[\pL\pN_]+')) AS classes, len(regexp_extract_all(body, '(?m)^\s*(?:from\s+\S+\s+)?import\s+')) AS imports FROM d""")
def declaration_counts(t):
    i = lambda n: n + 1
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, n: F.concat(
        F.when(i(n) % 4 == 1, "def ").when(i(n) % 4 == 2, "  class ").when(i(n) % 4 == 3, "import ").otherwise("f(x) {"), x
    )), "\n")
    return t.documents.select("doc_id", body.alias("body")).select(
        "doc_id", L.count_most(F.col("body"), L.FUNCTION_PATTERNS).alias("functions"),
        L.count_most(F.col("body"), L.CLASS_PATTERNS).alias("classes"),
        L.count_most(F.col("body"), L.IMPORT_PATTERNS).alias("imports"),
    )


@query("indent_stats", r"""WITH l AS (SELECT doc_id, unnest([repeat(' ', (i % 5)::INT) || l for l, i in string_split(text, chr(10))]) AS line FROM documents)
SELECT doc_id, round(avg(len(regexp_extract(line, '^\s*'))), 6) AS avg_changed_line_indent, max(len(regexp_extract(line, '^\s*'))) AS max_changed_line_indent FROM l GROUP BY doc_id""")
def indent_stats(t):
    padded = F.transform(F.split("text", "\n", -1), lambda x, n: F.concat(F.repeat(F.lit(" "), (n + 1) % 5), x))
    total, n, widest = L.indent_stats(padded)
    return rounded(t.documents.select("doc_id", (total / n).alias("avg_changed_line_indent"), widest.alias("max_changed_line_indent")))


@query("normalize_line", r"""WITH l AS (SELECT conv_id, turn, unnest(string_split('  ' || replace(text, ' ', '  ') || ' ' || chr(9), chr(10))) AS line FROM conversations)
SELECT conv_id, turn, regexp_replace(line, '\s+$', '') AS line, count(*) AS n FROM l GROUP BY ALL""")
def normalize_line(t):
    text = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit(" \t"))
    rows = t.conversations.select("conv_id", "turn", F.explode(F.split(text, "\n", -1)).alias("line"))
    return rows.groupBy("conv_id", "turn", L.normalize_line(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("commit_size_bucket", """WITH c AS (SELECT o_orderkey AS cid, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT cid, n * 3 AS files, CASE WHEN n * 3 = 1 THEN '1' WHEN n * 3 <= 3 THEN '2-3' WHEN n * 3 <= 5 THEN '4-5' WHEN n * 3 <= 10 THEN '6-10'
 WHEN n * 3 <= 20 THEN '11-20' ELSE '>20' END AS bucket FROM c""")
def commit_size_bucket(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("cid")).agg(F.count(F.lit(1)).alias("n"))
    out = t.orders.select(F.col("o_orderkey").alias("cid")).join(n, "cid", "left").fillna(0, ["n"])
    return out.select("cid", (F.col("n") * 3).alias("files"), M.size_bucket(F.col("n") * 3).alias("bucket"))


@query("short_sha", """SELECT page_id, substr(md5(url), 1, 8) AS short, substr(md5(url), 1, 12) AS longer FROM pages""")
def short_sha(t):
    sha = F.md5("url")
    return t.pages.select("page_id", M.short_sha(sha).alias("short"), M.short_sha(sha, 12).alias("longer"))
