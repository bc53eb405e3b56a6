"""Diff text built from documents, and the tables read out of it.

Every document is one change with two file sections. The SQL side computes the
same rows from the documents themselves and never sees the diff text.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from patchsieve.functions import paths as P
from patchsieve.operators import diffs as D
from patchsieve.operators import features as X
from patchsieve.operators.frames import spread
from patchsieve.plans.bindings import SEQ, files
from patchsieve.plans.registry import query, rounded

KEYS = ["doc_id", "file_seq"]


def diff_table(t):
    c = F.col
    base = spread(t.documents.select("doc_id", "lang", "source", "text")).select(
        "doc_id", "lang", "source", F.split("text", "\n", -1).alias("ls")
    )
    prefix = lambda i: (
        F.when(i % 5 == 0, "").when(i % 5 == 1, "    def ").when(i % 5 == 2, "  class ")
        .when(i % 5 == 3, "import ").otherwise("func ")
    )
    marker = lambda i: F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" ")
    base = base.withColumn("body", F.transform("ls", lambda x, i: F.concat(marker(i), prefix(i), x)))
    base = base.withColumn("n", F.size("ls")).withColumn("half", F.floor((F.size("ls") + 1) / 2).cast("int"))
    s = (c("doc_id") % 50 + 1)
    path = F.concat(F.lit("src/"), c("lang"), F.lit("/doc_"), c("doc_id"), F.lit(".py"))
    first = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 1..2 100644\n--- a/"), path,
        F.lit("\n+++ b/"), path, F.lit("\n@@ -"), s, F.lit(","), c("half"), F.lit(" +"), s + 2, F.lit(","),
        c("half") + 1, F.lit(" @@ def context():\n"), F.array_join(F.slice("body", F.lit(1), c("half")), "\n"),
        F.when(c("n") > c("half"), F.concat(
            F.lit("\n@@ -"), s + 100, F.lit(" +"), s + 200, F.lit(","), c("n") - c("half"), F.lit(" @@\n"),
            F.array_join(F.slice("body", c("half") + 1, c("n")), "\n"))).otherwise(""),
    )
    i = c("doc_id").cast("string")
    def section(old, new, rest):
        return F.concat(F.lit("\ndiff --git a/"), old, F.lit(" b/"), new, F.lit("\n"), rest)
    added = F.concat(F.lit("tests/test_"), i, F.lit(".rs"))
    gone = F.concat(F.lit("docs/"), c("source"), F.lit("/"), i, F.lit(".md"))
    pic = F.concat(F.lit("img/"), i, F.lit(".png"))
    moved = F.concat(F.lit("lib/"), c("lang"), F.lit("/"), i, F.lit(".js"))
    kind = c("doc_id") % 5
    second = (
        F.when(kind == 0, section(added, added, F.concat(
            F.lit("new file mode 100644\n--- /dev/null\n+++ b/"), added, F.lit("\n@@ -0,0 +1 @@\n+fn main() {\n"))))
        .when(kind == 1, section(gone, gone, F.concat(
            F.lit("deleted file mode 100644\n--- a/"), gone, F.lit("\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-one\n-  two\n"))))
        .when(kind == 2, section(gone, moved, F.concat(
            F.lit("similarity index 90%\nrename from "), gone, F.lit("\nrename to "), moved, F.lit("\n"))))
        .when(kind == 3, section(pic, pic, F.concat(F.lit("Binary files a/"), pic, F.lit(" and b/"), pic, F.lit(" differ\n"))))
        .otherwise(section(pic, pic, F.concat(F.lit("new file mode 100644\nBinary files /dev/null and b/"), pic, F.lit(" differ\n"))))
    )
    return base.select("doc_id", F.concat(first, second).alias("diff_text"))


def sections(t):
    return D.split_files(diff_table(t), ["doc_id"], "diff_text")


LINES_SQL = r"""base AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls, len(ls) AS n, (n + 1) // 2 AS half,
  doc_id % 50 + 1 AS s FROM documents),
flat AS (SELECT doc_id, n, half, s, unnest(range(n)) AS i, unnest(ls) AS line FROM base),
lines AS (SELECT doc_id, n, half, s, i, i % 3 AS m, (i >= half)::INT AS hunk_seq,
  CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN '    def ' WHEN 2 THEN '  class ' WHEN 3 THEN 'import ' ELSE 'func ' END || line AS txt FROM flat),
second AS (SELECT doc_id, lang, source, doc_id % 5 AS kind, 'tests/test_' || doc_id || '.rs' AS added, 'docs/' || source || '/' || doc_id || '.md' AS gone,
  'img/' || doc_id || '.png' AS pic, 'lib/' || lang || '/' || doc_id || '.js' AS moved FROM documents),
heads AS (
  SELECT doc_id, 0 AS file_seq, 'src/' || lang || '/doc_' || doc_id || '.py' AS path, 'src/' || lang || '/doc_' || doc_id || '.py' AS old_path,
    'modified' AS status, false AS is_binary FROM documents
  UNION ALL
  SELECT doc_id, 1, CASE kind WHEN 0 THEN added WHEN 1 THEN gone WHEN 2 THEN moved WHEN 3 THEN pic ELSE '/dev/null' END,
    CASE kind WHEN 0 THEN added WHEN 1 THEN gone WHEN 2 THEN gone ELSE pic END,
    CASE kind WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'binary' END, kind >= 3 FROM second),
hunk AS (
  SELECT doc_id, 0 AS file_seq, 0 AS hunk_seq, s AS old_start, half AS old_count, s + 2 AS new_start, half + 1 AS new_count FROM base
  UNION ALL SELECT doc_id, 0, 1, s + 100, 1, s + 200, n - half FROM base WHERE n > half
  UNION ALL SELECT doc_id, 1, 0, 0, 0, 1, 1 FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 1, 0, 1, 2, 0, 0 FROM documents WHERE doc_id % 5 = 1),
changed AS (
  SELECT doc_id, 0 AS file_seq, hunk_seq, i - hunk_seq * half + 1 AS line_seq, CASE m WHEN 0 THEN 'added' ELSE 'deleted' END AS kind, txt AS text FROM lines WHERE m < 2
  UNION ALL SELECT doc_id, 1, 0, 1, 'added', 'fn main() {' FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 1, 0, 1, 'deleted', 'one' FROM documents WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id, 1, 0, 2, 'deleted', '  two' FROM documents WHERE doc_id % 5 = 1)"""


@query("split_files", f"""WITH {LINES_SQL} SELECT doc_id, file_seq, split_part(path, '/', 1) AS top FROM heads
  WHERE path <> '/dev/null' UNION ALL SELECT doc_id, file_seq, 'img' FROM heads WHERE path = '/dev/null'""")
def split_files(t):
    top = F.regexp_extract("section", r"^diff --git a/(?:docs/[^ ]+ b/(?=lib))?([^/]+)/", 1)
    return sections(t).select(*KEYS, top.alias("top"))


@query("file_header", f"WITH {LINES_SQL} SELECT * FROM heads")
def file_header(t):
    return D.file_header(sections(t)).select(*KEYS, "path", "old_path", "status", "is_binary")


@query("hunks", f"WITH {LINES_SQL} SELECT * FROM hunk")
def hunks(t):
    return D.hunks(sections(t), KEYS).drop("content")


def hunk_rows(t):
    return D.hunks(sections(t), KEYS)


@query("changed_lines", f"WITH {LINES_SQL} SELECT * FROM changed")
def changed_lines(t):
    return D.changed_lines(hunk_rows(t), KEYS)


@query("line_coordinates", f"""WITH {LINES_SQL}, numbered AS (
  SELECT c.*, h.old_start, h.new_start,
   c.line_seq - count(*) FILTER (kind = 'deleted') OVER w AS new_off, c.line_seq - count(*) FILTER (kind = 'added') OVER w AS old_off
  FROM changed c JOIN hunk h USING (doc_id, file_seq, hunk_seq)
  WINDOW w AS (PARTITION BY doc_id, file_seq, hunk_seq ORDER BY line_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, file_seq, hunk_seq, line_seq, kind, CASE kind WHEN 'added' THEN new_start + new_off ELSE old_start + old_off END AS line FROM numbered""")
def line_coordinates(t):
    return D.line_coordinates(hunk_rows(t), KEYS)


@query("range_hits", """WITH spans AS (SELECT l_partkey AS part, l_orderkey, l_suppkey, l_linestatus = 'O' AS new, l_returnflag = 'R' AS is_try,
   l_linenumber * 5 AS a, l_linenumber * 5 + CAST(round(l_discount * 100) AS BIGINT) AS b FROM lineitem),
lines AS (SELECT DISTINCT l_partkey AS part, l_linestatus = 'O' AS added, CAST(l_quantity AS BIGINT) AS line FROM lineitem WHERE l_discount = 0),
sides AS (SELECT p_partkey AS part, p_size % 4 <> 1 AS has_old, p_size % 4 <> 2 AS has_new, p_type <> 'ECONOMY' AS eligible FROM part),
hit AS (SELECT s.* FROM spans s WHERE EXISTS (SELECT 1 FROM lines l WHERE l.part = s.part AND (s.is_try OR l.added = s.new) AND l.line BETWEEN s.a AND s.b)),
n AS (SELECT part, count(*) FILTER (added) AS na, count(*) FILTER (NOT added) AS nd FROM lines GROUP BY part),
c AS (SELECT part, count(*) FILTER (NOT is_try AND new) AS fnew, count(*) FILTER (NOT is_try AND NOT new) AS fold,
  count(*) FILTER (is_try AND new) AS tnew, count(*) FILTER (is_try AND NOT new) AS told,
  count(DISTINCT CASE WHEN is_try THEN a * 1000 + b END) AS tany FROM hit GROUP BY part)
SELECT part, CASE WHEN eligible AND has_new THEN coalesce(fnew, 0) ELSE 0 END AS function_declarations_added,
  CASE WHEN eligible AND has_old THEN coalesce(fold, 0) ELSE 0 END AS function_declarations_deleted,
  CASE WHEN NOT eligible THEN 0 WHEN has_old AND has_new THEN coalesce(tany, 0)
   ELSE CASE WHEN has_new AND na > 0 THEN coalesce(tnew, 0) ELSE 0 END + CASE WHEN has_old AND nd > 0 THEN coalesce(told, 0) ELSE 0 END END AS try_changed
FROM sides LEFT JOIN c USING (part) LEFT JOIN n USING (part)""")
def range_hits(t):
    c = F.col
    start = (c("l_linenumber") * 5).cast("long")
    ranges = t.lineitem.select(
        c("l_partkey").alias("part"), F.when(c("l_linestatus") == "O", "new").otherwise("old").alias("side"),
        F.when(c("l_returnflag") == "R", "try").otherwise("function").alias("kind"),
        start.alias("start"), (start + F.round(c("l_discount") * 100).cast("long")).alias("end"),
    )
    lines = t.lineitem.where(c("l_discount") == 0).select(
        c("l_partkey").alias("part"), F.when(c("l_linestatus") == "O", "added").otherwise("deleted").alias("kind"),
        c("l_quantity").cast("long").alias("line"),
    )
    sides = t.part.select(
        c("p_partkey").alias("part"), (c("p_size") % 4 != 1).alias("has_old"),
        (c("p_size") % 4 != 2).alias("has_new"), (c("p_type") != "ECONOMY").alias("eligible"),
    )
    return D.range_hits(ranges, lines, sides, ["part"])


def features(t):
    return D.file_features(sections(t), KEYS)


_WORD = r"[\pL\pN_]"


def _count(pattern, side):
    return f"len(regexp_extract_all({side}, '(?m)^\\s*{pattern}'))"


_MODS = rf"(?:function\s+{_WORD}+|(?:public|private|protected|static|async|export|const|let|var)\s+)*"


def _most(side, patterns):
    return "greatest(" + ", ".join(_count(p, side) for p in patterns) + ")"


_FN = [rf"def\s+{_WORD}+", rf"{_MODS}{_WORD}+\s*\(.*\)\s*(?:\{{|=>)", rf"func\s+{_WORD}+", rf"{_WORD}+\s*\(.*\)\s*\{{"]
_CL = [rf"class\s+{_WORD}+", rf"(?:export\s+)?(?:abstract\s+)?class\s+{_WORD}+"]
_IM = [r"(?:from\s+\S+\s+)?import\s+", rf"(?:import\s+\{{|import\s+{_WORD}|from\s+\S+\s+import\s+)",
       rf'"[\pL\pN_/]+"', r"(?:import|from|include|require|#include)\s"]

FEATURES_SQL = LINES_SQL + rf""", agg AS (SELECT doc_id, file_seq,
  coalesce(string_agg(text, chr(10) ORDER BY hunk_seq, line_seq) FILTER (kind = 'added'), '') AS a,
  coalesce(string_agg(text, chr(10) ORDER BY hunk_seq, line_seq) FILTER (kind = 'deleted'), '') AS d,
  count(*) FILTER (kind = 'added') AS na, count(*) FILTER (kind = 'deleted') AS nd,
  sum(len(regexp_extract(text, '^\s*'))) AS isum, max(len(regexp_extract(text, '^\s*'))) AS imax FROM changed GROUP BY ALL),
hs AS (SELECT doc_id, file_seq, count(*) AS nh, avg(old_count + new_count) AS ah FROM hunk GROUP BY ALL),
feat AS (SELECT h.doc_id, h.file_seq, h.path, h.status, h.is_binary, coalesce(na, 0) AS lines_added, coalesce(nd, 0) AS lines_deleted, coalesce(nh, 0) AS hunk_count,
  {_most("coalesce(a, '')", _FN)} AS function_declarations_added, {_most("coalesce(d, '')", _FN)} AS function_declarations_deleted,
  {_most("coalesce(a, '')", _CL)} AS class_declarations_added, {_most("coalesce(d, '')", _CL)} AS class_declarations_deleted,
  {_most("coalesce(a, '')", _IM)} AS imports_added, {_most("coalesce(d, '')", _IM)} AS imports_deleted,
  coalesce(isum, 0)::BIGINT AS indent_sum, coalesce(na + nd, 0) AS indent_lines, coalesce(imax, 0) AS max_changed_line_indent, coalesce(ah, 0) AS avg_hunk_size,
  CASE WHEN h.path LIKE 'src/%' THEN 'python' WHEN h.path LIKE '%.rs' THEN 'rust' WHEN h.path LIKE '%.md' THEN 'markdown'
    WHEN h.path LIKE '%.js' THEN 'javascript' ELSE 'unknown' END AS language_name,
  h.path LIKE 'tests/%' AS is_test_file
FROM heads h LEFT JOIN agg USING (doc_id, file_seq) LEFT JOIN hs USING (doc_id, file_seq))"""


@query("file_features", f"""WITH {FEATURES_SQL}
SELECT doc_id, file_seq, lines_added, lines_deleted, hunk_count, function_declarations_added, function_declarations_deleted, class_declarations_added, class_declarations_deleted,
  imports_added, imports_deleted, max_changed_line_indent, round(CASE WHEN indent_lines > 0 THEN indent_sum / indent_lines ELSE 0 END, 6) AS avg_changed_line_indent,
  round(avg_hunk_size, 6) AS avg_hunk_size, is_test_file, language_name FROM feat""")
def file_features(t):
    out = features(t).withColumn("language_name", P.language_name(F.col("language")))
    names = ["lines_added", "lines_deleted", "hunk_count", "function_declarations_added", "function_declarations_deleted",
             "class_declarations_added", "class_declarations_deleted", "imports_added", "imports_deleted", "max_changed_line_indent",
             "avg_changed_line_indent", "avg_hunk_size", "is_test_file", "language_name"]
    return rounded(out.select(*KEYS, *names))


def change_features(t):
    """Per-change features of the diff text, end to end."""
    base = features(t).withColumn("language_name", P.language(F.col("path")))
    return X.commit_features(base, ["doc_id"], ["file_seq"])


def change_sql(source: str, group: str, seq: str, size: str = "lines_added + lines_deleted") -> str:
    names = "[" + ", ".join(f"'{x}'" for x in P.LANGUAGES) + "]"
    return f"""last_file AS (SELECT {group}, language_name, arg_max({size}, ({seq})) AS w, min(({seq})) AS f FROM {source} GROUP BY {group}, language_name),
prim AS (SELECT {group}, first(language_name ORDER BY w DESC, f) AS primary_name, count(*) AS languages_touched FROM last_file GROUP BY {group}),
g AS (SELECT {group}, sum(lines_added)::BIGINT AS lines_added, sum(lines_deleted)::BIGINT AS lines_deleted, count(*) AS files_changed,
  count(*) FILTER (status = 'added') AS files_added, count(*) FILTER (status = 'deleted') AS files_deleted, count(*) FILTER (status = 'modified') AS files_modified,
  count(*) FILTER (status = 'renamed') AS files_renamed, count(*) FILTER (status = 'binary') AS files_binary, sum(hunk_count)::BIGINT AS total_hunks,
  count(*) FILTER (is_test_file) AS test_files_changed, max({size}) AS max_file_changes,
  sum(function_declarations_added + function_declarations_deleted)::BIGINT AS total_function_declarations_changed, sum(class_declarations_added + class_declarations_deleted)::BIGINT AS total_class_declarations_changed,
  sum(imports_added + imports_deleted)::BIGINT AS total_imports_changed,
  CASE WHEN sum(indent_lines) > 0 THEN sum(indent_sum) / sum(indent_lines) ELSE 0 END AS avg_changed_line_indent, max(max_changed_line_indent) AS max_changed_line_indent
  FROM {source} GROUP BY {group}),
ent AS (SELECT {group}, -sum(CASE WHEN x > 0 THEN x / tot * log2(x / tot) ELSE 0 END) AS e
  FROM (SELECT {group}, ({size})::DOUBLE AS x, sum({size}) OVER (PARTITION BY {group})::DOUBLE AS tot FROM {source}) WHERE tot > 0 GROUP BY {group}),
change AS (SELECT g.*, lines_added + lines_deleted AS total_lines_changed, total_hunks / greatest(files_changed, 1) AS avg_hunks_per_file,
  lines_added / greatest(lines_added + lines_deleted, 1) AS additions_ratio, lines_deleted / greatest(lines_added + lines_deleted, 1) AS deletions_ratio,
  files_changed - test_files_changed AS prod_files_changed, test_files_changed / greatest(files_changed, 1) AS test_ratio, test_files_changed > 0 AS has_test_changes,
  files_changed > test_files_changed AS has_prod_changes, test_files_changed > 0 AND files_changed > test_files_changed AS test_prod_coupling, languages_touched, primary_name,
  (list_position({names}, primary_name) - 1) / 23 AS primary_language, (lines_added + lines_deleted) / greatest(files_changed, 1) AS avg_file_changes,
  coalesce(e, 0) AS change_entropy FROM g JOIN prim USING ({group}) LEFT JOIN ent USING ({group}))"""


_DOUBLES = ("avg_hunks_per_file additions_ratio deletions_ratio test_ratio primary_language "
            "avg_file_changes avg_changed_line_indent change_entropy").split()


def change_columns() -> str:
    return ", ".join(f"round({c}, 5) AS {c}" if c in _DOUBLES else c for c in X.CHANGE_VECTOR)


def _change_out(df, group):
    return rounded(df.select(group, "primary_name", *X.CHANGE_VECTOR), 5)


@query("commit_features_from_diffs", f"""WITH {FEATURES_SQL}, {change_sql('feat', 'doc_id', 'file_seq')}
SELECT doc_id, primary_name, {change_columns()} FROM change""")
def commit_features_from_diffs(t):
    return _change_out(change_features(t), "doc_id")


# files of a change by line, part and supplier; rows that repeat these are numbered
ITEM = [*SEQ, "item"]

PART_FILES_SQL = """pf AS (SELECT l_orderkey AS cid, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity, l_extendedprice, l_discount, l_tax) AS item, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
  CAST(l_quantity AS BIGINT) AS lines_added, CAST(round(l_tax * 100) AS BIGINT) AS lines_deleted, CAST(round(l_discount * 100) AS BIGINT) AS hunk_count,
  CASE CAST(round(l_tax * 100) AS BIGINT) % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' WHEN 3 THEN 'renamed' ELSE 'binary' END AS status,
  p_size % 3 = 0 AS is_test_file, CAST(l_quantity AS BIGINT) % 7 AS function_declarations_added, CAST(l_quantity AS BIGINT) % 3 AS function_declarations_deleted,
  CAST(l_quantity AS BIGINT) % 2 AS class_declarations_added, CAST(l_quantity AS BIGINT) % 4 AS class_declarations_deleted,
  CAST(l_quantity AS BIGINT) % 5 AS imports_added, CAST(l_quantity AS BIGINT) % 6 AS imports_deleted,
  CAST(l_quantity AS BIGINT) * 2 AS indent_sum, CAST(l_quantity AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT) AS indent_lines, CAST(l_quantity AS BIGINT) % 9 AS max_changed_line_indent,
  CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'STANDARD' THEN 'go' WHEN 'PROMO' THEN 'rust' WHEN 'SMALL' THEN 'java' ELSE 'unknown' END AS language_name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def part_lines(t):
    """The files with the few values that all others follow from."""
    c = F.col
    q, d = c("l_quantity").cast("long"), F.round(c("l_tax") * 100).cast("long")
    joined = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey"))
    same = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return joined.select(
        F.row_number().over(same).cast("long").alias("item"),
        c("l_orderkey").alias("cid"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"),
        q.alias("lines_added"), d.alias("lines_deleted"), F.round(c("l_discount") * 100).cast("long").alias("hunk_count"),
        (c("p_size") % 3 == 0).alias("is_test_file"),
        part_language().alias("language_name"),
    )


def part_language():
    c = F.col("p_type")
    return F.when(c == "ECONOMY", "python").when(c == "STANDARD", "go").when(c == "PROMO", "rust").when(c == "SMALL", "java").otherwise("unknown")


def file_status():
    d = F.col("lines_deleted")
    return F.when(d % 5 == 0, "added").when(d % 5 == 1, "deleted").when(d % 5 == 2, "modified").when(d % 5 == 3, "renamed").otherwise("binary")


def with_counts(lines):
    q, d = F.col("lines_added"), F.col("lines_deleted")
    return lines.withColumns({
        "status": file_status(), "function_declarations_added": q % 7, "function_declarations_deleted": q % 3,
        "class_declarations_added": q % 2, "class_declarations_deleted": q % 4, "imports_added": q % 5, "imports_deleted": q % 6,
        "indent_sum": q * 2, "indent_lines": q + d, "max_changed_line_indent": q % 9,
    })


def part_files(t):
    return with_counts(part_lines(t))


@query("commit_features", f"""WITH {PART_FILES_SQL}, {change_sql('pf', 'cid', 'line, part, supp, item')}
SELECT cid, primary_name, {change_columns()} FROM change""")
def commit_features(t):
    return _change_out(X.commit_features(part_files(t), ["cid"], ITEM), "cid")


@query("diff_stats", f"""WITH {PART_FILES_SQL} SELECT cid, count(*) AS total_files, sum(lines_added)::BIGINT AS total_lines_added,
  sum(lines_deleted)::BIGINT AS total_lines_deleted, {', '.join(f"count(*) FILTER (status = '{s}') AS files_{s}" for s in ('added', 'deleted', 'modified', 'renamed', 'binary'))}
FROM pf GROUP BY cid""")
def diff_stats(t):
    return D.diff_stats(part_files(t), ["cid"])


_VECTOR_SQL = ", ".join(f"({c})::DOUBLE" for c in X.CHANGE_VECTOR)


@query("commit_vector", f"""WITH {PART_FILES_SQL}, {change_sql('pf', 'cid', 'line, part, supp, item')},
v AS (SELECT cid, [{_VECTOR_SQL}] AS vec FROM change)
SELECT cid, len(vec) AS dims, round(list_sum(vec), 4) AS total, round(list_sum([x * i for x, i in vec]), 3) AS weighted FROM v""")
def commit_vector(t):
    df = X.commit_features(part_files(t), ["cid"], ITEM)
    out = df.select("cid", D.vector(X.CHANGE_VECTOR).alias("vec"))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "cid", F.size("vec").alias("dims"), F.round(add("vec"), 4).alias("total"),
        F.round(add(F.transform("vec", lambda x, i: x * (i + 1))), 3).alias("weighted"),
    )


_LANGUAGE_LIST = "[" + ", ".join(f"'{x}'" for x in P.LANGUAGES) + "]"


@query("file_vector", f"""WITH {FEATURES_SQL}, v AS (SELECT doc_id, file_seq, [((list_position({_LANGUAGE_LIST}, language_name) - 1) / 23)::DOUBLE, is_binary::INT, is_test_file::INT, lines_added, lines_deleted,
 lines_added + lines_deleted, hunk_count, function_declarations_added, function_declarations_deleted, class_declarations_added, class_declarations_deleted, imports_added, imports_deleted,
 CASE WHEN indent_lines > 0 THEN indent_sum / indent_lines ELSE 0 END, max_changed_line_indent, avg_hunk_size] AS vec FROM feat)
SELECT doc_id, file_seq, len(vec) AS dims, round(list_sum([x * i for x, i in vec]), 3) AS weighted FROM v""")
def file_vector(t):
    out = features(t).select(*KEYS, D.vector(D.FILE_VECTOR).alias("vec"))
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select(*KEYS, F.size("vec").alias("dims"), F.round(weighted, 3).alias("weighted"))


@query("commit_mean_features", """WITH d AS (SELECT label, len(embedding) AS n, embedding FROM embeddings),
e AS (SELECT label, unnest(range(n)) AS i, unnest(embedding)::DOUBLE AS x FROM d)
SELECT label, i AS dim, round(avg(x), 6) AS mean FROM e GROUP BY label, i""")
def commit_mean_features(t):
    size = len(t.embeddings.first()["embedding"])
    out = X.mean_vector(
        t.embeddings.withColumn("v", F.col("embedding").cast("array<double>")), ["label"], "v", size
    )
    return rounded(out.select("label", F.posexplode("mean").alias("dim", "mean")))
