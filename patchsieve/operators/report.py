"""The attribution report: what ties the files of a change to the change that corrects it.

Everything known of a file of a change (its texts, its changed regions, its functions) is brought into one
row by a single grouping, for the changes that are asked about and their corrections alone. A candidate
file then meets its corrective file in one join, and all evidence (restoration, removed lines, regions,
functions) is said by column functions on that row, without another exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchsieve.functions import lines as L
from patchsieve.functions import messages as M
from patchsieve.operators import attribution as A
from patchsieve.operators.frames import reused
from patchsieve.operators.labels import resolve_prefix

_SPANS = "array<struct<start:bigint,stop:bigint>>"
_FUNCTIONS = "array<struct<name:string,start:bigint,stop:bigint>>"


def corrective_links(positives: DataFrame, known: DataFrame) -> DataFrame:
    """(sha, prefix, corrective, label_source): the id prefix in the evidence, and the one id it stands for.

    ``positives``  sha, label_source, label_evidence      ``known``  sha
    """
    asked = positives.select("sha", "label_source", M.fix_prefix(F.col("label_evidence")).alias("prefix"))
    found = resolve_prefix(asked, known, [], "prefix").withColumnRenamed("resolved", "corrective")
    return asked.join(found, "prefix", "left").select("sha", "prefix", "corrective", "label_source")


def file_sides(shas: DataFrame, contents: DataFrame, hunks: DataFrame, functions: DataFrame) -> DataFrame:
    """(sha, path, before, after, spans, functions): one row per file of the changes in ``shas``.

    ``contents``  sha, path, before, after (null where the file does not exist)
    ``hunks``     sha, path, new_start, new_count
    ``functions`` sha, path, name, start, end in the after text, names unique within a file
    """
    long = lambda c: F.col(c).cast("long")
    texts = contents.select("sha", "path", F.struct("before", "after").alias("text"))
    spans = hunks.where("new_count > 0").select(
        "sha", "path", F.struct(long("new_start").alias("start"), (long("new_start") + long("new_count")).alias("stop")).alias("span"))
    named = functions.select("sha", "path", F.struct("name", long("start").alias("start"), long("end").alias("stop")).alias("function"))
    rows = texts.unionByName(spans, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)
    return rows.join(shas, "sha", "left_semi").groupBy("sha", "path").agg(
        F.first("text", ignorenulls=True).alias("text"), F.collect_list("span").alias("spans"), F.collect_list("function").alias("functions")
    ).select("sha", "path", "text.before", "text.after", F.col("spans").cast(_SPANS).alias("spans"), F.col("functions").cast(_FUNCTIONS).alias("functions"))


def shared_lines(ours: Column, theirs: Column) -> Column:
    """Lines in spans of both sides, as (lines, first, last): one pass over the ordered starts and ends.

    Spans of a side may overlap; a line counts once. The work follows the spans, not their lines.
    """
    def events(spans: Column, field: str, step: int, mine: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s[field].alias("at"), F.lit(step if mine else 0).alias("c"), F.lit(0 if mine else step).alias("r")))

    ordered = F.array_sort(F.concat(events(ours, "start", 1, True), events(ours, "stop", -1, True), events(theirs, "start", 1, False), events(theirs, "stop", -1, False)))
    nothing = F.lit(None).cast("long")
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("r"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("lines"),
                    nothing.alias("first"), nothing.alias("last"))

    def step(s: Column, e: Column) -> Column:
        both = (s["c"] > 0) & (s["r"] > 0) & (e["at"] > s["at"])
        return F.struct(
            (s["c"] + e["c"]).alias("c"), (s["r"] + e["r"]).alias("r"), e["at"].alias("at"),
            (s["lines"] + F.when(both, e["at"] - s["at"]).otherwise(F.lit(0).cast("long"))).alias("lines"),
            F.coalesce(s["first"], F.when(both, s["at"])).alias("first"), F.when(both, e["at"] - 1).otherwise(s["last"]).alias("last"))

    return F.aggregate(ordered, zero, step, lambda s: F.struct(s["lines"].alias("lines"), s["first"].alias("first"), s["last"].alias("last")))


def _functions_with(functions: Column, lines: Column, wanted: Column) -> Column:
    """Sorted names of the functions that have one of the wanted lines."""
    last = lambda f: F.least(f["stop"], F.size(lines).cast("long"))
    body = lambda f: F.slice(lines, f["start"].cast("int"), F.greatest(last(f) - f["start"] + 1, F.lit(0)).cast("int"))
    return F.array_sort(F.transform(F.filter(functions, lambda f: F.arrays_overlap(body(f), wanted)), lambda f: f["name"]))


def _names(functions: Column) -> Column:
    return F.transform(functions, lambda f: f["name"])


def _normal(text: Column) -> Column:
    return F.transform(L.text_lines(text), L.normalize_line)


def file_evidence(pairs: DataFrame, sides: DataFrame, pair_partially: bool = True) -> DataFrame:
    """All evidence of candidate files that have a corrective file.

    ``pairs``  sha, path, corrective, corrective_path      ``sides``  see ``file_sides``
    """
    def side(mark: str, sha: str, path: str) -> DataFrame:
        return sides.select(F.col("sha").alias(sha), F.col("path").alias(path), *[F.col(c).alias(f"{mark}_{c}") for c in ("before", "after", "spans", "functions")])

    joined = pairs.join(side("c", "sha", "path"), ["sha", "path"], "left").join(side("r", "corrective", "corrective_path"), ["corrective", "corrective_path"], "left")
    for mark in "cr":
        joined = joined.withColumn(f"{mark}_was", _normal(F.col(f"{mark}_before"))).withColumn(f"{mark}_now", _normal(F.col(f"{mark}_after")))
    fresh = lambda new, old: F.coalesce(F.array_sort(F.array_except(F.array_distinct(new), F.array_distinct(old))), F.array().cast("array<string>"))
    c = F.col
    out = joined.withColumn("introduced", fresh(c("c_now"), c("c_was"))).withColumn("removed", fresh(c("r_was"), c("r_now")))
    out = A.content_correspondence(out, "introduced", "removed", pair_partially)
    out = A.restoration_of(out, c("c_was"), c("r_now"))
    spans = lambda x: F.coalesce(c(x), F.array().cast(_SPANS))
    out = out.withColumn("region", shared_lines(spans("c_spans"), spans("r_spans")))
    parsed = c("c_now").isNotNull() & c("r_now").isNotNull() & (F.size("c_functions") > 0) & (F.size("r_functions") > 0)
    out = out.withColumn("parsed", F.coalesce(parsed, F.lit(False)))
    out = out.withColumn("c_touched", F.when(c("parsed"), _functions_with(c("c_functions"), c("c_now"), c("introduced"))))
    out = out.withColumn("r_touched", F.when(c("parsed"), _functions_with(c("r_functions"), c("r_now"), c("removed"))))
    common = F.array_min(F.array_intersect("c_touched", "r_touched"))
    named = F.array_min(F.array_intersect(_names(c("c_functions")), _names(c("r_functions"))))
    out = out.withColumn("function_name", F.when(c("parsed"), F.coalesce(common, named)))
    inside = F.coalesce(F.array_contains("c_touched", c("function_name")), F.lit(False))
    return out.select(
        "sha", "path", "exact_match_count", "partial_match_count", "correspondence_exists", "correspondence_type", "exact_match_ratio",
        "partial_match_ratio", "restored", "line_diff_count", "similarity_ratio", c("region.lines").alias("overlap_lines"),
        c("region.first").alias("overlap_start"), c("region.last").alias("overlap_end"), (c("region.lines") > 0).alias("overlap_exists"),
        "function_name", c("function_name").isNotNull().alias("same_function"), inside.alias("structural_relationship"),
    )


def rationale() -> Column:
    """Why a file has its level, in words."""
    # fixed values: the texts of the rationale
    c = F.col
    content = F.when(c("correspondence_exists"), F.format_string("content correspondence (%d exact, %d partial)", "exact_match_count", "partial_match_count"))
    region = F.when(c("overlap_exists"), F.format_string("region overlap (%d lines)", "overlap_lines"))
    function = F.when(c("structural_relationship"), F.format_string("same function (%s)", "function_name"))
    return (
        F.when(c("method") == "none", "File identity not established")
        .when(~c("listed"), F.concat(F.lit("File "), c("path"), F.lit(" not in corrective commit "), c("corrective"), F.lit(" file list")))
        .when((c("level") == A.STRONG) & c("restored"), "Corrective restored parent-of-C content (exact)")
        .when(c("level") == A.STRONG, F.format_string("Exact candidate-content removal: %d lines matched", "exact_match_count"))
        .when(c("level") == A.MODERATE, F.concat_ws(" + ", content, region, function))
        .otherwise("Path overlap or file association only")
    )


def file_report(
    links: DataFrame, diff_files: DataFrame, listed: DataFrame, contents: DataFrame, hunks: DataFrame, functions: DataFrame,
    pair_partially: bool = True,
) -> DataFrame:
    """One row per file of every change in ``links``: identity, evidence, level, types and rationale.

    ``links``       see ``corrective_links``
    ``diff_files``  sha, path, old_path, seq: files as the diffs tell them
    ``listed``      sha, path: files as the examples tell them
    The other tables are those of ``file_sides``. A file without an identity, and one whose corrective file
    is not in the list of its change, is UNKNOWN and has no evidence; the identity found is kept.
    """
    # a change is asked about with the files that the examples list
    asked = links.select("sha", "corrective").join(listed.select("sha", "path").distinct(), "sha")
    identity = A.file_identity(links, diff_files).join(links.select("sha", "corrective"), "sha")
    theirs = listed.select(F.col("sha").alias("corrective"), F.col("path").alias("corrective_path"), F.lit(True).alias("listed")).distinct()
    known = asked.join(identity.drop("corrective"), ["sha", "path"], "left").join(theirs, ["corrective", "corrective_path"], "left").select(
        "sha", "path", "corrective", F.coalesce("method", F.lit("none")).alias("method"), "corrective_path", F.coalesce("listed", F.lit(False)).alias("listed"))
    known = reused(known)
    pairs = known.where("listed").select("sha", "path", "corrective", "corrective_path")
    shas = pairs.select("sha").union(pairs.select("corrective")).distinct()
    evidence = file_evidence(pairs, reused(file_sides(shas, contents, hunks, functions)), pair_partially)
    out = known.join(evidence, ["sha", "path"], "left")
    # where there is no evidence the flags are false, so that types are empty and the level is unknown
    flags = ["correspondence_exists", "restored", "overlap_exists", "same_function", "structural_relationship"]
    for flag in flags:
        out = out.withColumn(flag, F.coalesce(flag, F.lit(False)))
    level = F.when(~F.col("listed"), A.UNKNOWN).otherwise(A.evidence_level())
    out = out.withColumn("level", level).withColumn("evidence_types", A.evidence_types())
    return out.withColumn("rationale", rationale())


def change_report(links: DataFrame, listed: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """One row per change in ``links``: levels, path overlap, reference chain and context signals.

    ``listed``   sha, path, status, test_flag      ``vectors``  sha, vector of ``size`` values
    All parts are grouped by the change, so their join moves nothing that is not moved already.
    """
    overlap = A.path_overlap(links, listed)
    levels = A.commit_evidence_level(overlap).select(
        "sha", "prefix", "corrective", "candidate_files", "corrective_files", "overlap_files", "category", "commit_evidence_level", "file_evidence_level")
    chain = A.reference_chain(links).select("sha", F.col("depth").alias("chain_depth"), F.col("terminates").alias("chain_terminates"), F.col("final_sha").alias("chain_end"))
    parts = [chain, A.status_pattern(links, listed), A.feature_proximity(links, vectors, size).drop("available"),
             A.test_separation(listed), A.exclusivity(overlap).drop("available")]
    out = levels.join(links.select("sha", "label_source"), "sha")
    for part in parts:
        out = out.join(part, "sha", "left")
    return out


def nested_report(changes: DataFrame, files: DataFrame) -> DataFrame:
    """The change rows with their file rows as an array in path order, and the paths left unknown."""
    columns = ["path"] + [c for c in files.columns if c not in ("sha", "path", "corrective")]
    per = files.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("file_results"))
    unknown = F.transform(F.filter("file_results", lambda f: f["level"] == A.UNKNOWN), lambda f: f["path"])
    return changes.join(per, "sha", "left").withColumn("unknown_files", unknown)
