"""Labels of changes from later evidence, and time ordered splits.

Changes are rows with repository columns ``repo``, ``sha``, ``pos`` (linear
position within the repository), ``message`` and, where needed, ``ts``,
``n_files`` and ``is_fix``. Everything runs per repository key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchsieve.functions import messages as M
from patchsieve.operators.attribution import ranges_with_line
from patchsieve.operators.frames import beside, frame, number_rows, reused, written
from patchsieve.operators.history import DAY, micros

# fixed values: thresholds of the label rules
EXCLUDE_FILES = 20
OVERLAP_FILES = 5
OVERLAP_LINES = 200
LOOKBACK = 100
WINDOW_CHANGES = 200
WINDOW_DAYS = 90
# fixed values: shares of the time ordered split
TRAIN_SHARE = 0.7
VALIDATION_SHARE = 0.15

_BUCKET = 7  # shortest id that counts as a reference


def said(message: Column) -> dict[str, Column]:
    """What the rules read off a message: the ids it names, its title and the title a revert quotes, these as digests.

    Changes may carry these columns in place of ``message``, so that they are shuffled without it.
    """
    digest = lambda text: F.md5(text.cast("binary"))
    return {
        "tokens": F.array_distinct(M.hex_refs(message)), "is_revert": M.is_revert(message),
        "title": digest(F.nullif(M.stripped(message), F.lit(""))), "quoted": F.when(M.is_revert(message), digest(M.revert_quote(message))),
    }


def _read(changes: DataFrame) -> DataFrame:
    return changes.withColumns(said(F.col("message"))).drop("message") if "message" in changes.columns else changes


def resolve_refs(messages: DataFrame, known: DataFrame, repo: list[str], exclude_self: bool = False) -> DataFrame:
    """The one known change a message refers to: (repo, sha, resolved).

    A hex run is an exact id, a 12 character prefix (last change with it wins), or
    a prefix of exactly one id. One run with several hits, or two different hits,
    make the message resolve to nothing. Runs are looked up once each, bucketed
    by their first 7 characters, so a run that everybody quotes costs one lookup.
    With ``exclude_self`` a change does not find itself, except by 12 characters.
    """
    tokens = reused(_read(messages).select(*repo, "sha", F.explode("tokens").alias("token")))
    ids = known.select(*repo, F.col("sha").alias("id"), "pos", F.substring("sha", 1, _BUCKET).alias("__b"))
    asked = tokens.select(*repo, "token").distinct().withColumn("__b", F.substring("token", 1, _BUCKET))
    found = (
        asked.join(ids, [*repo, "__b"]).where(F.startswith("id", F.col("token")))
        .groupBy(*repo, "token")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"),
             F.max_by("id", F.struct("pos", "id")).alias("newest"))
    )
    own = F.startswith("sha", F.col("token")) if exclude_self else F.lit(False)
    n = F.col("n") - own.cast("int")
    other = F.when(own & (F.col("low") == F.col("sha")), F.col("high")).otherwise(F.col("low"))
    by_index = F.length("token") == 12
    judged = tokens.join(found, [*repo, "token"]).select(
        *repo, "sha",
        F.when(by_index, F.col("newest")).when(n == 1, other).alias("hit"),
        (~by_index & (n > 1)).alias("unclear"),
    )
    return (
        judged.groupBy(*repo, "sha")
        .agg(F.min("hit").alias("low"), F.max("hit").alias("high"), F.max("unclear").alias("unclear"))
        .where(~F.col("unclear") & (F.col("low") == F.col("high")))
        .select(*repo, "sha", F.col("low").alias("resolved"))
    )


def resolve_prefix(asked: DataFrame, known: DataFrame, repo: list[str], prefix: str, width: int = 8) -> DataFrame:
    """The id with a prefix if there is exactly one: (repo, prefix, resolved)."""
    ids = known.select(*repo, F.col("sha").alias("id")).distinct().withColumn("__b", F.substring("id", 1, width))
    want = asked.select(*repo, prefix).where(F.col(prefix).isNotNull()).distinct()
    hits = want.withColumn("__b", F.substring(prefix, 1, width)).join(ids, [*repo, "__b"]).where(
        F.startswith("id", F.col(prefix))
    )
    counted = hits.groupBy(*repo, prefix).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("resolved"))
    return counted.where(F.col("n") == 1).drop("n")


def revert_map(changes: DataFrame, repo: list[str]) -> DataFrame:
    """(repo, reverted, reverting): by reference first, else by quoted title; the last revert wins."""
    changes = _read(changes)
    reverts = changes.where("is_revert").select(*repo, "sha", "pos", "tokens", "quoted")
    refs = resolve_refs(reverts, changes, repo)
    seen = reverts.drop("tokens").join(refs, [*repo, "sha"], "left")
    titles = (
        changes.select(*repo, "sha", "pos", "title").where(F.col("title").isNotNull())
        .groupBy(*repo, "title").agg(F.max_by("sha", "pos").alias("titled"))
    )
    quoted = seen.withColumn("title", F.when(F.col("resolved").isNull(), F.col("quoted"))).join(titles, [*repo, "title"], "left")
    target = F.coalesce("resolved", "titled")
    return (
        quoted.withColumn("reverted", target).where(F.col("reverted").isNotNull())
        .groupBy(*repo, "reverted").agg(F.max_by("sha", "pos").alias("reverting"))
    )


def active_fixes(changes: DataFrame, limit: int = EXCLUDE_FILES) -> DataFrame:
    """Fixes that touch too many files count for nothing."""
    return changes.where(F.col("is_fix") & (F.col("n_files") <= limit))


def explicit_attribution(changes: DataFrame, repo: list[str]) -> DataFrame:
    """(repo, sha, cause): changes named by an active fix; the first such fix is told."""
    fixes = active_fixes(changes)
    refs = resolve_refs(fixes, changes, repo, exclude_self=True)
    named = refs.join(fixes.select(*repo, "sha", "pos"), [*repo, "sha"]).where(F.col("resolved") != F.col("sha"))
    return named.groupBy(*repo, F.col("resolved").alias("__s")).agg(F.min_by("sha", "pos").alias("cause")).withColumnRenamed("__s", "sha")


def revert_attribution(changes: DataFrame, repo: list[str], explicit: DataFrame) -> DataFrame:
    """(repo, sha, cause): reverted changes that no fix names."""
    reverted = revert_map(changes, repo).select(*repo, F.col("reverted").alias("sha"), F.col("reverting").alias("cause"))
    return reverted.join(explicit, [*repo, "sha"], "left_anti")


def line_overlap_attribution(
    hunks: DataFrame, fixes: DataFrame, added: DataFrame, parent: DataFrame | Callable[[DataFrame], DataFrame],
    positive: DataFrame, repo: list[str], lookback: int = LOOKBACK,
) -> DataFrame:
    """(repo, sha, path, cause): files whose lines a small later fix puts back.

    ``hunks``   repo, sha, pos, path, hunk, old_start, old_count
    ``fixes``   repo, sha, n_files, n_lines (active fixes)
    ``added``   repo, sha, path, hunk, at, text: added lines at their old-file line
    ``parent``  repo, sha, path, line_no, text: the file before the change; or a function that gives these
                lines for a table of (repo, sha, path), so that no line of a file without a pair is shuffled

    The fix lies within ``lookback`` positions after the candidate, touches the
    same path, both hunks overlap (half open), and every line it adds inside the
    overlap (ends included) stands in the candidate's parent there. Positions are
    bucketed by the lookback, so a path that everyone touches still joins in
    pieces of at most two buckets. Lines are known by a digest and looked up in one
    ordered pass per file and digest. Pairs are numbered and written once, and only
    their numbers go through that pass.
    """
    small = fixes.where((F.col("n_files") <= OVERLAP_FILES) & (F.col("n_lines") <= OVERLAP_LINES))
    end = F.col("old_start") + F.col("old_count")
    fix = hunks.join(small.select(*repo, "sha"), [*repo, "sha"], "left_semi").select(
        *repo, "path", F.col("sha").alias("fix"), F.col("pos").alias("fix_pos"), F.col("hunk").alias("fix_hunk"),
        F.col("old_start").alias("f_start"), end.alias("f_end"),
    )
    bucket = lambda p: F.floor(p / lookback)
    probes = fix.withColumn("__b", F.explode(F.array_distinct(F.array(
        bucket(F.col("fix_pos") - 1), bucket(F.col("fix_pos") - lookback)
    ))))
    candidates = hunks.join(positive, [*repo, "sha"], "left_anti").select(
        *repo, "path", "sha", "pos", F.col("hunk").alias("c_hunk"), F.col("old_start").alias("c_start"),
        end.alias("c_end"), bucket(F.col("pos")).alias("__b"),
    )
    pairs = written(probes.join(candidates, [*repo, "path", "__b"]).where(
        F.col("pos").between(F.col("fix_pos") - lookback, F.col("fix_pos") - 1)
        & (F.col("c_start") < F.col("f_end")) & (F.col("f_start") < F.col("c_end"))
    ).select(
        *repo, "path", "sha", "c_hunk", "fix", "fix_pos", "fix_hunk", F.monotonically_increasing_id().alias("name"),
        F.greatest("c_start", "f_start").alias("s"), F.least("c_end", "f_end").alias("e"),
    ), "pairs")
    digest = lambda c: F.unhex(F.md5(F.regexp_replace(c, r"[\r\n]+\z", "")))
    put = added.select(
        *repo, "path", F.col("sha").alias("fix"), F.col("hunk").alias("fix_hunk"), "at", digest(F.col("text")).alias("__digest")
    )
    # a text counts once for a pair, however often the fix adds it
    lines = pairs.join(put, [*repo, "path", "fix", "fix_hunk"]).where(
        F.col("at").between(F.col("s"), F.col("e")) & F.col("__digest").isNotNull()
    ).select(
        *repo, "sha", "path", "fix", "fix_hunk", "name", "s", "e", "__digest").distinct()
    # the nearest line of that text from the start on decides; lines with a text that is everywhere are not paired
    key = [*repo, "sha", "path", "__digest"]
    wanted = pairs.select(*repo, "sha", "path").distinct()
    found = parent(wanted) if callable(parent) else parent.join(wanted, [*repo, "sha", "path"], "left_semi")
    before = found.select(*repo, "sha", "path", digest(F.col("text")).alias("__digest"), F.col("line_no").alias("line"))
    held = ranges_with_line(lines.select(*key, "name", F.col("s").alias("start"), F.col("e").alias("end")), before, key)
    per_row = held.groupBy("name").agg(F.min(F.col("hit").cast("int")).alias("__in"))
    per_pair = pairs.join(per_row, "name").groupBy(*repo, "path", "sha", "c_hunk", "fix", "fix_pos", "fix_hunk").agg(F.min("__in").alias("__in"))
    return per_pair.where(F.col("__in") > 0).groupBy(*repo, "sha", "path").agg(F.min_by("fix", "fix_pos").alias("cause"))


def ambiguous_evidence(
    files: DataFrame, changes: DataFrame, repo: list[str],
    window: int = WINDOW_CHANGES, days: int = WINDOW_DAYS,
) -> DataFrame:
    """(repo, pos): changes that a later fix meets on a path within the window.

    ``files``    repo, pos, path, is_fix (active fixes)
    ``changes``  repo, pos, ts; positions count the changes of a repository

    The scan forward ends at the first later change that is more than ``days``
    whole days younger; unknown times never end it. Only the nearest fix on a
    path matters. It is found in one ordered pass per path. If no time up to the
    fix reaches the cut-off, the scan gets there; if the fix itself is past the
    cut-off, it does not. Only changes in between, whose clocks run unevenly, are
    compared with the changes on the way, at most ``window`` each.
    """
    once = files.groupBy(*repo, "path", "pos").agg(F.max("is_fix").alias("is_fix"))
    nearest = frame(
        once, [*repo, "path"], [-F.col("pos")], lasts={"fix": F.when(F.col("is_fix"), F.col("pos"))}
    )
    # two compact tables, a few numbers for each change, so that the plans of what follows stay small
    first = reused(nearest.groupBy(*repo, "pos").agg(F.min("fix").alias("fix")).where(
        F.col("fix") - F.col("pos") <= window
    ))
    timed = reused(frame(
        changes.select(*repo, "pos", "ts"), repo, [F.col("pos")],
        maxes={"__latest": micros(F.col("ts"))}, inclusive=True,
    ).withColumn("__us", micros(F.col("ts"))))
    at_fix = timed.select(
        *repo, F.col("pos").alias("fix"), F.col("__us").alias("__fix_us"), F.col("__latest").alias("__fix_latest")
    )
    probes = first.join(timed.select(*repo, "pos", "__us"), [*repo, "pos"]).join(at_fix, [*repo, "fix"])
    cut = F.col("__us") + F.lit((days + 1) * DAY * 1_000_000).cast("long")
    probes = probes.withColumn("__cut", cut)
    reached = F.col("__cut").isNull() | F.col("__fix_latest").isNull() | (F.col("__fix_latest") < F.col("__cut"))
    past = F.col("__fix_us") >= F.col("__cut")
    sure = probes.where(reached).select(*repo, "pos")
    unsure = probes.where(~reached & ~F.coalesce(past, F.lit(False)))
    way = unsure.select(*repo, "pos", "__cut", F.explode(F.sequence(F.col("pos") + 1, F.col("fix"))).alias("__q"))
    stops = way.join(
        timed.select(*repo, F.col("pos").alias("__q"), F.col("__us").alias("__q_us")), [*repo, "__q"]
    ).where(F.col("__q_us") >= F.col("__cut")).select(*repo, "pos").distinct()
    return sure.unionByName(unsure.select(*repo, "pos").join(stops, [*repo, "pos"], "left_anti"))


def merge_labels(
    files: DataFrame, changes: DataFrame, repo: list[str],
    explicit: DataFrame, reverted: DataFrame, overlap: DataFrame, ambiguous: DataFrame,
) -> DataFrame:
    """One label per file: named > reverted > line overlap > ambiguous > negative.

    A file with a line overlap record of its own keeps it, unless its change is
    labelled for certain; the other files take the label of their change.
    """
    key = [*repo, "sha"]
    some = overlap.groupBy(*key).agg(F.count(F.lit(1)).alias("n_overlap"))
    per_change = (
        changes.select(*key, "pos")
        .join(explicit.select(*key, F.col("cause").alias("e_by")), key, "left")
        .join(reverted.select(*key, F.col("cause").alias("r_by")), key, "left")
        .join(some, key, "left")
        .join(ambiguous.select(*repo, "pos", F.lit(True).alias("amb")), [*repo, "pos"], "left")
    )
    source = (
        F.when(F.col("e_by").isNotNull(), "explicit_sha_reference").when(F.col("r_by").isNotNull(), "revert")
        .when(F.col("n_overlap") > 0, "line_overlap").when(F.col("amb"), "ambiguous").otherwise("none")
    )
    per_change = per_change.select(*key, source.alias("c_source"), F.coalesce("e_by", "r_by").alias("c_by"))
    own = overlap.select(*key, "path", F.col("cause").alias("f_by"))
    joined = files.select(*key, "path").join(per_change, key).join(own, [*key, "path"], "left")
    sure = F.col("c_source").isin("explicit_sha_reference", "revert")
    label_source = F.when(F.col("f_by").isNotNull() & ~sure, "line_overlap").otherwise(F.col("c_source"))
    s = F.col("label_source")
    return joined.withColumn("label_source", label_source).select(
        *key, "path", "label_source",
        F.when(s == "none", "negative").when(s == "ambiguous", "ambiguous").otherwise("positive").alias("label_status"),
        F.when(s == "none", 0).when(s == "ambiguous", -1).otherwise(1).alias("defect_label"),
        F.when(sure, 1.0).when(s == "line_overlap", 0.7).otherwise(0.0).alias("label_confidence"),
        F.when(sure, F.col("c_by")).when(s == "line_overlap", F.col("f_by")).alias("cause"),
    )


def _split_name(index: Column, n: Column, train: float, validation: float) -> Column:
    first = F.floor(n * F.lit(train))
    second = first + F.floor(n * F.lit(validation))
    return F.when(index < first, "train").when(index < second, "validation").otherwise("test")


def chrono_split(
    changes: DataFrame, order: list[str], by: list[str] | None = None,
    train: float = TRAIN_SHARE, validation: float = VALIDATION_SHARE,
) -> DataFrame:
    """Split by position in time; the shares are rounded down, the rest is test."""
    by = by or []
    if by:
        placed = frame(changes, by, [F.col(c) for c in order], row="__r", totals={"__n": F.lit(1).cast("long")})
    else:
        # whole table: the size comes from its own aggregate, not from a window
        counted = changes.agg(F.count(F.lit(1)).alias("__n"))
        placed = beside(number_rows(changes, [], [F.col(c) for c in order], "__r"), counted)
    return placed.withColumn(
        "split", _split_name(F.col("__r") - 1, F.col("__n"), train, validation)
    ).drop("__r", "__n")


def global_chrono_split(changes: DataFrame, ts: str, repo: str, sha: str) -> DataFrame:
    """One split over all repositories by (time, repository, id), unknown times first."""
    return chrono_split(changes, [ts, repo, sha])


def split_by_lookup(rows: DataFrame, manifest: DataFrame, repo: str) -> DataFrame:
    """Split from a repository table; a repository without an entry is an error."""
    known = rows.join(manifest.select(repo, "split"), repo, "left")
    missing = F.concat(F.lit("no split for repository "), F.col(repo).cast("string"))
    return known.withColumn(
        "split", F.when(F.col("split").isNull(), F.raise_error(missing).cast("string")).otherwise(F.col("split"))
    )
