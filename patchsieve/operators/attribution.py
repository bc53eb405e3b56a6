"""How a change and the change that corrects it relate, file by file.

``links`` holds one row per candidate change: ``sha``, ``prefix`` (the id prefix
its evidence names, or null) and ``corrective`` (the resolved id, or null).
``files`` holds ``sha``, ``path`` and ``seq`` (order within the change). Paths of
both sides meet through equi joins, never through collected sets.
"""

from __future__ import annotations

from collections import Counter
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchsieve.functions import lines as L
from patchsieve.functions import messages as M
from patchsieve.functions import paths as P
from patchsieve.operators.features import mean_vector
from patchsieve.operators.frames import frame, written
from patchsieve.operators.metrics import share

# fixed values: levels and categories
STRONG, MODERATE, WEAK, UNKNOWN = "FILE_STRONG", "FILE_MODERATE", "FILE_WEAK", "UNKNOWN"
COMMIT_STRONG, COMMIT_WEAK, COMMIT_NONE = "COMMIT_STRONG", "COMMIT_WEAK", "COMMIT_NONE"
PARTIAL, COMMIT_ONLY, NO_ATTRIBUTION = "FILE_PARTIAL", "COMMIT_ONLY", "NO_ATTRIBUTION"
TOKEN_SHARE = 0.3  # partial line matches must be above this


# ---- paths of both sides ----------------------------------------------------


def candidate_paths(links: DataFrame, files: DataFrame) -> DataFrame:
    """(sha, corrective, path, shared): distinct candidate paths and if the corrective change has them."""
    paths = files.select("sha", "path").distinct()
    mine = links.select("sha", "corrective").join(paths, "sha")
    theirs = paths.select(F.col("sha").alias("corrective"), "path", F.lit(True).alias("shared"))
    return mine.join(theirs, ["corrective", "path"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def corrective_controls(links: DataFrame, files: DataFrame) -> DataFrame:
    """Every file of the corrective change as a control row."""
    paths = files.select(F.col("sha").alias("corrective"), "path").distinct()
    return links.where(F.col("corrective").isNotNull()).select("sha", "corrective").join(paths, "corrective")


def candidate_negatives(links: DataFrame, files: DataFrame) -> DataFrame:
    """Corrective files that are not candidate files. They stay candidates, never labels."""
    mine = files.select("sha", "path").distinct()
    return corrective_controls(links, files).join(mine, ["sha", "path"], "left_anti").select(
        "sha", "path", F.lit("unaffected_in_corrective").alias("strategy"),
        F.lit("CANDIDATE_NEGATIVE").alias("status"),
    )


def path_overlap(links: DataFrame, files: DataFrame, missing: str = NO_ATTRIBUTION) -> DataFrame:
    """One row per candidate change: path counts and overlap category.

    No overlap and full overlap are both COMMIT_ONLY, a part is FILE_PARTIAL.
    ``missing`` is told for changes without a corrective change (the later
    variant of the rule says COMMIT_ONLY there).
    """
    mine = candidate_paths(links, files).groupBy("sha").agg(
        F.count(F.lit(1)).alias("candidate_files"), F.count_if("shared").alias("overlap_files")
    )
    # the files of a corrective change are counted once, however many changes it corrects
    sizes = files.groupBy(F.col("sha").alias("corrective")).agg(F.count_distinct("path").alias("__files"))
    theirs = links.where(F.col("corrective").isNotNull()).select("sha", "corrective").join(sizes, "corrective").groupBy("sha").agg(
        F.sum("__files").alias("corrective_files"))
    zero = F.lit(0).cast("long")
    out = links.join(mine, "sha").join(theirs, "sha", "left").withColumn(
        "corrective_files", F.coalesce("corrective_files", zero)
    )
    part = (F.col("overlap_files") > 0) & (F.col("overlap_files") < F.col("candidate_files"))
    return out.select(
        "sha", "prefix", "corrective", "candidate_files", "corrective_files", "overlap_files",
        (F.col("candidate_files") - F.col("overlap_files")).alias("unknown_files"),
        F.when(F.col("corrective_files") == 0, missing).when(part, PARTIAL).otherwise(COMMIT_ONLY).alias("category"),
    )


def path_transforms(links: DataFrame, files: DataFrame) -> DataFrame:
    """Corrective files with the name, but not the path, of a candidate file.

    If candidate files share a name, the last one in path order stands for it.
    """
    named = files.select("sha", "path").distinct().withColumn("name", P.basename(F.col("path")))
    last = named.groupBy("sha", "name").agg(F.max("path").alias("candidate_path"))
    theirs = corrective_controls(links, files).withColumn("name", P.basename(F.col("path")))
    return theirs.join(last, ["sha", "name"]).where(F.col("path") != F.col("candidate_path")).select(
        "sha", "corrective", "name", "candidate_path", F.col("path").alias("corrective_path")
    )


_LINKS_AT_ONCE = 1_000  # links of a corrective change that meet its files together


def file_identity(links: DataFrame, files: DataFrame) -> DataFrame:
    """Which corrective file a candidate file is: (sha, path, method, corrective_path), see ``identified``."""
    return identified(links.select("sha", "corrective"), files).select("sha", "path", "method", "corrective_path")


def identified(links: DataFrame, files: DataFrame, facts: dict[str, Column] | None = None) -> DataFrame:
    """Candidate files with the columns of their link, ``facts`` (aggregates of a file), method and corrective_path.

    Same path; else the first corrective file whose old path equals, or ends, the
    candidate path; else a path transform. ``files`` needs ``old_path`` and ``seq`` here;
    the candidate of a name is its last in ``seq``.

    Candidate files and the files of their corrective change go to one place, dealt by the
    corrective change and by blocks of its links, so that no place has the files of more than
    ``_LINKS_AT_ONCE`` links or so. There every file offers the keys it can be found by (its path, its
    name, its old path), and a candidate asks for its path, its name and its endings of the lengths that
    the old paths have. In the order of keys the offers come before those who ask, the first in ``seq``
    last, so that one pass over the place answers all; no sets of paths are collected.
    """
    facts = facts or {}
    keep = [c for c in links.columns if c not in ("sha", "corrective")]
    links = written(links, "links")
    old = F.nullif(F.col("old_path"), F.lit(""))
    tied = links.where(F.col("corrective").isNotNull())
    blocks = tied.groupBy("corrective").agg(F.ceil(F.count(F.lit(1)) / _LINKS_AT_ONCE).alias("__blocks"))
    # a length is at most that of a path, so these sets stay small
    sizes = files.where(old.isNotNull()).groupBy(F.col("sha").alias("corrective")).agg(F.collect_set(F.length(old)).alias("__sizes"))
    none = lambda kind: F.lit(None).cast(kind)
    place = ["corrective", "__block"]
    # a change without a corrective one is dealt by itself and meets nothing
    linked = tied.join(blocks, "corrective").join(sizes, "corrective", "left").select(
        "sha", "corrective", *keep, F.pmod(F.xxhash64("sha"), F.col("__blocks")).alias("__block"), "__sizes"
    ).unionByName(links.where(F.col("corrective").isNull()).select(
        "sha", "corrective", *keep, F.xxhash64("sha").alias("__block"), none("array<int>").alias("__sizes")))
    mine = files.join(linked, "sha").groupBy("sha", "path", *place, *keep, "__sizes").agg(
        F.max("seq").alias("seq"), *[f.alias(n) for n, f in facts.items()]
    ).select(*place, "sha", "path", none(files.schema["old_path"].dataType).alias("old_path"), "seq", "__sizes",
             F.struct(F.lit(True).alias("__known"), *keep, *facts).alias("__more"))
    theirs = files.select(F.col("sha").alias("corrective"), "path", "old_path", "seq").join(blocks, "corrective").select(
        "corrective", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__block"),
        none(files.schema["sha"].dataType).alias("sha"), "path", "old_path", "seq", none("array<int>").alias("__sizes"),
        none(mine.schema["__more"].dataType).alias("__more"))
    met = mine.unionByName(theirs).repartition(*place)
    entry = lambda rule, key: F.struct(F.lit(rule).alias("rule"), key.alias("key"))
    path, asks = F.col("path"), F.col("sha").isNotNull()
    own, name = entry(1, path), entry(3, P.basename(path))
    ends = F.transform(F.filter("__sizes", lambda n: n <= F.length(path)), lambda n: entry(2, F.right(path, n)))
    entries = (
        F.when(~asks, F.filter(F.array(own, entry(2, old), name), lambda x: x["key"].isNotNull()))
        .when(F.col("corrective").isNull(), F.array(own)).when(F.col("__sizes").isNull(), F.array(own, name))
        .otherwise(F.concat(F.array(own, name), ends))
    )
    rows = met.select(*place, "sha", "path", "seq", "__more", F.explode(entries).alias("__e")).select(
        *place, "sha", "path", "seq", "__e.rule", "__e.key", F.when(F.col("__e.rule") == 1, F.col("__more")).alias("__more"))
    ordered = Window.partitionBy(*place).orderBy("rule", "key", F.asc_nulls_first("sha"), F.desc("seq"), F.desc("path"))
    offer = F.last(F.when(~asks, F.struct("rule", "key", "seq", F.col("path").alias("to"))), ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.lag(F.struct("rule", "key", "sha")).over(ordered)
    rows = rows.withColumn("__o", offer).withColumn("__b", before)
    same = (F.col("__o.rule") == F.col("rule")) & (F.col("__o.key") == F.col("key"))
    # the last candidate of a name stands for it
    other = (F.col("rule") == 3) & (F.col("__b") == F.struct("rule", "key", "sha"))
    hit = F.coalesce(same, F.lit(False)) & ~F.coalesce(other, F.lit(False))
    answered = rows.where(asks & (hit | (F.col("rule") == 1))).select(
        *place, "sha", "path", "__more", F.when(hit, F.struct("rule", "__o.seq", "__o.to")).alias("__m"))
    best = answered.groupBy(*place, "sha", "path").agg(F.min("__m").alias("__m"), F.max("__more").alias("__more"))
    rule = F.col("__m.rule")
    return best.select(
        "sha", "path", "corrective", *[F.col("__more")[c].alias(c) for c in (*keep, *facts)],
        F.when(rule == 1, "exact_path").when(rule == 2, "git_rename").when(rule == 3, "path_transform")
        .otherwise("none").alias("method"),
        F.col("__m.to").alias("corrective_path"),
    )


def reference_chain(edges: DataFrame) -> DataFrame:
    """Follow the corrective links up to three steps.

    ``edges``  sha, prefix, corrective. A step needs a row with a prefix; the
    chain ends at an unresolved prefix, a missing row or a change seen before.
    """
    e = edges.select("sha", "prefix", "corrective")

    def step(left: DataFrame, at: Column, i: int) -> DataFrame:
        right = e.select(
            F.col("sha").alias(f"s{i}"), F.col("prefix").alias(f"p{i}"), F.col("corrective").alias(f"c{i}")
        ).where(F.col(f"p{i}").isNotNull())
        return left.withColumn(f"a{i}", at).join(right, F.col(f"a{i}") == F.col(f"s{i}"), "left")

    out = step(e.select(F.col("sha").alias("origin")), F.col("origin"), 1)
    out = step(out, F.when(F.col("c1") != F.col("origin"), F.col("c1")), 2)
    fresh = (F.col("c2") != F.col("origin")) & (F.col("c2") != F.col("a2"))
    out = step(out, F.when(fresh, F.col("c2")), 3)
    on = [F.col(f"s{i}").isNotNull() for i in (1, 2, 3)]
    final = F.when(on[2], F.col("c3")).when(on[1], F.col("c2")).when(on[0], F.col("c1"))
    return out.select(
        F.col("origin").alias("sha"), sum((o.cast("int") for o in on), F.lit(0)).alias("depth"),
        final.isNotNull().alias("terminates"), final.alias("final_sha"),
    )


_SOUGHT_AT_ONCE = 1_000  # names sought in one pass over a message


def message_mentions(files: DataFrame, messages: DataFrame) -> DataFrame:
    """Per change: candidate paths its message names, and how far that goes.

    A path counts if its name or stem, or a path part longer than three characters, stands anywhere in the
    lower-cased message. The distinct names of a change are sought together, so its message goes along once
    for many of them and not once for each path; names and paths meet again without the text.
    """
    path = F.col("path")
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.length(p) > 3)
    names = F.array_distinct(F.transform(F.concat(F.array(P.basename(path), P.stem(path)), parts), F.lower))
    named = files.select("sha", "path").distinct().select("sha", "path", F.explode(names).alias("part"))
    sizes = named.groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    sought = named.select("sha", "part").distinct().join(sizes, "sha").select(
        "sha", "part", F.pmod(F.xxhash64("part"), F.ceil(F.col("n") / _SOUGHT_AT_ONCE)).alias("at"))
    together = sought.groupBy("sha", "at").agg(F.collect_list("part").alias("parts"))
    said = messages.where("message <> ''").select("sha", F.lower("message").alias("said"))
    found = together.join(said, "sha").select("sha", F.explode(F.filter("parts", lambda p: F.contains(F.col("said"), p))).alias("part"))
    matched = named.join(found, ["sha", "part"]).select("sha", "path").distinct().groupBy("sha").agg(F.count(F.lit(1)).alias("matched"))
    counts = files.select("sha", "path").distinct().groupBy("sha").agg(F.count(F.lit(1)).alias("files"))
    words = messages.select("sha", F.array_join(M.mentioned_words(F.col("message")), ",").alias("words"))
    return counts.join(words, "sha").join(matched, "sha", "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long"))).select(
        "sha", "files", "matched", "words",
        F.when((F.col("matched") == F.col("files")) & (F.col("matched") > 0), "all_files_mentioned")
        .when(F.col("matched") > 0, "partial_files_mentioned").otherwise("none").alias("signal_level"),
    )


# ---- file contents ------------------------------------------------------------


def _line_set(text: Column) -> Column:
    return F.array_distinct(F.transform(L.text_lines(text), L.normalize_line))


def introduced(before: Column, after: Column) -> Column:
    """Sorted distinct lines of ``after`` that ``before`` lacks; empty if either is null."""
    out = F.array_sort(F.array_except(_line_set(after), _line_set(before)))
    return F.when(before.isNull() | after.isNull(), F.array().cast("array<string>")).otherwise(out)


def removed(before: Column, after: Column) -> Column:
    return introduced(after, before)


def _pair_lines(left: list[str], right: list[str]) -> list[tuple[str, str, float]]:
    """Pair lines one to one, in order, by the largest token share above the limit.

    Lines of so many tokens share more than a known number above the limit, so all but that many of the
    rarest tokens of a line lead to every other line above it, and common tokens lead nowhere.
    """
    sets = [set(line.split()) for line in right]
    held = Counter(token for tokens in sets for token in tokens)
    holders: dict[int, dict[str, list[int]]] = {}
    for i, tokens in enumerate(sets):
        for token in tokens:
            holders.setdefault(len(tokens), {}).setdefault(token, []).append(i)
    taken, out = set(), []
    for line in left:
        tokens = set(line.split())
        rarest = sorted(tokens, key=lambda t: (held[t], t))
        best = (0.0, 0)
        for size, lists in holders.items():
            least = floor(TOKEN_SHARE / (1 + TOKEN_SHARE) * (len(tokens) + size) - 1e-9) + 1
            if least > min(len(tokens), size):
                continue
            near = {i for token in rarest[:len(rarest) - least + 1] for i in lists.get(token, ()) if i not in taken}
            for i in near:
                n = len(tokens & sets[i])
                best = max(best, (n / (len(tokens) + size - n), -i))
        # an empty right line has no tokens and cannot be found here
        if best[0] > TOKEN_SHARE:
            taken.add(-best[1])
            out.append((line, right[-best[1]], round(best[0], 4)))
    return out


_MATCHES = "array<struct<candidate_line:string,corrective_line:string,similarity:double>>"


def partial_matches(left: Column, right: Column) -> Column:
    """Greedy one-to-one matches of the lines two files do not share.

    Both arrays belong to one pair of files, so the work of a row is bounded by
    the size of two files.
    """
    @F.pandas_udf(_MATCHES)
    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([
            [{"candidate_line": x, "corrective_line": y, "similarity": s} for x, y, s in _pair_lines(list(p), list(q))]
            for p, q in zip(a, b)
        ])

    return match(left, right)


def content_correspondence(df: DataFrame, added: str, gone: str, pair_partially: bool = True) -> DataFrame:
    """Lines the change introduced against lines the correction removed.

    ``added`` and ``gone`` are arrays of distinct sorted lines.
    """
    a, g = F.col(added), F.col(gone)
    out = df.withColumn("exact", F.array_intersect(a, g))
    if pair_partially:
        left, right = F.array_sort(F.array_except(a, g)), F.array_sort(F.array_except(g, a))
        out = out.withColumn("partial", partial_matches(left, right))
    else:
        out = out.withColumn("partial", F.array().cast(_MATCHES))
    n, m = F.size("exact"), F.size("partial")
    most = F.greatest(F.size(a), F.size(g), F.lit(1))
    return out.withColumn("exact_match_count", n).withColumn("partial_match_count", m).withColumn(
        "correspondence_exists", n > 0
    ).withColumn(
        "correspondence_type", F.when(n > 0, "exact_removal").when(m > 0, "partial_overlap").otherwise("none")
    ).withColumn("exact_match_ratio", F.round(n / most, 4)).withColumn("partial_match_ratio", F.round((n + m) / most, 4))


def restoration_of(df: DataFrame, before: Column, now: Column) -> DataFrame:
    """Are two arrays of lines, null where there is no file, the same line by line?"""
    both = F.least(F.size(before), F.size(now))
    most = F.greatest(F.size(before), F.size(now))
    out = df.withColumn("__same", F.size(F.filter(F.zip_with(before, now, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda z: z)))
    same = F.col("__same")
    known = before.isNotNull() & now.isNotNull()
    restored = F.when(known, (F.size(before) == F.size(now)) & (same == most)).otherwise(False)
    return out.withColumn("restored", restored).withColumn(
        "line_diff_count", F.when(known, both - same + (most - both)).otherwise(-1)
    ).withColumn(
        "similarity_ratio",
        F.when(~known, 0.0).when(most > 0, F.round(same / F.nullif(most, F.lit(0)), 4)).otherwise(1.0),
    ).drop("__same")


def content_restoration(df: DataFrame, parent: str, current: str) -> DataFrame:
    """Is the corrected file, line by line, the file before the change?"""
    norm = lambda c: F.transform(L.text_lines(F.col(c)), L.normalize_line)
    out = df.withColumn("__a", norm(parent)).withColumn("__b", norm(current))
    return restoration_of(out, F.col("__a"), F.col("__b")).drop("__a", "__b")


def region_overlap(hunks: DataFrame, key: list[str]) -> DataFrame:
    """New-side line ranges of both changes as sets, per pair of files.

    ``hunks``  key, is_candidate, new_start, new_count
    A sweep over the starts and ends: between two of them it is known which sides are open, so the rows
    follow the regions, not their lines.
    """
    start = F.col("new_start").cast("long")
    mine = F.when(F.col("is_candidate"), 1).otherwise(0)
    events = hunks.where(F.col("new_count") > 0).select(*key, mine.alias("__m"), F.explode(F.array(
        F.struct(start.alias("at"), F.lit(1).alias("step")), F.struct((start + F.col("new_count")).alias("at"), F.lit(-1).alias("step")),
    )).alias("__e"))
    step = F.col("__e.step")
    points = events.groupBy(*key, F.col("__e.at").alias("at")).agg(
        F.sum(step * F.col("__m")).alias("__c"), F.sum(step * (1 - F.col("__m"))).alias("__r"))
    swept = frame(points, key, [F.col("at")], sums={"__oc": F.col("__c"), "__or": F.col("__r")}, lasts={"__from": F.col("at")})
    c, r = F.col("__oc") > 0, F.col("__or") > 0
    first = lambda when: F.min(F.when(when, F.col("__from")))
    last = lambda when: F.max(F.when(when, F.col("at") - 1))
    counted = swept.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(c & r, F.col("at") - F.col("__from"))), F.lit(0)).alias("overlap_lines"),
        first(c & r).alias("overlap_start"), last(c & r).alias("overlap_end"),
        first(c).alias("candidate_start"), last(c).alias("candidate_end"),
        first(r).alias("corrective_start"), last(r).alias("corrective_end"),
    )
    return counted.withColumn("overlap_exists", F.col("overlap_lines") > 0)


def ranges_with_line(ranges: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Add ``hit``: does a line lie in [start, end]? The nearest line decides, nothing is paired.

    ``ranges``  key, name, start, end      ``lines``  key, line
    Both come from other steps, so they are written once before the ordered pass, which reads them twice.
    """
    none = F.lit(None).cast("long")
    spans = ranges.select(*key, "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), none.alias("line"))
    marks = lines.select(*key, F.col("line").cast("long").alias("line")).distinct().select(
        *key, F.lit(None).cast(ranges.schema["name"].dataType).alias("name"), F.col("line").alias("start"), none.alias("end"), "line"
    )
    merged = frame(
        written(spans.unionByName(marks), "ranges"), key, [-F.col("start"), F.col("end").isNotNull(), F.col("end"), F.col("name")],
        lasts={"nearest": F.col("line")},
    ).where(F.col("end").isNotNull())
    return merged.select(*key, "name", "start", "end", F.coalesce(F.col("nearest") <= F.col("end"), F.lit(False)).alias("hit"))


def same_function(
    candidate_ranges: DataFrame, candidate_lines: DataFrame,
    corrective_ranges: DataFrame, corrective_lines: DataFrame, key: list[str],
) -> DataFrame:
    """Functions (name ranges in the after texts) that both changes touch, per pair of files.

    A function with introduced lines on one side and removed lines on the other
    gives the strong form; a name known on both sides the weak one.
    """
    def both(candidate: DataFrame, corrective: DataFrame) -> DataFrame:
        return candidate.withColumn("side", F.lit("c")).unionByName(corrective.withColumn("side", F.lit("r")))

    # both sides go through one ordered pass, and the names of a pair of files through one exchange
    sided = [*key, "side"]
    found = ranges_with_line(
        both(*[x.select(*key, "name", "start", "end") for x in (candidate_ranges, corrective_ranges)]),
        both(*[x.select(*key, "line") for x in (candidate_lines, corrective_lines)]), sided,
    ).select(*sided, "name", "hit").repartition(*key)
    is_c = F.col("side") == "c"
    per_name = found.groupBy(*key, "name").agg(
        F.max(is_c).alias("in_c"), F.max(~is_c).alias("in_r"),
        F.max(is_c & F.col("hit")).alias("hit_c"), F.max(~is_c & F.col("hit")).alias("hit_r"),
    )
    shared = F.col("in_c") & F.col("in_r")
    out = per_name.groupBy(*key).agg(
        F.max("in_c").alias("any_c"), F.max("in_r").alias("any_r"),
        F.min(F.when(F.col("hit_c") & F.col("hit_r"), F.col("name"))).alias("strong"),
        F.min(F.when(shared, F.struct("name", "hit_c"))).alias("weak"),
    )
    parsed = F.col("any_c") & F.col("any_r")
    name = F.coalesce("strong", F.col("weak.name"))
    inside = F.col("strong").isNotNull() | F.coalesce(F.col("weak.hit_c"), F.lit(False))
    return out.select(
        *key, parsed.alias("parsed"), F.when(parsed, name).alias("function_name"),
        (parsed & name.isNotNull()).alias("same_function"),
        (parsed & name.isNotNull() & inside).alias("structural_relationship"),
    )


# ---- levels -------------------------------------------------------------------


def evidence_level(
    method="method", restored="restored", exact="exact_match_count",
    exists="correspondence_exists", overlap="overlap_exists", structural="structural_relationship",
) -> Column:
    """Level of a file. MODERATE cannot be reached while a correspondence needs exact lines."""
    c = F.col
    return (
        F.when(c(method) == "none", UNKNOWN).when(c(restored) | (c(exact) > 0), STRONG)
        .when(c(exists) & (c(overlap) | c(structural)), MODERATE).otherwise(WEAK)
    )


def evidence_types(
    restored="restored", exact="exact_match_count", exists="correspondence_exists",
    overlap="overlap_exists", structural="structural_relationship", same="same_function",
) -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when(c(restored), "CONTENT_RESTORATION"),
        F.when(c(exact) > 0, "EXACT_CANDIDATE_CONTENT_REMOVAL"),
        F.when(c(exists) & (c(exact) == 0), "CANDIDATE_CONTENT_OVERLAP"),
        F.when(c(overlap), "SAME_REGION_OVERLAP"),
        F.when(c(structural), "SAME_FUNCTION_CANDIDATE_CONTENT").when(c(same), "SAME_FUNCTION_ONLY"),
    ))


def commit_evidence_level(overlaps: DataFrame) -> DataFrame:
    """Change level: resolved, prefix only, or nothing. File level: WEAK where paths overlap."""
    return overlaps.withColumn(
        "commit_evidence_level",
        F.when(F.col("corrective").isNotNull(), COMMIT_STRONG).when(F.col("prefix").isNotNull(), COMMIT_WEAK)
        .otherwise(COMMIT_NONE),
    ).withColumn("file_evidence_level", F.when(F.col("overlap_files") > 0, WEAK).otherwise(UNKNOWN))


def revert_evidence(overlaps: DataFrame, source: str = "label_source") -> DataFrame:
    """The same by label source: a revert or a named id is strong for the change only."""
    known = F.col(source).isin("revert", "explicit_sha_reference")
    return overlaps.withColumn(
        "commit_evidence_level", F.when(known, COMMIT_STRONG).otherwise(COMMIT_NONE)
    ).withColumn(
        "file_evidence_level", F.when(known & (F.col("overlap_files") > 0), WEAK).otherwise(UNKNOWN)
    )


# ---- context of a pair of changes -----------------------------------------------


# fixed values: the statuses a file can have, in the order they are told
STATUSES = ("added", "binary", "deleted", "modified", "renamed")


def status_pattern(links: DataFrame, files: DataFrame) -> DataFrame:
    """File statuses (five at most) on both sides and in common.

    A change is one row with a mark for each status, so that a link meets two rows and nothing is collected.
    """
    marks = files.groupBy("sha").agg(*[F.max(F.col("status") == s).alias(s) for s in STATUSES], F.lit(True).alias("known"))

    def side(key: str, mark: str) -> DataFrame:
        return marks.select(F.col("sha").alias(key), *[F.col(c).alias(f"{mark}_{c}") for c in (*STATUSES, "known")])

    met = links.select("sha", "corrective").join(side("sha", "c"), "sha", "left").join(side("corrective", "r"), "corrective", "left")
    both = [F.coalesce(F.col(f"c_{s}") & F.col(f"r_{s}"), F.lit(False)) for s in STATUSES]
    per = met.where(F.col("c_known") | F.col("r_known")).groupBy("sha").agg(*[F.max(x).alias(s) for x, s in zip(both, STATUSES)])
    shared = F.array_compact(F.array(*[F.when(F.col(s), s) for s in STATUSES]))
    return per.select(
        "sha", F.array_join(shared, ",").alias("status_overlap"), *[F.col(s).alias(f"{s}_in_both") for s in ("added", "deleted", "renamed")])


def feature_proximity(links: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Cosine and distance between the mean vectors of both changes."""
    means = mean_vector(vectors, ["sha"], "vector", size, "mean").where(F.col("mean").isNotNull())
    pair = (
        links.select("sha", "corrective").join(means.select("sha", F.col("mean").alias("a")), "sha", "left")
        .join(means.select(F.col("sha").alias("corrective"), F.col("mean").alias("b")), "corrective", "left")
    )
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    times = lambda x, y: add(F.zip_with(x, y, lambda p, q: p * q))
    norms = F.sqrt(times(F.col("a"), F.col("a"))) * F.sqrt(times(F.col("b"), F.col("b")))
    gap = add(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)))
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    return pair.select(
        "sha", known.alias("available"),
        F.when(known, F.round(share(times(F.col("a"), F.col("b")), norms), 6)).alias("cosine_similarity"),
        F.when(known, F.round(F.sqrt(gap), 6)).alias("euclidean_distance"),
    )


# fixed values: path parts that mark a test in the separation signal
TEST_PARTS = ("test_", "_test.py", "tests/", "test/")


def test_separation(files: DataFrame, flag: str = "test_flag") -> DataFrame:
    named = F.lit(False)
    for part in TEST_PARTS:
        named = named | F.contains(F.col("path"), F.lit(part))
    is_test = (F.col(flag) > 0.5) | named
    return files.groupBy("sha").agg(
        F.count_if(is_test).alias("test_count"), F.count_if(~is_test).alias("prod_count")
    ).withColumn("has_both", (F.col("test_count") > 0) & (F.col("prod_count") > 0))


def exclusivity(overlaps: DataFrame) -> DataFrame:
    n, c, r = F.col("overlap_files"), F.col("candidate_files"), F.col("corrective_files")
    return overlaps.select(
        "sha", (r > 0).alias("available"),
        F.when(r > 0, F.round(share(n, r), 4)).alias("overlap_ratio"),
        F.when(r > 0, F.round(share(n, c), 4)).alias("narrowing_ratio"),
    )


# ---- rollups --------------------------------------------------------------------


def attribution_rollups(report: DataFrame, dimensions: list[str], category: str) -> DataFrame:
    """Counts per category for every combination of the dimensions, totals included."""
    return report.cube(*dimensions, category).agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping_id().alias("level"),
    )


def type_distribution(report: DataFrame, types: str = "evidence_types") -> DataFrame:
    return report.select(F.explode(types).alias("evidence_type")).groupBy("evidence_type").agg(F.count(F.lit(1)).alias("n"))


def source_breakdown(levels: DataFrame, source: str = "label_source") -> DataFrame:
    return levels.groupBy(source).agg(
        F.count(F.lit(1)).alias("commits"),
        F.count_if(F.col("commit_evidence_level") == COMMIT_STRONG).alias("commit_strong"),
        F.count_if(F.col("file_evidence_level") == WEAK).alias("file_weak"),
    )


def contextual_summary(mentions, statuses, proximity, tests, exclusive) -> list[DataFrame]:
    """One-row summaries of the context signals."""
    return [
        mentions.agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.col("matched") > 0).alias("with_mention")),
        statuses.agg(F.count_if(F.col("status_overlap") != "").alias("with_status_overlap")),
        proximity.agg(F.count_if("available").alias("with_vectors"),
                      F.coalesce(F.round(F.avg("cosine_similarity"), 6), F.lit(0.0)).alias("mean_cosine")),
        tests.agg(F.count_if("has_both").alias("mixed_commits")),
        exclusive.agg(F.count_if("available").alias("with_corrective"),
                      F.coalesce(F.round(F.avg("overlap_ratio"), 4), F.lit(0.0)).alias("mean_overlap_ratio")),
    ]


def prediction_units(report: DataFrame) -> DataFrame:
    """Label counts per prediction unit: changes, files by level, files in the same function."""
    level = lambda x: F.count_if(F.col("level") == x)
    return report.agg(
        F.count_distinct("sha").alias("commits"), F.count(F.lit(1)).alias("files"),
        level(STRONG).alias("file_strong"), level(MODERATE).alias("file_moderate"),
        level(WEAK).alias("file_weak"), level(UNKNOWN).alias("file_unknown"),
        F.count_if("same_function").alias("same_function"),
    )


def reference_lookup(rows: DataFrame) -> DataFrame:
    """(repo, sha, path) of supervised and ambiguous rows together, duplicates folded."""
    return rows.groupBy("repo", "sha", "path").agg(F.count(F.lit(1)).alias("rows"))


def first_timestamps(rows: DataFrame, order: list[str]) -> DataFrame:
    """First known time per (repository, id) in stored order."""
    return rows.where(F.col("ts").isNotNull()).groupBy("repo", "sha").agg(
        F.min_by("ts", F.struct(*order)).alias("ts")
    )
