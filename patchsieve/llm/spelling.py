"""Spelling variants of the words of a corpus, found by pivotal grams.

The bigrams of a word are ordered by the number of words that hold them, rarest first; its prefix is
the three rarest with their ties. Two disjoint bigrams of the prefix, the pivots, are chosen by dynamic
programming so that their lists are shortest. One edit leaves one of two disjoint pivots whole, and of
two near words the pivot of that whose prefix ends earlier stands in the prefix of the other. So pivots
are indexed against prefixes, by position limits: the edit is on one side of the pivot, so the text on
its other side is the same, which tells its place from the start or from the end; and of the edited side
the first or the last two letters are the same. What meets, with lengths that differ by one at most, is
verified by its edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import written

RUNS = "[a-zÀ-ÿ]{%d,}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 3
_JUMPS = 6


def counted_words(documents: DataFrame, modulus: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the runs of letters of all texts, one code point taken out of the rows the checksum picks."""
    # a run shorter than a word can not become one
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUNS % least_length), F.lit(0))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    h, length = F.col("h"), F.char_length("run")
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (h % length).cast("int")
    cut = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, length))
    words = rows.select(F.when(h % modulus == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each bigram occurs; at most the square of the 90 letters, so it may pass the driver."""
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.select(F.explode(F.array_distinct(F.transform(places, lambda p: F.col("word").substr(p, F.lit(2))))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def prefix_grams(word: str, counts: dict[str, int]) -> list[tuple[int, str, int]]:
    """(count, gram, place) of the rarest grams, with all places of grams as rare as the last."""
    grams = sorted((counts[word[p:p + 2]], word[p:p + 2], p) for p in range(len(word) - 1))
    last = grams[min(PREFIX, len(grams)) - 1][:2]
    return [g for g in grams if g[:2] <= last]


def pivots(grams: list[tuple[int, str, int]], needed: int = 2) -> list[tuple[int, str, int]]:
    """`needed` disjoint grams with the least sum of counts.

    best[j] holds the cheapest choice of j disjoint grams among those that end at or before a place.
    """
    free = [(0, [])] + [None] * needed  # choices that end before the present gram begins
    waiting: list[tuple[int, list]] = []
    for gram in sorted(grams, key=lambda g: g[2]):
        ready = [w for w in waiting if w[0] <= gram[2]]
        waiting = [w for w in waiting if w[0] > gram[2]]
        for _, best in ready:
            free = [min((c for c in (x, y) if c is not None), key=lambda c: c[0], default=None) for x, y in zip(free, best)]
        grown = [None] + [c and (c[0] + gram[0], c[1] + [gram]) for c in free[:-1]]
        waiting.append((gram[2] + 2, grown))
    for _, best in waiting:
        free = [min((c for c in (x, y) if c is not None), key=lambda c: c[0], default=None) for x, y in zip(free, best)]
    return free[needed][1]


def _keys(word: str, gram: str, place: int, pivot: bool) -> list[int]:
    """The gram, the whole text on one side of it, and two letters of the side that may be edited.

    One edit of four letters or more leaves the first or the last two of them, if not both. A shorter side
    is not told by its letters; as the edit may shorten or lengthen it, a prefix gram has both forms around
    that length.
    """
    left, right, parts = word[:place], word[place + 2:], []
    for same, edited in ((f"<{gram} {left}", right), (f">{gram} {right}", left)):
        if len(edited) >= (4 if pivot else 3):
            parts += [f"{same} ^{edited[:2]}", f"{same} ${edited[-2:]}"]
        if len(edited) < (4 if pivot else 5):
            parts.append(same)
    return [xxhash.xxh3_64_intdigest(p.encode()) for p in parts]


def _entries(counts: dict[str, int]):
    """(word, n, pivot, key) of the pivots and of the prefix grams of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                grams = prefix_grams(word, counts)
                for pivot, chosen in ((False, grams), (True, pivots(grams))):
                    keys = {k for _, gram, place in chosen for k in _keys(word, gram, place, pivot)}
                    rows += [(word, n, pivot, k) for k in keys]
            word, n, pivot, key = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(pivot, pa.bool_()), pa.array(np.array(key, np.uint64).view(np.int64))],
                names=["word", "n", "pivot", "key"])
    return run


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, n, other, other_n), both ways, of words that one insertion, deletion or replacement joins."""
    counts = gram_counts(words)
    entries = written(words.mapInArrow(_entries(counts), "word string, n long, pivot boolean, key long"), "grams")
    index = entries.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    prefix = entries.where("NOT pivot").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    close = F.abs(F.char_length("a") - F.char_length("b")) <= 1
    apart = (F.col("a") != F.col("b")) & close & (F.levenshtein("a", "b", 1) == 1)
    met = index.join(prefix, "key").where(apart)
    ordered = met.select(
        F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
        F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                             F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return ordered.distinct().select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: every pass doubles the steps followed.

    A form occurs twice as often as its word, so that 62 steps are the most that longs allow.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(_JUMPS):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            break
    return roots.select("word", "root")


def spelling_variants(documents: DataFrame, modulus: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per distinct word of `documents` (doc_id, text; more columns are ignored).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, of at least
    `least_length` code points and `least_count` occurrences. If `modulus` divides a run's checksum with its
    doc_id, the run loses a code point first. A null doc_id counts as an empty one; null and empty texts
    have no words; repeated rows count each. A word's form is its near word with the largest n, the first
    in code-point order among equals, if that is at least twice the word's. Tables without words give no rows.
    """
    words = written(counted_words(documents, modulus, least_length, least_count), "words")
    best = F.min(F.struct(F.negative("other_n").alias("minus"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.minus") >= 2 * F.col("n"), F.col("best.form"))
    described = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.minus")).alias("form_n")), "forms")
    return described.join(_roots(described.where("form IS NOT NULL")), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
