"""Benchmark passages in documents by pigeonhole edit matching.

A test item with a budget of k edits is split into k + 1 pieces: every passage within the budget
holds one of them unchanged. All pieces of a block of items are searched in one pass over a text;
each hit gives a window that Myers' bit-parallel edit distance confirms or refutes.

Texts are compared lower-cased, with every run of other than letters and digits as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import strings, written

ERROR_SHARE, PIECE, BLOCK_CHARS = 0.08, 16, 500_000
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_FILTER_BITS = 18


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """For every code point its lower case, or a space for other than letters and digits."""
    out = np.full(0x110000, 32, np.uint32)
    for n in range(0x110000):
        c = chr(n)
        if c.isalnum():
            low = c.lower()
            out[n] = ord(low) if len(low) == 1 else n
    return out


def normal(text: str) -> tuple[str, list[np.ndarray]]:
    """The text to compare, padded with one space on both sides, and each code point's place in `text`."""
    parts, places, spaced = [], [], True
    for at in range(0, len(text), CHUNK):
        codes = _folds()[np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = codes == 32
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        keep[0] |= not spaced
        spaced = bool(gap[-1])
        kept = np.flatnonzero(keep)
        parts.append(codes[kept].tobytes().decode("utf-32-le", "surrogatepass"))
        places.append(kept + at)
    return " " + "".join(parts) + " " * (not spaced), places


def item_text(text: str) -> str:
    return normal(text)[0].strip(" ")


def windows(text: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, hashes) of all windows of `size` code points, a multiple of four."""
    for at in range(0, len(text) - size + 1, CHUNK):
        one = np.frombuffer(text[at:at + CHUNK + size - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        two = one[:-1] * _U(_BASE) + one[1:]
        four = two[:-2] * _U(_BASE**2 % 2**64) + two[2:]
        step, whole = _U(_BASE**4 % 2**64), four
        for done in range(4, size, 4):
            whole = whole[:len(four) - done] * step + four[done:]
        yield at, (whole ^ whole >> _U(29)) * _U(0xBF58476D1CE4E5B9)


def budget(size: int) -> int:
    """Edits allowed for an item: a share of its length, with pieces of PIECE code points at least."""
    return max(0, min(int(size * ERROR_SHARE), size // PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut into k + 1 pieces of near equal length, each with its place."""
    cuts = [len(item) * n // (k + 1) for n in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """A text for approximate search: the bits of every character's places."""

    def __init__(self, text: str):
        self.size = len(text)
        self.bits: dict[str, int] = {}
        for n, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << n

    def best(self, text: str) -> tuple[int, int]:
        """The least distance to any part of `text`, and the first end with it."""
        full = (1 << self.size) - 1
        top = 1 << self.size - 1
        up, down, score = full, 0, self.size
        found, end = score, 0
        bits = self.bits
        for n, c in enumerate(text, 1):
            here = bits.get(c, 0)
            diagonal = (((here & up) + up) ^ up) | here | down
            rise = down | (full & ~(diagonal | up))
            fall = up & diagonal
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
                if score < found:
                    found, end = score, n
            rise = rise << 1 & full
            fall = fall << 1 & full
            up = fall | (full & ~(diagonal | rise))
            down = rise & diagonal
        return found, end


@lru_cache(maxsize=4_096)
def _patterns(item: str) -> tuple[Pattern, Pattern]:
    return Pattern(item), Pattern(item[::-1])


@lru_cache(maxsize=20_000)
def nearest(item: str, window: str, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of `window` that is nearest to `item`, if within k edits."""
    at = window.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    there, back = _patterns(item)
    distance, end = there.best(window)
    if distance > k:
        return None
    _, size = back.best(window[:end][::-1])
    return distance, end - size, end


class Searcher:
    """Exact search for the pieces of a block of items.

    The first PIECE code points of every piece are looked up by hash at every place of a text; the few
    pieces that are shorter (of short items) stand in an automaton of their own.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        words: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = item_text(text)
            if not item:
                continue
            k = budget(len(item))
            if k == 0:
                item = f" {item} "  # a short item has to stand as whole words
            for at, piece in pieces(item, k):
                words.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, item, k))
        self.long: dict[int, list[tuple[str, list[tuple[int, int]]]]] = {}
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.short = ahocorasick.Automaton()
        for word, places in words.items():
            if len(word) < PIECE:
                self.short.add_word(word, (len(word), places))
                continue
            [(_, [key])] = windows(word[:PIECE], PIECE)
            self.long.setdefault(int(key), []).append((word, places))
            self.filter[key >> _U(64 - _FILTER_BITS)] = True
        if len(self.short):
            self.short.make_automaton()

    def _pieces_in(self, text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        for at, keys in windows(text, PIECE) if self.long else ():
            near = np.flatnonzero(self.filter[keys >> _U(64 - _FILTER_BITS)])
            for place, key in zip((near + at).tolist(), keys[near].tolist()):
                for word, places in self.long.get(key, ()):
                    if text.startswith(word, place):
                        yield place, places
        if len(self.short):
            for end, (size, places) in self.short.iter(text):
                yield end - size + 1, places

    def hits(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, start, end, passages) of each item found in a normal text."""
        begun: dict[int, set[int]] = {}
        for place, found in self._pieces_in(text):
            for n, at in found:
                begun.setdefault(n, set()).add(place - at)
        out = []
        for n, starts in begun.items():
            item_id, item, k = self.items[n]
            # windows that overlap are searched as one
            spans: list[list[int]] = []
            for s in sorted(starts):
                lo, hi = max(0, s - k), min(len(text), s + len(item) + k)
                if spans and lo <= spans[-1][1] - len(item) + k:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            passages = []
            for lo, hi in spans:
                found = nearest(item, text[lo:hi], k)
                if found:
                    passages.append((found[0], lo + found[1], lo + found[2]))
            if passages:
                distance, a, b = min(passages)
                pad = k == 0
                out.append((item_id, distance, a + pad, b - pad, len(passages)))
        return out


def _original(places: list[np.ndarray], a: int, b: int) -> tuple[int, int]:
    """The range of a text for a range of its normal form, without the gaps at its ends."""
    at = np.concatenate(places)
    last = len(at) - 1
    return int(at[min(max(a - 1, 0), last)]), int(at[min(max(b - 2, 0), last)]) + 1


def _find(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")).to_pylist()):
                body, places = normal(text)
                rows += [(doc_id, i, d, *_original(places, a, b), n) for i, d, a, b, n in searcher.hits(body)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])],
                names=["doc_id", "item_id", "distance", "start", "end", "passages"])
    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `limit` code points, one block on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct().toLocalIterator():
        if block and size + len(row.text) > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield block


def contaminated(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item found in it within the item's budget.

    (doc_id, item_id, distance, start, end, passages): the nearest passage, the first of equal ones, as
    a half-open range of code points of the whole text, and the number of separate passages. Items of
    fewer than 32 letters, digits and gaps have no edits and must stand as whole words. Null or empty texts and
    items match nothing; repeated rows of `documents` are searched each, repeated items once. Every block of
    items is one pass over the documents.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance int, start int, end int, passages int"
    out = None
    for block in _blocks(benchmark, block_chars):
        found = written(docs.mapInArrow(_find(block), schema), "passages")
        out = found if out is None else out.unionAll(found)
    return out


def without_passages(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `documents` in which no item is found, with all their columns.

    Every row is judged by its own text, also rows with null or repeated ids. A benchmark of one block is
    one pass without a shuffle. Of a larger one each block is a pass that writes the digests of the texts
    in which it is found, so that no task, plan or driver holds more than one block; the rows with such
    a text are taken out by an anti-join.
    """
    def clean(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(items)
            for batch in batches:
                texts = strings(batch.column("text")).to_pylist()
                yield batch.filter(pa.array([not searcher.hits(normal(t)[0]) for t in texts], pa.bool_()))
        return run

    def hit(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(items)
            for batch in batches:
                texts = strings(batch.column("text")).to_pylist()
                yield batch.select(["digest"]).filter(pa.array([bool(searcher.hits(normal(t)[0])) for t in texts], pa.bool_()))
        return run

    total = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct().agg(F.sum(F.length("text"))).first()[0]
    if (total or 0) <= block_chars:
        for block in _blocks(benchmark, block_chars):
            documents = documents.mapInArrow(clean(block), documents.schema)
        return documents
    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = documents.select("text", digest.alias("digest")).where("text IS NOT NULL")
    found = None
    for block in _blocks(benchmark, block_chars):
        digests = written(texts.mapInArrow(hit(block), "digest string").distinct(), "digests")
        found = digests if found is None else found.unionAll(digests)
    return documents.join(found.select(F.col("digest").alias("found_digest")), digest == F.col("found_digest"), "left_anti")
