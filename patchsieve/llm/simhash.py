"""Near duplicates by SimHash, with pivot distance tables over the fingerprints.

1. A fingerprint bit is set if it is set in over half of the XXH64 values of a text's word shingles.
   Everything below works on one row per distinct fingerprint.
2. Two fingerprints that differ in 3 bits at most agree in 3 of 6 blocks of bits. A fingerprint stands in
   20 buckets, one for each choice of 3 blocks, so that every pair to be linked meets in one of them and
   unrelated ones hardly ever do: a bucket is known by 31 to 33 bits.
3. Inside a bucket the pivot table decides: the distances of every fingerprint to 32 reference
   fingerprints are computed once, and by the triangle inequality a pair with a coordinate that differs
   by more than 3 cannot be linked. Survivors are verified by their exact distance.
4. A bucket gives links that span its components, not all its pairs. Large buckets are cut into blocks of
   bounded size; blocks are compared with each other after the links inside blocks gave components, and
   only fingerprints of different components are compared then. No candidate is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import runs, written
from patchsieve.llm.components import components

SEED, WORDS, BITS = 42, 3, 3
CHUNK = 1 << 20
BLOCK_WIDTHS = (11, 11, 11, 11, 10, 10)
EQUAL_BLOCKS = len(BLOCK_WIDTHS) - BITS
REFERENCES = np.random.default_rng(6_401).integers(0, 1 << 64, 32, dtype=np.uint64)
BLOCK_ROWS = 8_192
SMALL = 16
PAIRS_AT_ONCE = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_STARTS = np.cumsum([0, *BLOCK_WIDTHS])
_BLOCKS = np.array([((1 << w) - 1) << int(s) for w, s in zip(BLOCK_WIDTHS, _STARTS)], np.uint64)
_CHOICES = list(combinations(range(len(BLOCK_WIDTHS)), EQUAL_BLOCKS))
_MASKS = np.array([sum(int(_BLOCKS[b]) for b in choice) for choice in _CHOICES], np.uint64)
#: by the bit set of equal blocks, the first choice that a pair meets in
_FIRST = np.array([next((n for n, c in enumerate(_CHOICES) if all(equal >> b & 1 for b in c)), -1) for equal in range(1 << len(BLOCK_WIDTHS))])


def _parts(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces of bounded size."""
    lo = 0
    while lo < len(raw):
        space = _SPACE.search(raw, min(lo + CHUNK, len(raw)))
        stop = space.start() if space else len(raw)
        yield raw[lo:stop].lower().split()
        lo = max(stop, lo + 1)


def fingerprint(raw: bytes) -> int:
    """The SimHash of a text in UTF-8, 0 without words."""
    counts, n, words = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in _parts(raw):
        words = words[-(WORDS - 1):] + part
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        joined = b" ".join(words)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[WORDS - 1:].tolist())), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    if not n and words:
        return digest(b" ".join(words), SEED)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference."""
    return np.bitwise_count(prints[:, None] ^ REFERENCES[None]).astype(np.int8)


def near(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places of the pairs (a, b) within `bits`: coordinates discard pairs in turn, survivors are verified."""
    at = np.arange(len(a))
    for c in range(table.shape[1]):
        column = table[:, c]
        at = at[np.abs(column[a[at]] - column[b[at]]) <= bits]
    return at[np.bitwise_count(prints[a[at]] ^ prints[b[at]]) <= bits]


def _later_rows(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of every row with the later rows of its group, whose end is given by row, in bounded parts."""
    counts = ends - np.arange(len(ends)) - 1
    total = np.cumsum(counts)
    lo = 0
    while lo < len(ends):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + PAIRS_AT_ONCE, "right")))
        a = np.repeat(np.arange(lo, hi), counts[lo:hi])
        first = np.repeat(total[lo:hi] - counts[lo:hi], counts[lo:hi])
        yield a, a + 1 + np.arange(before, total[hi - 1]) - first
        lo = hi


def spanning_links(prints: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links, as places, that connect what is connected within `bits`: a search that takes linked rows out."""
    table, links = pivot_table(prints), []
    left, front = np.arange(len(prints)), []
    while len(left):
        if not front:
            front, left = [left[:1]], left[1:]
            continue
        wave = front.pop()
        step = max(1, PAIRS_AT_ONCE // max(len(left), 1))
        if len(wave) > step:
            front.append(wave[step:])
            wave = wave[:step]
        a, b = np.repeat(wave, len(left)), np.tile(np.arange(len(left)), len(wave))
        hit = near(prints, table, a, left[b], bits)
        places, which = np.unique(b[hit], return_index=True)
        if len(places):
            links += zip(a[hit[which]].tolist(), left[places].tolist())
            front.append(left[places])
            left = np.delete(left, places)
    return links


def _edges(prints: np.ndarray, a, b) -> pa.RecordBatch:
    signed = prints.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[np.asarray(a, np.int64)]), pa.array(signed[np.asarray(b, np.int64)])], names=["a", "b"])


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside (choice, key, block) groups."""
    for rows, starts in runs(batches, ["choice", "key", "block"]):
        prints = rows.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        choice = rows.column("choice").to_numpy()
        sizes = np.diff([*starts, len(prints)])
        small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        some = prints[small]
        table, ends = pivot_table(some), np.cumsum(sizes[sizes <= SMALL])
        for a, b in _later_rows(np.repeat(ends, sizes[sizes <= SMALL])):
            hit = near(some, table, a, b)
            a, b = a[hit], b[hit]
            # a pair that meets in several buckets is linked in the first
            differ = (some[a] ^ some[b])[:, None] & _BLOCKS[None]
            equal = ((differ == 0) << np.arange(len(_BLOCKS))).sum(1)
            new = _FIRST[equal] == choice[small[a]]
            yield _edges(some, a[new], b[new])
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            links = spanning_links(prints[s:s + n])
            if links:
                yield _edges(prints[s:s + n], *zip(*links))


def _link_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components, of block i with block j, inside (choice, key, i, j) groups."""
    for rows, starts in runs(batches, ["choice", "key", "i", "j"]):
        every = rows.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        comps, first = rows.column("comp").to_numpy(), rows.column("block").to_numpy() == rows.column("i").to_numpy()
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(every)]):
            prints, comp, links = every[s:e], comps[s:e].copy(), []
            table = pivot_table(prints)
            ones, twos = np.flatnonzero(first[s:e]), np.flatnonzero(~first[s:e])
            step = max(1, PAIRS_AT_ONCE // max(len(twos), 1))
            for lo in range(0, len(ones), step):
                part = ones[lo:lo + step]
                a, b = np.nonzero(comp[part][:, None] != comp[twos][None])
                a, b = part[a], twos[b]
                hit = near(prints, table, a, b)
                for p, q in zip(a[hit].tolist(), b[hit].tolist()):
                    if comp[p] != comp[q]:
                        comp[comp == comp[q]] = comp[p]
                        links.append((p, q))
            if links:
                yield _edges(prints, *zip(*links))


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints `fp` to (fp, comp): comp is the least fingerprint reachable by links."""
    masks = _MASKS.view(np.int64).tolist()
    buckets = F.array(*(F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(masks)))
    keyed = prints.select("fp", F.explode(buckets).alias("at")).select("fp", "at.choice", "at.key")
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    members = keyed.join(shared, ["choice", "key"]).select("choice", "key", "fp", blocks.alias("blocks"))
    members = written(members.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), "buckets")
    dealt = members.repartition("choice", "key", "block").sortWithinPartitions("choice", "key", "block")
    inside = written(dealt.mapInArrow(_link_blocks, "a long, b long").distinct(), "links")

    own = components(inside)
    placed = members.where("blocks > 1").join(own, F.col("fp") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "fp")).drop("node")
    mixed = placed.groupBy("choice", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("choice", "key")
    pairs = (
        placed.join(mixed, ["choice", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
        .select("choice", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "comp")
    )
    facing = pairs.repartition("choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j")
    across = written(facing.mapInArrow(_link_across, "a long, b long").distinct(), "across")
    whole = components(inside.unionAll(across))
    return prints.join(whole, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("comp", "fp").alias("comp"))


def simhash_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `documents` (doc_id, text; more columns are ignored).

    Words are runs outside the bytes 0x20 and 0x09 to 0x0D, A-Z in lower case; fewer than three words are
    one shingle. Null and empty texts and texts without words have fingerprint 0, which is linked like any
    other. A component is named by its least doc_id; a null doc_id is passed over there, and a component of
    nulls alone has a null name. Repeated rows keep a row each. An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    printed = written(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    classes = written(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    named = written(linked_fingerprints(classes.select("fp")).join(classes, "fp"), "groups")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "comp").select("fp", "component_id")
    # equal texts share a fingerprint: a join that skew handling may split
    return printed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
