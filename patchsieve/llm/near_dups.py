"""Near duplicates by banded MinHash with sequential Bayesian verification.

Documents with one shingle set form a class; everything below works on one row per class.

1. Signatures of 128 minima are cut into 32 bands of 4. A pair of similarity 0.75 shares no band
   with a chance of 5e-6.
2. A bucket's center is its least member. Every class is compared with the center that it shares most
   buckets with: signature batches are compared in turn and a pair is dropped once the posterior chance
   that its similarity reaches the threshold is below `miss`. Survivors are verified on the full sets.
3. The links found give components. Buckets that still hold several components are compared member
   by member across components, in blocks of bounded size, again in batches; survivors are verified
   on full sets, best first, until their components have met. Pairs inside one component need no check:
   they cannot change it. No candidate is dropped but by the Bayesian bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import runs, written
from patchsieve.llm.components import components
from patchsieve.llm.shingles import _PLACES, mix, set_key, shingle_sets

_U = np.uint64
_RANDOM = np.random.default_rng(4_711)
MINIMA, ROWS, BATCH = 128, 4, 16
BANDS = MINIMA // ROWS
_MULTIPLY = _RANDOM.integers(1, 2**63, MINIMA, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_ADD = _RANDOM.integers(1, 2**63, MINIMA, dtype=np.int64).astype(_U)
BLOCK_BYTES = 4 << 20
PAIRS_AT_ONCE = 1 << 18


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima (32 bits each) per set; empty sets give a row of the largest value."""
    out = np.full((len(sets), MINIMA), 0xFFFFFFFF, np.uint32)
    rows = [i for i, s in enumerate(sets) if len(s)]
    if rows:
        values = np.concatenate([sets[i] for i in rows])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])[:-1]])
        for j in range(MINIMA):
            out[rows, j] = np.minimum.reduceat((values * _MULTIPLY[j] + _ADD[j]) >> _U(32), starts)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sigs = [], [], []
        for sets in shingle_sets(batch.column("text")):
            sizes += [len(s) for s in sets]
            keys += [set_key(s) for s in sets]
            sigs += [row.tobytes() for row in signatures(sets)]
        low, high = zip(*keys) if keys else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("text_key").cast(pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sigs, pa.binary())],
            names=["doc_id", "text_key", "n_shingles", "k1", "k2", "sig"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.frombuffer(b"".join(x for p in parts for x in p.to_pylist()), np.uint32).reshape(-1, MINIMA)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) for every band: equal keys mean equal minima of the band that their lower bits tell."""
    for batch in batches:
        sig = _matrix(batch.column("sig")).astype(_U)
        nodes = batch.column("node").to_numpy()
        for j in range(BANDS):
            key = np.full(len(sig), j + 1, _U)
            for r in range(ROWS):
                key = mix(key * _PLACES[r] + sig[:, j * ROWS + r])
            key = (key & ~_U(BANDS - 1)) | _U(j)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes)], names=["key", "node"])


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch of n compared minima, the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) is the chance that a binomial variable of
    n + 1 trials at t is at most m.
    """
    out = []
    for n in range(BATCH, MINIMA + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold)**(n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, bounds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that no batch rules out, as places in `left`, and their matches."""
    at, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for b, least in enumerate(bounds):
        cut = slice(b * BATCH, (b + 1) * BATCH)
        matches = matches + (left[at, cut] == right[at, cut]).sum(1)
        keep = matches >= least
        at, matches = at[keep], matches[keep]
    return at, matches


def _verify_stars(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, matches = survivors(_matrix(batch.column("sig")), _matrix(batch.column("center_sig")), bounds)
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pick), batch.column("center").take(pick), pa.array(matches)], names=["node", "center", "matches"])
    return run


def _pairs(ones: np.ndarray, twos: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of two blocks, or of one with itself, in parts of about PAIRS_AT_ONCE."""
    size = len(ones) if twos is None else len(twos)
    step = max(1, PAIRS_AT_ONCE // max(size, 1))
    for lo in range(0, len(ones), step):
        part = ones[lo:lo + step]
        if twos is None:
            a, b = np.nonzero(np.arange(lo, lo + len(part))[:, None] < np.arange(size)[None])
            yield part[a], ones[b]
        else:
            yield np.repeat(part, size), np.tile(twos, len(part))


def _verify_blocks(bounds, percent: int):
    """Links between different components inside (key, i, j) groups: block i with block j.

    Pairs are taken in parts of bounded size, whatever the size of the blocks. The surviving pairs of a
    part are verified from the most matches down, and only while their components are still apart, so that
    a group gives fewer links than it has rows.
    """
    def links(sig, sets, node, comp, band, a, b):
        """Verified links of the pairs (a, b); comp is told of them."""
        at, matches = _survivors_at(sig, a, b, bounds)
        x, y = a[at], b[at]
        # a pair that shares several bands is dealt with in the first
        new = (sig[x] == sig[y]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[x]
        x, y, matches = x[new], y[new], matches[new]
        order = np.argsort(-matches, kind="stable")
        x, y, out = x[order], y[order], []
        for lo in range(0, len(x), 4_096):
            one, two = x[lo:lo + 4_096], y[lo:lo + 4_096]
            apart = np.flatnonzero(comp[one] != comp[two])
            for p, q in zip(one[apart].tolist(), two[apart].tolist()):
                if comp[p] != comp[q] and linked(sets[p].as_buffer(), sets[q].as_buffer(), percent):
                    comp[comp == comp[q]] = comp[p]
                    out.append((node[p], node[q]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in runs(batches, ["key", "i", "j"]):
            sig, sets, node = _matrix(rows.column("sig")), rows.column("set").combine_chunks(), rows.column("node").to_pylist()
            comp, block = rows.column("comp").to_numpy().copy(), rows.column("block").to_numpy()
            firsts, band = rows.column("i").to_numpy(), rows.column("key").to_numpy() & (BANDS - 1)
            same = (firsts == rows.column("j").to_numpy())[starts]
            todo, size = [], 0
            for g, (s, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(node)])):
                ones = np.arange(s, e) if same[g] else np.flatnonzero(block[s:e] == firsts[s]) + s
                twos = None if same[g] else np.flatnonzero(block[s:e] != firsts[s]) + s
                found = []
                for a, b in _pairs(ones, twos):
                    apart = comp[a] != comp[b]
                    todo.append((a[apart], b[apart]))
                    size += len(todo[-1][0])
                    if size >= PAIRS_AT_ONCE:
                        found += links(sig, sets, node, comp, band, *(np.concatenate(x) for x in zip(*todo)))
                        todo, size = [], 0
                if e == len(node) and size:
                    found += links(sig, sets, node, comp, band, *(np.concatenate(x) for x in zip(*todo)))
                if found:
                    one, two = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])
    return run


def _survivors_at(sig, x, y, bounds):
    """As `survivors`, reading the compared batch of rows only."""
    at, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for b, least in enumerate(bounds):
        cut = sig[:, b * BATCH:(b + 1) * BATCH]
        matches = matches + (cut[x[at]] == cut[y[at]]).sum(1)
        keep = matches >= least
        at, matches = at[keep], matches[keep]
    return at, matches


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = (s.tobytes() for sets in shingle_sets(batch.column("text")) for s in sets)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.binary())], names=["node", "set"])


def linked(a, b, percent: int) -> bool:
    """Whether two sets (buffers of sorted hashes) have 100 * intersection >= percent * union."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verify_sets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n, (a, b) in enumerate(zip(batch.column("set"), batch.column("center_set"))) if linked(a.as_buffer(), b.as_buffer(), percent)]
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pick), batch.column("center").take(pick)], names=["a", "b"])
    return run


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, center) of classes whose full sets meet the threshold, as edges (a, b)."""
    joined = pairs.select("node", "center").join(sets, "node").join(
        sets.select(F.col("node").alias("center"), F.col("set").alias("center_set")), "center")
    return joined.mapInArrow(_verify_sets(percent), "a long, b long")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text_key", F.xxhash64("text"))


def _grouped(documents: DataFrame, percent: int, miss: float) -> DataFrame:
    """(doc_id, text_key, n_shingles, comp, component_id) per row; comp numbers the groups, null without shingles."""
    bounds = least_matches(percent / 100, miss)
    docs = _keyed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sig binary"
    sketched = written(docs.mapInArrow(_sketch, schema), "sketches")
    found = sketched.where("n_shingles > 0")
    reps = found.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "classes")
    sigs = found.groupBy("k1", "k2").agg(F.first("sig").alias("sig"))
    sigs = written(reps.join(sigs, ["k1", "k2"]).select("node", "sig"), "signatures")

    bands = sigs.mapInArrow(_bands, "key long, node long")
    shared = bands.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last")
    members = written(bands.join(shared.select("key", "center"), "key"), "buckets")
    # full sets of the classes that share a bucket with another
    shares = members.select("node").distinct()
    wanted = reps.join(shares, "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    texts = docs.join(wanted, F.col("text_key").eqNullSafe(F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    sets = texts.select("node", "text").mapInArrow(_sets, "node long, set binary")
    sets = written(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")

    # of the centers of its buckets, a member is compared with that it shares most buckets with
    shared = members.where("node <> center").groupBy("node", "center").agg(F.count("*").alias("bands"))
    stars = shared.groupBy("node").agg(F.max(F.struct("bands", F.negative("center").alias("minus"))).alias("best"))
    stars = stars.select("node", F.negative("best.minus").alias("center"))
    with_sigs = stars.join(sigs, "node").join(sigs.select(F.col("node").alias("center"), F.col("sig").alias("center_sig")), "center")
    likely = written(with_sigs.mapInArrow(_verify_stars(bounds), "node long, center long, matches long"), "stars")
    first = written(_exact(likely, sets, percent), "links")

    own = components(first)
    placed = written(
        members.select("key", "node").join(own, "node", "left").join(reps.select("node", "n_shingles"), "node")
        .select("key", "node", F.coalesce("comp", "node").alias("comp"), "n_shingles"), "placed")
    # a group of two blocks holds about twice BLOCK_BYTES of signatures and sets
    weight = F.col("n_shingles") * 8 + MINIMA * 4
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(weight).alias("weight")).where("lo < hi")
    blocks = F.ceil(F.col("weight") / BLOCK_BYTES).cast("int")
    open_rows = (
        placed.join(mixed.select("key", blocks.alias("blocks")), "key")
        .withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")
        .join(sigs, "node").join(sets, "node").select("key", "i", "j", "block", "node", "comp", "sig", "set")
    )
    spread = open_rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    across = written(spread.mapInArrow(_verify_blocks(bounds, percent), "a long, b long").distinct(), "across")
    links = first.unionAll(across)

    whole = components(links)
    named = reps.join(whole, "node", "left").select("k1", "k2", "least_id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "comp").select("k1", "k2", "comp", "component_id")
    rows = sketched.select("doc_id", "text_key", "n_shingles", "k1", "k2")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(named, ["k1", "k2"]).select("doc_id", "text_key", "n_shingles", "comp", "component_id").unionAll(alone)


def near_duplicates(documents: DataFrame, percent: int = 75, miss: float = 1e-5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `documents` (doc_id, text; more columns are ignored).

    Rows whose distinct 5-word shingles have 100 * intersection >= percent * union are linked; a
    component is named by its least doc_id. Null texts, empty texts and texts without words have no
    shingles and stand alone. Rows that repeat a doc_id keep a row each; a null doc_id is passed over
    when the least is taken, and a component of nulls alone has a null name. An empty table gives none.
    """
    return _grouped(documents, percent, miss).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_per_group(documents: DataFrame, percent: int = 75, miss: float = 1e-5) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that with the least doc_id.

    Of rows that share this doc_id too, that with the least text checksum stays, and one of equal rows.
    Rows without shingles all stay.
    """
    grouped = _grouped(documents, percent, miss).where("comp IS NOT NULL")
    by_row = grouped.groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    # nulls last: a group is named by its least id that is there
    first = by_row.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key", "copies")).alias("w"))
    winners = first.select(F.col("w.doc_id").alias("won_id"), F.col("w.text_key").alias("won_key"), F.col("w.copies").alias("copies"))
    blank = F.coalesce(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))
    rows = documents.select(F.struct(*documents.columns).alias("whole"), blank.alias("blank"), F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long").alias("id"))
    picked = rows.where("NOT blank").join(winners, F.col("text_key").eqNullSafe(F.col("won_key")) & F.col("id").eqNullSafe(F.col("won_id")))
    picked = written(picked.select("whole", "won_id", "won_key", "copies"), "picked")
    single = picked.where("copies = 1").select("whole.*")
    repeated = picked.where("copies > 1").dropDuplicates(["won_id", "won_key"]).select("whole.*")
    return single.unionAll(repeated).unionAll(rows.where("blank").select("whole.*"))
