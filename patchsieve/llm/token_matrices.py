"""Packed matrices of token ids, by best fit decreasing with a segment tree over free room.

Every task encodes its documents, each ended by an end mark, cuts overlong ones into pieces of a whole
row and a rest, and packs its pieces in windows of bounded size: longest first, into the row with the
least room that suffices. Nothing is shuffled and a lost task is simply run again. A row of the matrix
holds its ids, the cumulative lengths of its segments and positions that begin anew with each of them.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import strings, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ROW_TOKENS, WINDOW_TOKENS, CHUNK = 2_048, 1_000_000, 50_000
ROWS_AT_ONCE = 128
# fixed value: the public split pattern of these byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _chunks(text: str) -> Iterator[str]:
    """A long text in parts that begin with a space where there is one, to bound the work on one part."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(" ", at + CHUNK // 2, at + CHUNK)
        cut = cut if cut > at else at + CHUNK
        yield text[at:cut]
        at = cut
    yield text[at:]


class Tokens:
    """Ids of texts by a rank file; the first free id ends a document."""

    def __init__(self, path: str):
        self.encoding = _encoding(path)
        self.end = self.encoding.n_vocab
        if self.end > 0xFFFF:
            raise ValueError("ids do not fit two bytes")

    def ids(self, text: str) -> np.ndarray:
        out = array("H")
        for part in _chunks(text):
            out.extend(self.encoding.encode_ordinary(part))
        out.append(self.end)
        return np.frombuffer(out, np.uint16)

    def text(self, ids: np.ndarray) -> str:
        return self.encoding.decode([i for i in ids.tolist() if i != self.end], errors="strict")


class RoomTree:
    """Which amounts of free room some open row has; the least of at least a wanted amount is found in
    as many steps as the capacity has bits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, wanted: int) -> tuple[int, int] | None:
        """A row of the least sufficient room, taken out, and that room."""
        node = wanted + self.leaves
        while not self.any[node]:
            # up until something lies to the right
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:
                return None  # past the last leaf of this level
            while not self.any[node] and not node & 1:
                node >>= 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The places of the lengths, row by row; equal lengths in the order given, none over the capacity."""
    tree, rows = RoomTree(capacity), []
    for n in sorted(range(len(lengths)), key=lambda n: -lengths[n]):
        found = tree.take(lengths[n])
        if found is None:
            rows.append([])
            found = len(rows) - 1, capacity
        row, room = found
        rows[row].append(n)
        if room > lengths[n]:
            tree.put(room - lengths[n], row)
    return rows


SCHEMA = """row_id long, ids binary, n_tokens int, cu_seqlens array<int>, positions binary,
            doc_ids array<bigint>, sources array<bigint>, pieces array<int>, first_tokens array<bigint>"""
_ARROW = pa.schema([
    ("row_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("sources", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("first_tokens", pa.list_(pa.int64()))])


def _pack(path: str, capacity: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        base = TaskContext.get().partitionId() << 33
        count, source = 0, 0
        waiting: list[tuple[int | None, int, int, int, np.ndarray]] = []  # doc_id, source, piece, first token, ids
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal count, waiting, held
            packed = best_fit_decreasing([len(w[4]) for w in waiting], capacity)
            for lo in range(0, len(packed), ROWS_AT_ONCE):
                out = []
                for row in packed[lo:lo + ROWS_AT_ONCE]:
                    pieces = [waiting[n] for n in row]
                    sizes = [len(p[4]) for p in pieces]
                    used = sum(sizes)
                    ids = np.full(capacity, tokens.end, "<u2")
                    ids[:used] = np.concatenate([p[4] for p in pieces])
                    positions = np.zeros(capacity, "<u2")
                    positions[:used] = np.concatenate([np.arange(n) for n in sizes])
                    out.append((base + count, ids.tobytes(), used, [0, *np.cumsum(sizes).tolist()], positions.tobytes(), *(
                        [p[k] for p in pieces] for k in range(4))))
                    count += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
            waiting, held = [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                ids = tokens.ids(text.as_py())
                for piece, first in enumerate(range(0, len(ids), capacity)):
                    part = ids[first:first + capacity]
                    waiting.append((doc_id, base + source, piece, first, part))
                    held += len(part)
                    if held >= window:
                        yield from rows()
                source += 1
        if waiting:
            yield from rows()
    return run


def token_matrices(documents: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Write the matrix rows of `documents` (doc_id, text) and read them again.

    (row_id, ids, n_tokens, cu_seqlens, positions, doc_ids, sources, pieces, first_tokens): ids and
    positions are row_tokens little-endian 16-bit numbers; what a row does not fill holds the end mark
    and position 0 and is not counted in n_tokens. Segment k of a row lies between cu_seqlens[k] and [k + 1] and
    holds a piece of doc_ids[k], from its token first_tokens[k] on; sources[k] tells apart rows that repeat an id.
    Null and empty texts are the end mark alone. `vocabulary` names a rank file that every executor can open.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(docs.mapInArrow(_pack(vocabulary, row_tokens, window_tokens), SCHEMA), "matrices")


def segments(matrices: DataFrame) -> DataFrame:
    """One row per segment as it stands in the written matrices.

    (doc_id, source, piece, first_token, n_tokens, row_id, offset, ids_crc32, resets): ids_crc32 is the
    checksum of the segment's ids as stored, resets whether its positions run from 0 to its length.
    """
    parts = matrices.select("row_id", "ids", "positions", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "sources", "pieces", "first_tokens")).alias("k", "s"))
    parts = parts.withColumn("offset", F.get("cu_seqlens", "k")).withColumn("n_tokens", F.get("cu_seqlens", F.col("k") + 1) - F.col("offset"))
    cut = lambda c, a, n: F.expr(f"substring({c}, cast(2 * ({a}) + 1 as int), cast(2 * ({n}) as int))")

    def number(column: str, at: str):
        low_first = F.hex(cut(column, at, "1"))
        return F.conv(F.concat(low_first.substr(3, 2), low_first.substr(1, 2)), 16, 10).cast("int")

    last = number("positions", "offset + n_tokens - 1")
    return parts.select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.sources").alias("source"), F.col("s.pieces").alias("piece"), F.col("s.first_tokens").alias("first_token"),
        "n_tokens", "row_id", "offset", F.crc32(cut("ids", "offset", "n_tokens")).alias("ids_crc32"),
        ((number("positions", "offset") == 0) & (last == F.col("n_tokens") - 1)).alias("resets"))


def texts(matrices: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, text) from the matrices: the pieces of each document joined and decoded."""
    parts = matrices.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "sources", "first_tokens")).alias("k", "s"))
    ids = F.expr("substring(ids, 2 * get(cu_seqlens, k) + 1, 2 * (get(cu_seqlens, k + 1) - get(cu_seqlens, k)))")
    parts = parts.select(F.col("s.sources").alias("source"), F.struct(F.col("s.first_tokens").alias("first"), ids.alias("ids")).alias("part"), F.col("s.doc_ids").alias("doc_id"))
    whole = parts.groupBy("source").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("part")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        for batch in batches:
            out = [tokens.text(np.frombuffer(b"".join(p["ids"] for p in row), "<u2")) for row in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(out, pa.string())], names=["doc_id", "source", "text"])

    return whole.select("doc_id", "source", "parts").mapInArrow(run, "doc_id long, source long, text string")
