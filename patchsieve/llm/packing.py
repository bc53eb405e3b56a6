"""Best-fit packing into bins of several permitted sequence lengths.

Documents are measured in words plus one end mark. Longer ones than the largest capacity are cut into
pieces of that capacity and a rest. Pieces are dealt evenly to groups of bounded size by row, and every
group is packed on its own: pieces in descending order go to the open bin they leave the least room in;
of bins with equal room the first opened takes it; if none has room, a bin of the size that costs least
per token is opened; at the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import written

CAPACITIES = (256, 512, 1_024, 2_048, 4_096)
GROUP_ROWS = 20_000


def sequence_cost(capacity: int, overhead: float = 32, attention: float = 16_384) -> float:
    """Cost of one sequence: its positions, a fixed part, and attention over pairs of positions."""
    return overhead + capacity + capacity * capacity / attention


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every length, and the capacity of every bin.

    The free room of open bins is kept as a bit set, so that the least room that suffices is found
    without a search. Equal lengths are taken in the order given, and of bins with equal room the first
    opened is filled.
    """
    sizes = sorted(capacities)
    prices = [cost(c) for c in sizes]
    left = int(lengths.sum())
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    open_rooms, opened, used = 0, [], []
    for n in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[n])
        fitting = open_rooms >> need
        if fitting:
            space = need + (fitting & -fitting).bit_length() - 1
            b = heappop(room[space])
            if not room[space]:
                open_rooms ^= 1 << space
        else:
            # the price of a token if the bin is filled with what is left
            space = min((p / min(c, left), c) for c, p in zip(sizes, prices) if c >= need)[1]
            b = len(opened)
            opened.append(space)
            used.append(0)
        bins[n], offsets[n] = b, used[b]
        used[b] += need
        left -= need
        if space > need:
            rest = space - need
            if not room.setdefault(rest, []):
                open_rooms |= 1 << rest
            heappush(room[rest], b)
    final = [next(c for c in sizes if c >= u) for u in used]
    return bins, offsets, final


def packed(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: (doc_id, piece, first_token, n_tokens, bin_id, capacity, offset).

    A document has as many tokens as words (runs without white space) and one end mark, so null and
    empty texts have one. Its pieces hold its tokens without gaps; the pieces of a bin fill its offsets
    without gaps. Repeated rows are packed each. An empty table gives no rows.
    """
    words = F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0))
    largest = max(capacities)
    lengths = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("tokens")), "lengths")
    pieces = (
        lengths.withColumn("row", F.monotonically_increasing_id())
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / largest))))
        .select("doc_id", "row", "piece", (F.col("piece") * largest).alias("first_token"),
                F.least(F.lit(largest), F.col("tokens") - F.col("piece") * largest).cast("long").alias("n_tokens"))
    )
    total = lengths.agg(F.sum(F.ceil(F.col("tokens") / largest))).first()[0] or 0
    groups = max(1, -(-int(total) // group_rows))

    names = ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "capacity", "offset"]

    def one(rows: pa.Table) -> pa.Table:
        # in Arrow throughout, so that a null among the ids leaves the others as they are
        rows = rows.sort_by([("row", "ascending"), ("piece", "ascending")])
        bins, offsets, sizes = pack(rows.column("n_tokens").to_numpy(), capacities)
        ids = pa.array(rows.column("unit").to_numpy() * (1 << 32) + bins)
        kept = [rows.column(c) for c in ("doc_id", "piece", "first_token", "n_tokens")]
        return pa.table([*kept, ids, pa.array(np.array(sizes, np.int64)[bins]), pa.array(offsets)], names=names)

    dealt = pieces.withColumn("unit", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.groupBy("unit").applyInArrow(one, ", ".join(f"{c} long" for c in names))
