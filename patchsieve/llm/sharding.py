"""Shards of near equal bytes by histogram sort.

Documents are ordered by id, rows of one id by their number in the table. Exact bytes and rows are
counted below candidate boundaries; the cells that hold a boundary still out of tolerance are cut
finer until every splitter is within it or next to the row that covers its target. Then the rows are
exchanged once, in ranges of that order, and numbered without gaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchsieve.llm.common import written

PROBES = 256
LEAST_KEY = -(1 << 63)


@dataclass
class _Cell:
    """Rows with a key in [lo, hi], or of the single key lo with a number in [first, last]."""

    lo: int
    hi: int
    first: int
    last: int
    size: int
    rows: int

    def holds(self) -> Column:
        inside = F.col("key").between(self.lo, self.hi)
        return inside if self.lo < self.hi else inside & F.col("row").between(self.first, self.last)

    def probe(self) -> Column:
        column, lo, hi = ("key", self.lo, self.hi) if self.lo < self.hi else ("row", self.first, self.last)
        step = (hi - lo) // PROBES + 1
        return F.expr(f"cast(({column} - {_long(lo)}) div {_long(step)} as int)")

    def splittable(self) -> bool:
        return self.rows > 1


def _long(n: int) -> str:
    return f"({n}L)" if n > LEAST_KEY else "(-9223372036854775807L - 1L)"


def _totals() -> list[Column]:
    return [F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"),
            F.min("row").alias("first"), F.max("row").alias("last")]


def _cell(r) -> _Cell:
    return _Cell(r["lo"], r["hi"], r["first"], r["last"], int(r["size"]), r["rows"])


def _refined(rows: DataFrame, cells: list[_Cell]) -> list[list[_Cell]]:
    """Each cell cut at its probes, with exact totals; empty cells are left out."""
    which = probe = None
    for n, cell in enumerate(cells):
        inside = cell.holds()
        which = F.when(inside, n) if which is None else which.when(inside, n)
        probe = F.when(inside, cell.probe()) if probe is None else probe.when(inside, cell.probe())
    out: list[list[_Cell]] = [[] for _ in cells]
    found = rows.select(which.alias("cell"), probe.alias("probe"), "size", "key", "row").where("cell IS NOT NULL")
    for r in found.groupBy("cell", "probe").agg(*_totals()).orderBy("cell", "probe").collect():  # at most cells x probes
        out[r["cell"]].append(_cell(r))
    return out


def splitters(rows: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int, int]]:
    """parts - 1 boundaries (key, row, rows below): a shard begins with the first row at or after its boundary.

    `rows` has key, row (both long, row unique) and size.
    """
    halves = rows.groupBy((F.col("key") >= 0).alias("up")).agg(*_totals()).orderBy("up").collect()
    cells = [_cell(r) for r in halves]  # no cell is wider than a long can tell
    total = sum(c.size for c in cells)
    slack = int(total / parts * tolerance)
    end = (1 << 63) - 1, (1 << 63) - 1, sum(c.rows for c in cells)
    while True:
        result, open_cells = [], []
        for part in range(1, parts):
            target = total * part // parts
            below = count = 0
            for n, cell in enumerate(cells):
                if below + cell.size <= target:
                    below += cell.size
                    count += cell.rows
                    continue
                start = cell.lo, (cell.first if cell.lo == cell.hi else LEAST_KEY), count
                stop = end if n + 1 == len(cells) else (
                    cells[n + 1].lo, (cells[n + 1].first if cells[n + 1].lo == cells[n + 1].hi else LEAST_KEY), count + cell.rows)
                to_start, to_stop = target - below, below + cell.size - target
                if cell.splittable() and min(to_start, to_stop) > slack:
                    open_cells.append(n)
                result.append(start if to_start <= to_stop else stop)
                break
            else:
                result.append(end)
        if not open_cells:
            return result
        chosen = sorted(set(open_cells))
        finer = dict(zip(chosen, _refined(rows, [cells[n] for n in chosen])))
        cells = [c for n, cell in enumerate(cells) for c in finer.get(n, [cell])]


def sharded(documents: DataFrame, shards: int = 24, tolerance: float = 1e-4) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `documents` (doc_id, text).

    size is the bytes of the text plus 8, null texts count as empty. A shard's bytes differ from the
    mean by at most the tolerance, or by the rows at its ends. Shards follow the order of ids, null ids first;
    rows that repeat an id may part. An empty table gives no rows; with fewer rows than shards some stay empty.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sizes = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = written(sizes.withColumn("key", F.coalesce("doc_id", F.lit(LEAST_KEY))).withColumn("row", F.monotonically_increasing_id()), "sizes")
    bounds = splitters(rows, shards, tolerance)
    shard, before = F.lit(0), F.lit(0).cast("long")
    for key, row, below in bounds:
        # a later boundary at the same place leaves the shard between empty
        at_or_after = (F.col("key") > F.lit(key)) | ((F.col("key") == F.lit(key)) & (F.col("row") >= F.lit(row)))
        shard = shard + at_or_after.cast("int")
        before = F.greatest(before, F.when(at_or_after, F.lit(below)).otherwise(F.lit(0)).cast("long"))
    placed = rows.select("doc_id", "size", "text_crc32", "key", "row", shard.alias("shard"), before.alias("before"))
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = placed.repartitionByRange(partitions, "key", "row").sortWithinPartitions("key", "row")
    # the number of a row in its partition is the lower part of Spark's row id
    numbered = written(in_order.select(
        "doc_id", "size", "text_crc32", "shard", "before", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ordered")
    counts = numbered.groupBy("part").agg(F.count("*").alias("rows"))  # one row per partition
    ahead = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", ahead.alias("ahead"))
    return numbered.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("ahead") + F.col("place") - F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
