"""Ordered frames that stay balanced when one group holds much of the table.

A plain ``Window.partitionBy(group)`` puts a whole group into one task. Here every
group of more than its share of the rows is cut into ordered slices at sampled
split values; a slice is a window partition of its own, and the totals of the
earlier slices are added afterwards. Samples, sizes and split values are part of
the plan: nothing is collected, and there is one route for every input. The share
follows the rows and the shuffle partitions, and is no less than what a task sorts
with ease (``patchsieve.sliceRows``); the split values only decide how the work is
spread. Samples, slice totals and offsets hang on the large groups by inner joins:
where there is none, adaptive execution finds those branches empty and skips them.

Order columns are given in ascending form (negate a number to sort it
downwards) and must be unique within a group. Null group values are a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchsieve.session import cut_lineage, new_folder

SLICES_PER_PARTITION = "patchsieve.slicesPerPartition"
SLICE_ROWS = "patchsieve.sliceRows"
_DEFAULT_SLICES = 4
_DEFAULT_ROWS = 250_000
_SAMPLES_PER_SLICE = 40


def _slice_count(df: DataFrame) -> int:
    """Into how many slices a table is cut that is one group."""
    conf = df.sparkSession.conf
    return int(conf.get(SLICES_PER_PARTITION, str(_DEFAULT_SLICES))) * int(conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows evenly to all partitions before heavy work per row.

    Long texts are not spread evenly over the splits of a scan, and a small file may be one split.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def reused(df: DataFrame) -> DataFrame:
    """A compact table that several passes read: written once, a reliable checkpoint in the shared folder."""
    return cut_lineage(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """A wide table that several passes read in part: written once as Parquet in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, columns: list[str], bits: dict[str, int], scale: dict[str, int] | None = None) -> DataFrame:
    """``columns``, and the columns named in ``bits`` in one long (__few): a shuffled row has eight bytes for each column.

    A row with a null, negative, fractional or larger number has all of them in an array beside (__many), so nothing is
    lost; ``bits`` (63 in all) and ``scale`` (numbers that are whole hundredths, say) only decide how much a row takes.
    """
    at, parts, fit, whole = 0, [], [], {}
    for name, width in bits.items():
        times = (scale or {}).get(name)
        whole[name] = (F.rint(F.col(name) * times) if times else F.col(name)).try_cast("long")
        n = F.col(f"__w_{name}")
        fit.append(F.coalesce(n.between(0, (1 << width) - 1) & ((n / times if times else n) == F.col(name)), F.lit(False)))
        parts.append(F.shiftleft(n, at))
        at += width
    all_of = reduce(lambda a, b: a & b, fit)
    # step by step, so that no expression is repeated
    df = df.select(*columns, *bits, *[w.alias(f"__w_{n}") for n, w in whole.items()]).withColumn("__fits", all_of)
    kind = "double" if scale else "long"
    return df.select(
        *columns, F.when(F.col("__fits"), reduce(lambda a, b: a.bitwiseOR(b), parts)).alias("__few"),
        F.when(~F.col("__fits"), F.array(*[F.col(n).cast(kind) for n in bits])).alias("__many"))


def unpacked(bits: dict[str, int], scale: dict[str, int] | None = None, few: str = "__few", many: str = "__many") -> dict[str, Column]:
    """The values of ``packed``: longs, or doubles where there is a ``scale``."""
    at, out = 0, {}
    for i, (name, width) in enumerate(bits.items()):
        whole = F.shiftright(few, at).bitwiseAND(F.lit((1 << width) - 1))
        whole = whole / F.lit(float(scale.get(name, 1))) if scale else whole
        out[name] = F.when(F.col(few).isNotNull(), whole).otherwise(F.get(many, F.lit(i)))
        at += width
    return out


def _group_columns(group: list[str]) -> list[Column]:
    return [F.col(c) for c in group] if group else [F.lit(0)]


def _by_group(left: DataFrame, right: DataFrame, group: list[str], how: str) -> DataFrame:
    """Join on the group, nulls equal; the right side's group columns go.

    A right side for slices has rows for slices alone, and a null slice is none.
    """
    if not group:
        return left.join(right, F.lit(True), how)
    other = right.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], *[c for c in right.columns if c not in group])
    match = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return left.join(F.broadcast(other), condition, how).drop(*[f"__g{i}" for i in range(len(group))])


def _splits(df: DataFrame, group: list[str], order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Group columns of the large groups and __splits, sorted order structs.

    Sizes are told from a sample, picked by a hash of the order values so that it is repeatable; it is
    dense enough for the smallest slice, and what follows works on the sample alone. A group is large if it
    has more rows than a slice; there are about as many such groups as slices at most, and the samples
    that become splits are a fixed number for each slice. ``by`` names the columns to pick by instead of all
    order values: scans below a join can then leave out the rows that are not picked.
    """
    slices = _slice_count(df)
    least = int(df.sparkSession.conf.get(SLICE_ROWS, str(_DEFAULT_ROWS)))
    rate = max(1, least // _SAMPLES_PER_SLICE)
    value = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keyed = df.select(*group, value.alias("__o"), F.xxhash64(*by if by else [value]).alias("__h"))
    sampled = keyed.where(F.pmod("__h", F.lit(rate)) == 0)
    sizes = sampled.groupBy(*group).agg((F.count(F.lit(1)) * rate).alias("__n"))
    aim = sizes.agg(F.greatest(F.lit(least), F.floor(F.sum("__n") / slices)).alias("__aim"))
    large = beside(sizes.where(F.col("__n") > least), aim).where(F.col("__n") > F.col("__aim"))
    every = F.greatest(F.lit(1), F.floor(F.col("__aim") / (_SAMPLES_PER_SLICE * rate)))
    picked = _by_group(sampled, large.select(*group, "__aim"), group, "inner").where(F.pmod(F.floor(F.col("__h") / rate), every) == 0)
    per = F.greatest(F.lit(1), F.least(F.lit(_SAMPLES_PER_SLICE), F.max("__aim"))).cast("int")
    found = picked.groupBy(*group).agg(F.array_sort(F.collect_list("__o")).alias("__s"), per.alias("__per"))
    # without a group this aggregation has a row even if nothing is large
    return found.where(F.col("__per").isNotNull() & (F.size("__s") > 0)).select(
        *group, F.filter("__s", lambda s, i: (i % F.col("__per")) == F.col("__per") - 1).alias("__splits"))


def _below(splits: Column, value: Column, most: int) -> Column:
    """How many of the sorted splits (at most ``most``) are not above a value, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])

    def step(at: Column, n: Column) -> Column:
        further = (at + n <= F.size(splits)) & (F.get(splits, at + n - 1) <= value)
        return F.when(further, at + n).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _sliced(df: DataFrame, group: list[str], order: list[Column], splits: DataFrame, how: str) -> DataFrame:
    """Add the order values as a struct (__o) and __slice.

    Groups that are not cut have a null slice; an inner join leaves them out. Windows are ordered by the order
    columns themselves, so that a row is not shuffled and sorted with copies of its own values.
    """
    keyed = df.select("*", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__o"))
    keyed = _by_group(keyed, splits, group, how)
    # samples vary, so there may be more splits than slices
    at = _below(F.col("__splits"), F.col("__o"), 4 * _slice_count(df) + 64)
    return keyed.select(*[c for c in keyed.columns if c != "__splits"], F.when(F.col("__splits").isNotNull(), at).alias("__slice"))


def frame(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    *,
    row: str | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    peaks: dict[str, Column] | None = None,
    inclusive: bool = False,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Add ordered and whole-group values per group.

    ``row``     1-based position in the order
    ``sums``    running sums over the rows before (with ``inclusive``: up to) this one
    ``lasts``   last non-null value before (with ``inclusive``: up to) this row
    ``maxes``   largest value before (with ``inclusive``: up to) this row
    ``totals``  sums over the whole group
    ``peaks``   largest value of the whole group
    ``sample``  table with the group and order columns of about these rows, cheap to read: split values are told from it

    Rows that are dealt by columns of the group already are not dealt again, so one task orders all slices of a group then.
    """
    sums, lasts, maxes, totals, peaks = sums or {}, lasts or {}, maxes or {}, totals or {}, peaks or {}
    columns = df.columns
    end = 0 if inclusive else -1
    splits = _splits(df if sample is None else sample, group, order)
    cut = _sliced(df, group, order, splits, "inner")
    df = _sliced(df, group, order, splits, "left")
    base = Window.partitionBy(*_group_columns(group), "__slice")
    ordered = base.orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, end)
    inner = df.select(
        *columns,
        "__slice",
        *([F.row_number().over(ordered).cast("long").alias("__r")] if row else []),
        *[F.coalesce(F.sum(e).over(running), F.lit(0)).alias(f"__s_{n}") for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(running).alias(f"__l_{n}") for n, e in lasts.items()],
        *[F.max(e).over(running).alias(f"__m_{n}") for n, e in maxes.items()],
        *[F.sum(e).over(base).alias(f"__t_{n}") for n, e in totals.items()],
        *[F.max(e).over(base).alias(f"__p_{n}") for n, e in peaks.items()],
    )
    per_slice = (
        cut.groupBy(*group, "__slice")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.sum(e).alias(f"__ps_{n}") for n, e in sums.items()],
            *[F.max(F.when(e.isNotNull(), F.struct(F.col("__o"), e.alias("v")))).alias(f"__pl_{n}")
              for n, e in lasts.items()],
            *[F.max(e).alias(f"__pm_{n}") for n, e in maxes.items()],
            *[F.sum(e).alias(f"__pt_{n}") for n, e in totals.items()],
            *[F.max(e).alias(f"__pp_{n}") for n, e in peaks.items()],
        )
    )
    whole = Window.partitionBy(*_group_columns(group))
    before = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *group,
        F.col("__slice"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__on"),
        *[F.coalesce(F.sum(f"__ps_{n}").over(before), F.lit(0)).alias(f"__os_{n}") for n in sums],
        *[F.max(f"__pl_{n}").over(before)["v"].alias(f"__ol_{n}") for n in lasts],
        *[F.max(f"__pm_{n}").over(before).alias(f"__om_{n}") for n in maxes],
        *[F.sum(f"__pt_{n}").over(whole).alias(f"__ot_{n}") for n in totals],
        *[F.max(f"__pp_{n}").over(whole).alias(f"__op_{n}") for n in peaks],
    )
    # rows of groups that are not cut have a null slice and meet no offset
    joined = _by_group(inner, offsets, [*group, "__slice"], "left")
    zero = F.lit(0)
    return joined.select(
        *columns,
        *([(F.col("__r") + F.coalesce("__on", zero)).alias(row)] if row else []),
        *[(F.col(f"__s_{n}") + F.coalesce(f"__os_{n}", zero)).alias(n) for n in sums],
        *[F.coalesce(f"__l_{n}", f"__ol_{n}").alias(n) for n in lasts],
        *[F.greatest(f"__m_{n}", f"__om_{n}").alias(n) for n in maxes],
        *[F.coalesce(f"__ot_{n}", f"__t_{n}").alias(n) for n in totals],
        *[F.coalesce(f"__op_{n}", f"__p_{n}").alias(n) for n in peaks],
    )


def number_rows(df, group, order, name="row"):
    return frame(df, group, order, row=name)


def with_previous(
    df: DataFrame, group: list[str], order: list[Column], n: int, entry: Column, name: str
) -> DataFrame:
    """Add the entries of the last n rows up to this one, oldest first, as an array.

    In a group that is cut, a slice is handed the last n - 1 entries before it, which are found among the
    last n - 1 rows of every slice.
    """
    columns = df.columns
    splits = _splits(df, group, order)
    slices = Window.partitionBy(*_group_columns(group), "__slice")
    whole = Window.partitionBy(*_group_columns(group))
    cut = _sliced(df.withColumn("__e", entry), group, order, splits, "inner")
    last = cut.withColumn("__back", F.row_number().over(slices.orderBy(F.desc("__o")))).where(F.col("__back") < n)
    ends = last.withColumn("__ends", F.collect_list("__e").over(whole.orderBy("__o").rowsBetween(2 - n, 0))).where(F.col("__back") == 1)
    carried = ends.select(*group, "__slice", F.lag("__ends").over(whole.orderBy("__slice")).alias("__carry"))
    out = _sliced(df.withColumn("__e", entry), group, order, splits, "left")
    out = out.select(*columns, "__slice", F.collect_list("__e").over(slices.orderBy(*order).rowsBetween(1 - n, 0)).alias("__own"))
    both = F.concat(F.coalesce("__carry", F.slice("__own", 1, 0)), "__own")
    recent = F.slice(both, F.greatest(F.lit(1), F.size(both) - n + 1), n)
    return _by_group(out, carried, [*group, "__slice"], "left").select(*columns, F.when(F.col("__slice").isNull(), F.col("__own")).otherwise(recent).alias(name))


def with_last(
    df: DataFrame, group: list[str], order: list[Column], n: int, entry: Column, name: str,
    sample: DataFrame | None = None, by: list[str] | None = None,
) -> DataFrame:
    """Add the last n entries up to each row, oldest first, as an array; rows whose entry is null are not counted.

    A row looks back over its nearest entries in the one order of the slice. In a group that is cut, a
    slice is handed the last n entries before it, found among the last n of every slice.
    With a ``sample`` (see ``frame``, picked ``by`` some of its columns) entries are made after the rows are dealt.
    """
    columns = df.columns
    splits = _splits(df if sample is None else sample, group, order, by)
    slices = Window.partitionBy(*_group_columns(group), "__slice")
    whole = Window.partitionBy(*_group_columns(group))
    cut = _sliced(df.withColumn("__e", entry).where(F.col("__e").isNotNull()), group, order, splits, "inner")
    last = cut.withColumn("__back", F.row_number().over(slices.orderBy(F.desc("__o")))).where(F.col("__back") <= n)
    ends = last.withColumn("__ends", F.collect_list("__e").over(whole.orderBy("__o").rowsBetween(1 - n, 0))).where(F.col("__back") == 1)
    # a slice without entries has no row here, so a slice looks for the nearest one before it that has
    ends = ends.select(*group, F.col("__slice").alias("__from"), "__ends")
    if sample is None:
        out = _sliced(df.withColumn("__e", entry), group, order, splits, "left")
    else:
        out = _sliced(df, group, order, splits, "left").drop("__o").repartition(*_group_columns(group), "__slice").withColumn("__e", entry)
    ordered = slices.orderBy(*order)
    near = [F.expr(f"lag(__e, {k}) IGNORE NULLS").over(ordered).alias(f"__e{k}") for k in range(n, 0, -1)]
    own = F.array_compact(F.array(*[F.col(f"__e{k}") for k in range(n, 0, -1)], F.col("__e")))
    counted = out.select(*columns, "__slice", "__e", *near).select(*columns, "__slice", own.alias("__own"))
    carried = ends.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__from", "__ends"))).alias("__all"))
    before = F.filter("__all", lambda x: x["__from"] < F.col("__slice"))
    carry = F.try_element_at(before, F.lit(-1))["__ends"]
    both = F.concat(F.coalesce(carry, F.slice("__own", 1, 0)), "__own")
    recent = F.slice(both, F.greatest(F.lit(1), F.size(both) - n + 1), n)
    joined = _by_group(counted, carried, group, "left")
    own = F.slice("__own", F.greatest(F.lit(1), F.size("__own") - n + 1), n)
    return joined.select(*columns, F.when(F.col("__slice").isNull(), own).otherwise(recent).alias(name))


def number_within(df: DataFrame, group: list[str], order: list[Column], name: str = "row") -> DataFrame:
    """Row numbers of rows that are dealt by columns of the group: one window, no slices."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*_group_columns(group)).orderBy(*order)).cast("long"))


def first_rows(df: DataFrame, group: list[str], order: list[Column], k: int, name="row") -> DataFrame:
    """First k rows per group; Spark keeps only k rows per group before the shuffle."""
    w = Window.partitionBy(*_group_columns(group)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def percentiles(df: DataFrame, group: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group, nulls left out."""
    return summary(df, group, value, points, {})


def summary(
    df: DataFrame, group: list[str], value: str, points: dict[str, float], moments: dict[str, str]
) -> DataFrame:
    """Exact percentiles and moments of a column in one pass, one row per group.

    ``moments`` names count, mean, std (population), min, max. Equal values are
    counted before anything is ordered; the position of a percentile is then found
    in the running count, so no task and no hash map holds the values of a whole
    group. Nulls are left out.
    """
    known = df.where(F.col(value).isNotNull())
    counted = known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    v, c = F.col(value).cast("double"), F.col("__c")
    placed = frame(
        counted, group, [F.col(value)], sums={"__cum": c}, totals={"__all": c, "__sum": v * c}, inclusive=True,
    )
    off = v - F.col("__sum") / F.col("__all")
    weighted = {
        "count": F.max("__all"), "mean": F.max(F.col("__sum") / F.col("__all")),
        "std": F.sqrt(F.sum(c * off * off) / F.max("__all")), "min": F.min(v), "max": F.max(v),
    }
    def at(index: Column) -> Column:
        return F.min(F.when(F.col("__cum") > index, F.col(value)))
    out = [weighted[kind].alias(n) for n, kind in moments.items()]
    for name, p in points.items():
        position = (F.col("__all") - 1) * F.lit(float(p))
        low, high = at(F.floor(position)), at(F.ceil(position))
        part = F.max(position - F.floor(position))
        out.append((low + (high - low) * part).cast("double").alias(name))
    return placed.groupBy(*group).agg(*out)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an ungrouped aggregate, which has exactly one row, to every row."""
    return df.join(F.broadcast(one_row), F.lit(True), "inner")
