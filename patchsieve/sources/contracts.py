"""Reports on example tables: manifest, contract checks, fingerprints, comparisons, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.functions.paths import extension
from patchsieve.operators.frames import beside, first_rows, percentiles
from patchsieve.operators.metrics import share

CHANGE_SIZE, FILE_SIZE, EXPERIMENTAL_SIZE, SHA_LENGTH = 29, 16, 6, 40  # fixed values: lengths of the contract
ATTRIBUTED = ("explicit_sha_reference", "revert", "line_overlap", "ambiguous")


def dataset_manifest(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """One row of totals: labels, splits, time range, attributions by source of the changes."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    supervised = F.col("label_status") != "ambiguous"
    files = rows.agg(
        F.count(F.lit(1)).alias("file_examples"),
        *[is_("label_status", s).alias(f"{s}_examples") for s in ("positive", "negative", "ambiguous")],
        *[F.count_if(supervised & (F.col("split") == s)).alias(f"{s}_examples") for s in ("train", "validation", "test")],
    )
    per_change = changes.agg(
        F.count(F.lit(1)).alias("commits"), F.min("commit_timestamp").alias("time_start"), F.max("commit_timestamp").alias("time_end"),
        *[is_("split", s).alias(f"{s}_commits") for s in ("train", "validation", "test")],
        *[is_("label_source", s).alias(f"{s}_attributions") for s in ATTRIBUTED],
    )
    return beside(files, per_change).withColumn("positive_rate", share(F.col("positive_examples"), F.col("file_examples")))


def extension_histogram(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Files per extension; both counts of the manifest count files."""
    ext = extension(F.col(path))
    name = F.when(ext == "", "unknown").otherwise(F.concat(F.lit("."), ext))
    return files.groupBy(name.alias("extension")).agg(
        F.count(F.lit(1)).alias("commits_per_language"), F.count(F.lit(1)).alias("examples_per_language")
    )


def validate_contract(
    rows: DataFrame, key: list[str], version: str, change_size: int = CHANGE_SIZE, file_size: int = FILE_SIZE,
    sha_length: int = SHA_LENGTH,
) -> DataFrame:
    """One row of violation counts; all zero for a sound table."""
    low = lambda c: F.exists(c, lambda x: x < 0)
    bad_number = lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col("label_status") == "ambiguous") | (F.col("defect_label") == -1)).alias("ambiguous"),
        F.count_if(F.size("commit_features") != change_size).alias("bad_change_size"),
        F.count_if(F.size("file_features") != file_size).alias("bad_file_size"),
        F.count_if(F.coalesce(F.col("feature_version") != version, F.lit(True))).alias("bad_version"),
        F.count_if(low("commit_features") | low("file_features")).alias("negative"),
        F.count_if(bad_number("commit_features") | bad_number("file_features")).alias("not_a_number"),
        F.count_if(F.length("commit_sha") != sha_length).alias("bad_sha"),
    )
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )
    return beside(counts, repeated)


def validate_experimental(rows: DataFrame, base: DataFrame, key: list[str], version: str, size: int = EXPERIMENTAL_SIZE) -> DataFrame:
    """One row of violation counts of the experimental vectors; all zero but the rows for a sound table.

    ``unmatched`` counts rows without a row of ``base``, the examples that they describe.
    """
    vector = "experimental_features"
    low = F.exists(vector, lambda x: x < 0)
    bad_number = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # one pass over the rows: the counts of a key, then of all; a null vector has no size
    keys = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.size(vector) != size, F.lit(True))).alias("bad_size"),
        F.count_if(F.coalesce(F.col("experimental_feature_version") != version, F.lit(True))).alias("bad_version"),
        F.count_if(low).alias("negative"), F.count_if(bad_number).alias("not_a_number"),
    )
    known = base.select(*key).distinct().withColumn("__known", F.lit(True))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return keys.join(known, key, "left").agg(
        total("n").alias("rows"), *[total(c).alias(c) for c in ("bad_size", "bad_version", "negative", "not_a_number")],
        total(F.col("n") - 1).alias("duplicates"), total(F.when(F.col("__known").isNull(), F.col("n"))).alias("unmatched"))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One SHA-256 over the content, whatever the order and the partitions.

    Rows become canonical JSON and a digest; equal rows are counted first, so
    repeated rows cannot gather in one task. The digests are folded in a tree of
    fixed shape by their leading hex digits.
    """
    names = sorted(columns or df.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    counted = df.select(row.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    leaf = counted.select(F.concat_ws(":", "d", F.col("n").cast("string")).alias("d"))
    fold = lambda frame, *by: frame.groupBy(*by).agg(
        F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("d"))), 256).alias("d"))
    six = fold(leaf.withColumn("p", F.substring("d", 1, 6)), "p")
    three = fold(six.select("d", F.substring("p", 1, 3).alias("p")), "p")
    return fold(three).select(F.col("d").alias("digest"), F.substring("d", 1, 16).alias("short"))


def verify_fingerprint(df: DataFrame, expected: str | None, columns: list[str] | None = None) -> None:
    if not expected:
        raise ValueError("no fingerprint to compare with")
    found = fingerprint(df, columns).first()["digest"]
    if found != expected:
        raise ValueError(f"fingerprint differs: expected {expected}, got {found}")


def compare_runs(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row: keys missing on either side and keys with unequal values."""
    pack = lambda df, mark: df.select(*key, F.struct(*values).alias(mark))
    both = pack(left, "l").join(pack(right, "r"), key, "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col("l").eqNullSafe(F.col("r"))).alias("unequal"),
    )


def feature_summary(rows: DataFrame, vector: str, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Per feature (and group): ends, mean, median, non-zero, zero and negative counts."""
    by = by or []
    long = rows.select(*by, F.posexplode(vector).alias("i", "value")).select(
        *by, F.get(F.array(*map(F.lit, names)), F.col("i")).alias("feature"), "value"
    )
    keys = [*by, "feature"]
    v = F.col("value")
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.count_if(v > 0).alias("nonzero"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"),
    )
    joined = stats.join(percentiles(long, keys, "value", {"median": 0.5}), keys)
    return joined.withColumn("nonzero_pct", F.round(F.lit(100.0) * F.col("nonzero") / F.col("n"), 2))


def nonzero_by(rows: DataFrame, vector: str, names: list[str], by: str) -> DataFrame:
    long = rows.select(by, F.posexplode(vector).alias("i", "value")).where(F.col("value") > 0)
    return long.groupBy(by, F.get(F.array(*map(F.lit, names)), F.col("i")).alias("feature")).agg(F.count(F.lit(1)).alias("nonzero"))


def audit_sample(rows: DataFrame, order: list[str], sizes: dict[int, int], cut: dict[str, int]) -> DataFrame:
    """The first rows of each label in stored order, long texts cut."""
    top = first_rows(rows, ["defect_label"], [F.col(c) for c in order], max(sizes.values()), "place")
    limit = F.lit(0)
    for label, n in sizes.items():
        limit = F.when(F.col("defect_label") == label, n).otherwise(limit)
    out = top.where(F.col("place") <= limit)
    for column, length in cut.items():
        out = out.withColumn(column, F.substring(column, 1, length))
    return out
