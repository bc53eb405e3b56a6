"""Reading and writing of labelled file rows, with resume and merge of partial work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["commit_sha", "file_path"]

EXAMPLES = T.StructType([
    T.StructField("dataset_version", T.StringType()),
    T.StructField("repo_url", T.StringType()),
    T.StructField("repo_name", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("commit_timestamp", T.TimestampType()),
    T.StructField("commit_message", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_status", T.StringType()),
    T.StructField("feature_version", T.StringType()),
    T.StructField("commit_features", T.ArrayType(T.DoubleType())),
    T.StructField("file_features", T.ArrayType(T.DoubleType())),
    T.StructField("label_status", T.StringType()),
    T.StructField("defect_label", T.IntegerType()),
    T.StructField("label_confidence", T.DoubleType()),
    T.StructField("label_source", T.StringType()),
    T.StructField("label_evidence", T.StringType()),
    T.StructField("split", T.StringType()),
])
EXPERIMENTAL = T.StructType([
    T.StructField("commit_sha", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("experimental_feature_version", T.StringType()),
    T.StructField("experimental_features", T.ArrayType(T.DoubleType())),
])
SPLITS = ("train", "validation", "test")
# fixed values: experimental features of each mode, 1-based start and length
MODES = {"E0": (1, 0), "E1": (1, 3), "E2": (4, 3), "E4": (1, 6)}
EXPERIMENTAL_SIZE = 6
RECORDS = 500_000  # fixed value: rows of a compressed file, which one task reads


def read_examples(spark: SparkSession, paths: list[str], schema: T.StructType = EXAMPLES) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a bad row is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_checkpoint_lenient(spark: SparkSession, paths: list[str], schema: T.StructType = EXPERIMENTAL) -> DataFrame:
    """JSON lines whose very last record of a file may be cut off; a bad record elsewhere is an error.

    The place of a line in its file is (block start, running id within the block),
    so large files stay split.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("place"),
    ).where(F.trim("value") != "")
    parsed = lines.withColumn(
        "row", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    ).withColumn("bad", F.col("row").isNull() | F.col("row._corrupt_record").isNotNull())
    ends = parsed.groupBy("file").agg(
        F.max("place").alias("last"), F.max(F.when(F.col("bad"), F.col("place"))).alias("bad_at"), F.count_if("bad").alias("n_bad")
    )
    broken = ends.where((F.col("n_bad") > 1) | ((F.col("n_bad") == 1) & (F.col("bad_at") != F.col("last")))).select("file").head()
    if broken is not None:
        raise ValueError(f"malformed record inside {broken['file']}")
    return parsed.where(~F.col("bad")).select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields])


def write_examples(df: DataFrame, out: str, order: tuple[str, ...] = ("repo_name", "commit_sha", "file_path")) -> None:
    """Supervised rows by split, ambiguous rows to a sink of their own, in a fixed order.

    The rows are range partitioned by split and order, so a large split is written
    by many tasks; the committer makes each sink appear as a whole. The files are
    compressed and hold ``RECORDS`` rows at most, so that a large split is read by
    many tasks, too.
    """
    def put(rows: DataFrame, folder: str, keys: list[str]) -> None:
        ranged = rows.repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)
        writer = ranged.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", RECORDS)
        if "split" in keys:
            writer = writer.partitionBy("split")
        writer.json(folder)

    ambiguous = F.col("label_status") == "ambiguous"
    put(df.where(~ambiguous), f"{out}/supervised", ["split", *order])
    put(df.where(ambiguous), f"{out}/ambiguous", list(order))


def mark_malformed(rows: DataFrame, size: int, vector: str = "file_features") -> DataFrame:
    """All rows, with `malformed` true where the vector is null or not of `size` numbers."""
    return rows.withColumn("malformed", F.coalesce(F.size(vector) != size, F.lit(True)))


def malformed_per_change(rows: DataFrame) -> DataFrame:
    """(commit_sha, files, malformed) from marked rows: how many files of a change have no usable vector."""
    return rows.groupBy("commit_sha").agg(F.count(F.lit(1)).alias("files"), F.count_if("malformed").alias("malformed"))


def assemble_features(base: DataFrame, experimental: DataFrame, mode: str, file_size: int | None = None) -> DataFrame:
    """One vector per row: change, file and chosen experimental features, zeros where none are known.

    With `file_size` no row is lost either: those whose file vector has another size get a null vector
    and `malformed`.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    start, length = MODES[mode]
    zeros = F.array_repeat(F.lit(0.0), EXPERIMENTAL_SIZE)
    joined = base.join(experimental.select(*KEY, "experimental_features"), KEY, "left")
    chosen = F.slice(F.coalesce("experimental_features", zeros), start, length)
    vector = F.concat("commit_features", "file_features", chosen)
    if file_size is not None:
        joined = mark_malformed(joined, file_size)
        vector = F.when(~F.col("malformed"), vector)
    return joined.withColumn("vector", vector).drop("experimental_features")


def resume_todo(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows still to do; a change without open rows drops out as a whole."""
    return rows.join(done.select(*KEY).distinct(), KEY, "left_anti")


def done_groups(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Changes all of whose files are done."""
    marked = rows.select(*KEY).distinct().join(done.select(*KEY, F.lit(True).alias("__d")).distinct(), KEY, "left")
    return marked.groupBy("commit_sha").agg(F.every(F.col("__d").isNotNull()).alias("done")).where("done").select("commit_sha")


def merge_checkpoints(checkpoints: list[DataFrame], keys: DataFrame) -> DataFrame:
    """All partial results with the split of their key, ``train`` where the key has none."""
    merged = checkpoints[0]
    for more in checkpoints[1:]:
        merged = merged.unionByName(more)
    splits = keys.groupBy(*KEY).agg(F.max("split").alias("split"))
    return merged.join(splits, KEY, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def rebuild_files(rows: DataFrame, vector: str = "file_features") -> DataFrame:
    """Whole numbers and flags for the scorer from the stored file vector, as flat columns."""
    at = lambda i: F.get(F.col(vector), F.lit(i))
    whole = lambda i: F.bround(at(i), 0).cast("long")
    return rows.withColumns({
        "language": at(0), "is_binary": at(1) > 0.5, "is_test_file": at(2) > 0.5,
        "lines_added": whole(3), "lines_deleted": whole(4), "total_lines_changed": whole(5),
    })


def check_supervised(rows: DataFrame) -> DataFrame:
    """An ambiguous row among supervised ones is an error."""
    message = F.concat(F.lit("ambiguous row in a supervised split: "), F.col("commit_sha"))
    label = F.when(F.col("defect_label") == -1, F.raise_error(message).cast("int")).otherwise(F.col("defect_label"))
    return rows.withColumn("defect_label", label)
