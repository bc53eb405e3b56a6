"""Resumable generation as a stream: rows already written are skipped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from patchsieve.sources.examples import resume_todo


def resume_stream(
    rows: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Compute and append what the output lacks, batch by batch, over all files present.

    Each batch writes a folder of its own and replaces it if it runs again, so a
    lost executor or a restart repeats work but never rows. A run is named after
    its checkpoint; the folders of other runs are only read.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def step(batch: DataFrame, epoch: int) -> None:
        target = f"{out}/run=r{run}/epoch={epoch}"
        spark = batch.sparkSession
        todo = batch.dropDuplicates(["commit_sha", "file_path"])
        try:
            before = spark.read.parquet(out)
            todo = resume_todo(todo, before.where((before.run != f"r{run}") | (before.epoch < epoch)))
        except AnalysisException:  # nothing written so far
            pass
        compute(todo).write.mode("overwrite").parquet(target)

    return (
        rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
