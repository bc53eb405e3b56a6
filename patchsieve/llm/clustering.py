"""Centroid clustering of integer vectors by a bisector tournament.

Between two centroids a < b stands their bisector: a vector x is nearer to b if x . 2(b - a) exceeds
|b|^2 - |a|^2, and a keeps it if both are equal. These integer normals and thresholds are computed once
a round for all pairs. A vector's champion starts as centroid 0 and meets the others in ascending
order, so k - 1 signs find the nearest centroid and a zero favours the smaller number. Only the
champion's distance is then computed.

Vectors stay where they are: a round is one pass over a written table, each task gives sums per
centroid and component, and the new centroids (their number times the components) pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchsieve.llm.common import written

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
LARGEST = 1 << 62
_LONG = (1 << 63) - 1


def integer_vectors(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with that many components, all finite; v holds floor(scale * x) as longs."""
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # clamped as a double, so that the cast to long cannot overflow
    scaled = F.transform(value, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * scale))))
    return embeddings.where((F.size("embedding") == components) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the least hash of seed and id, in hash order; ties by the components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.select(key.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals (a, b, component) and thresholds (a, b) of all pairs of centroids."""
    squares = (centroids * centroids).sum(1)
    return 2 * (centroids[None] - centroids[:, None]), squares[None] - squares[:, None]


def tournament(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The nearest centroid of every row of x, the smaller number where distances are equal."""
    champion = np.zeros(len(x), np.int64)
    for j in range(1, len(normals)):
        beyond = (x * normals[champion, j]).sum(1) > thresholds[champion, j]
        champion[beyond] = j
    return champion


def _exact(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both as longs if no product can overflow, else as integers of any size."""
    most = max([abs(c) for row in centroids for c in row] + ([abs(int(x.min())), abs(int(x.max()))] if x.size else []), default=0)
    kind = np.int64 if 8 * most * most * max(x.shape[1], 1) <= _LONG else object
    return x.astype(kind), np.array(centroids, kind).reshape(len(centroids), -1)


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, centroids and champions of a batch."""
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    x, points = _exact(x, centroids)
    return x, points, tournament(x, *bisectors(points))


def _sums(centroids: list[list[int]]):
    """Rows (cluster, component, n, total) of the vectors of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(centroids[0])
        totals, counts = np.zeros((len(centroids), width), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x, _, champion = _assigned(batch, centroids)
            for c in np.unique(champion):
                mine = x[champion == c]
                totals[c] += mine.sum(0).astype(object)
                counts[c] += len(mine)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width), pa.int32()), pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
             pa.array(np.repeat(counts[used], width), pa.int64()), pa.array([Decimal(int(t)) for t in totals[used].ravel()], pa.decimal128(38, 0))],
            names=["cluster", "component", "n", "total"])
    return run


def _nearest(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, points, champion = _assigned(batch, centroids)
            away = x - points[champion]
            distance = [min(int(d), _LONG) for d in (away * away).sum(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(champion, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])
    return run


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector.

    Kept are vectors of `components` components, none null or not finite; null vectors and others have no
    row. Fewer than k kept vectors give as many centroids. Repeated rows count each; a null vec_id is kept
    and comes last where first centroids are chosen. Components beyond 2^62 once scaled are taken as
    2^62, and distances or sums beyond the largest long as that. Other columns are ignored. An empty
    table gives no rows.
    """
    vectors = written(integer_vectors(embeddings, components), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        nothing = vectors.limit(0).select("vec_id", F.lit(0).alias("cluster"))
        return nothing.select("*", *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        parts = vectors.mapInArrow(_sums(centroids), "cluster int, component int, n long, total decimal(38,0)")
        # at most k * components rows
        for r in parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            centroids[r.cluster][r.component] = int(r.total) // r.n
    nearest = written(vectors.mapInArrow(_nearest(centroids), "vec_id long, cluster int, distance long"), "nearest")
    inertia = {r.cluster: int(r.total) for r in nearest.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = min(sum(inertia.values()), _LONG)
    names = [(c, min(inertia[c], _LONG), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    clusters = embeddings.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, centroid_sha256 string")
    # k rows at most
    return nearest.join(F.broadcast(clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
