from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchsieve.llm.clustering import bisectors, clustered, tournament

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int, h string"


def brute(rows, k, rounds, seed=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [list(v) for _, v in order[:k]]

    def assign():
        away = [[sum((a - b) ** 2 for a, b in zip(v, p)) for p in points] for _, v in kept]
        return [min((d, c) for c, d in enumerate(ds)) for ds in away]

    for _ in range(rounds):
        nearest = assign()
        for c in range(len(points)):
            mine = [v for (_, v), (_, own) in zip(kept, nearest) if own == c]
            if mine:
                points[c] = [sum(col) // len(mine) for col in zip(*mine)]
    nearest = assign()
    inertia = {c: sum(d for d, own in nearest if own == c) for c in range(len(points))}
    total = sum(inertia.values())
    return sorted(((i, c, d, inertia[c], total, sha256(",".join(map(str, points[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, nearest)), key=str)


def got(df, **how):
    return sorted((tuple(r) for r in clustered(df, **how).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 7, "y") for i, v in rows], SCHEMA)


def test_cases(spark):
    rng = np.random.default_rng(5)
    base = [rng.normal(0, 0.3, 64).astype(np.float32).tolist() for _ in range(30)]
    rows = [(n, v) for n, v in enumerate(base)] + [(3, base[3]), (3, base[4]), (None, base[5]), (None, base[6]), (2**62, base[7])]
    rows += [(50, None), (51, []), (52, base[0][:63]), (53, base[0] + [0.0]), (54, [None] + base[0][1:]), (55, [float("nan")] + base[0][1:]),
             (56, [float("inf")] + base[0][1:]), (57, [float("-inf")] + base[0][1:]), (58, [-0.0] * 64), (59, [0.0] * 64)]
    want = brute(rows, 6, 5)
    assert len(want) == 37
    assert got(frame(spark, rows), k=6) == want
    assert got(frame(spark, rows)) == brute(rows, 40, 5)
    assert got(frame(spark, rows), k=1, rounds=0) == brute(rows, 1, 0)
    assert clustered(frame(spark, [])).collect() == []
    assert clustered(frame(spark, rows[35:43])).collect() == []


def test_large_components_stay_exact_or_saturate(spark):
    rng = np.random.default_rng(6)
    rows = [(n, (rng.normal(0, 1, 64) * 4.0e5).astype(np.float32).tolist()) for n in range(12)]
    assert got(frame(spark, rows), k=4) == brute(rows, 4, 5)
    beyond = rows + [(90, [3.0e38] * 64), (91, [-3.0e38] * 64)]
    out = {r.vec_id: r for r in clustered(frame(spark, beyond), k=14, rounds=1).collect()}
    assert len(out) == 14 and all(0 <= r.distance <= r.cluster_inertia <= r.inertia for r in out.values())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_table(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").where("vec_id % 3 = 0")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(df, k=9, rounds=3) == brute(rows, 9, 3)


@settings(max_examples=200)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=9), st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=9))
def test_the_champion_is_the_nearest_with_the_smaller_number(points, vectors):
    c, x = np.array(points), np.array(vectors)
    away = ((x[:, None] - c[None]) ** 2).sum(2)
    assert tournament(x, *bisectors(c)).tolist() == away.argmin(1).tolist()
