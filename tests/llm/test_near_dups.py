import numpy as np
import pytest
from corpus import documents, none, prose, shingles

from patchsieve.llm.components import components
from patchsieve.llm.near_dups import MINIMA, least_matches, near_duplicates, one_per_group, signatures, survivors
from patchsieve.llm.shingles import shingle_sets


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                group[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return sorted(((i, len(sets[n]), least.get(root(n)) if sets[n] else i) for n, (i, _) in enumerate(rows)), key=str)


def test_cases(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(none(spark)).count() == 0


def test_one_row_of_each_group_with_its_columns(spark):
    docs = documents(spark)
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # the copies of 1 go, of the two rows 7 both texts stay, blank rows stay
    assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 4, 5, 6, None, 7, 7, 8, 10, 11, 12, 13, -5, 2**62], key=str)
    twice = one_per_group(docs.where("doc_id = 3"))
    assert twice.count() == 1 and twice.first().kind == "k"


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_table_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_group_without_a_common_center(spark):
    """Texts that drift word by word: neighbours are similar, the ends are not."""
    words = prose(9, 400).split()
    rows = [(n, " ".join(words[n * 12:n * 12 + 150])) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == brute(rows) and len({r[2] for r in got}) < 3


def test_bounds_drop_few_true_pairs():
    bounds = least_matches(0.75, 1e-5)
    assert len(bounds) == MINIMA // 16 and list(bounds) == sorted(bounds)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 30, (20_000, MINIMA)).astype(np.uint32)
    for similarity, least, most in ((0.75, 0.999, 1.0), (0.3, 0.0, 0.001)):
        right = np.where(rng.random(left.shape) < similarity, left, 0)
        share = len(survivors(left, right, bounds)[0]) / len(left)
        assert least <= share <= most


def test_sets_are_exact_and_signatures_estimate():
    import pyarrow as pa
    texts = [None, "", "a b", "A  B", prose(1, 40), "x " * 50_000, prose(2, 9) + "\x0b" + prose(3, 9), "a b c d e f"]
    sets = [s for part in shingle_sets(pa.array(texts)) for s in part]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[2].tolist() == sets[3].tolist()
    sig = signatures(sets)
    assert (sig[2] == sig[3]).all() and (sig[0] == 0xFFFFFFFF).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(101, 140)] + [(200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(61)} | {n: 100 for n in range(100, 140)}


def test_blocks_of_many_rows_are_compared_in_bounded_parts(monkeypatch):
    """Two blocks of rows that share a band and no more: their pairs never stand in memory at once."""
    import tracemalloc

    import pyarrow as pa

    from patchsieve.llm import near_dups

    n = 3_000
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 30, (2 * n, MINIMA)).astype(np.uint32)
    sig[:, :4] = 7
    sets = [np.sort(rng.integers(0, 1 << 62, 26).astype(np.uint64)).tobytes() for _ in range(2 * n)]
    sig[n + 5], sets[n + 5] = sig[5], sets[5]
    sig[1], sets[1] = sig[0], sets[0]
    ids = np.arange(2 * n)

    def batch(i, j):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(rows), np.int64)), pa.array(np.full(len(rows), i)), pa.array(np.full(len(rows), j)), pa.array((rows >= n).astype(np.int64)),
             pa.array(rows), pa.array(rows), pa.array([sig[r].tobytes() for r in rows]), pa.array([sets[r] for r in rows])],
            names=["key", "i", "j", "block", "node", "comp", "sig", "set"])

    run = near_dups._verify_blocks(least_matches(0.75, 1e-5), 75)
    tracemalloc.start()
    rows = ids
    assert [r for b in run(iter([batch(0, 1)])) for r in b.to_pylist()] == [{"a": 5, "b": n + 5}]
    rows = ids[:n]
    assert [r for b in run(iter([batch(0, 0)])) for r in b.to_pylist()] == [{"a": 0, "b": 1}]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
