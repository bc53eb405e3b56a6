from collections import defaultdict

import numpy as np
from corpus import documents, none
from hypothesis import given
from hypothesis import strategies as st

from patchsieve.llm.packing import CAPACITIES, pack, packed, sequence_cost


def plain(lengths, sizes):
    """The same rule with a search over all open bins."""
    bins, left = [], sum(lengths)
    for need in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= need]
        if fits:
            chosen = min(fits, key=lambda b: b[0] - b[1])
        else:
            _, size = min((sequence_cost(c) / min(c, left), c) for c in sizes if c >= need)
            chosen = [size, 0]
            bins.append(chosen)
        chosen[1] += need
        left -= need
    return sorted((min(c for c in sizes if c >= used), used) for _, used in bins)


@given(st.lists(st.integers(1, 64), max_size=80))
def test_packs_like_the_plain_rule(lengths):
    sizes = (8, 16, 64)
    bins, offsets, capacity = pack(np.array(lengths, np.int64), sizes)
    used = defaultdict(int)
    for b, n in zip(bins.tolist(), lengths):
        used[b] += n
    assert sorted((capacity[b], n) for b, n in used.items()) == plain(lengths, sizes)


def test_cases(spark):
    docs = documents(spark)
    rows = packed(docs, group_rows=8).collect()
    bins, pieces = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r.bin_id, r.capacity].append((r.offset, r.n_tokens))
        pieces[r.doc_id] += r.n_tokens
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and capacity == min(c for c in CAPACITIES if c >= at)
    want = defaultdict(int)
    for r in docs.collect():
        want[r.doc_id] += 1 + len((r.text or "").replace(" ", "x").split())
    assert pieces == want and max(len([r for r in rows if r.doc_id == 11]), 0) == 15
    assert packed(none(spark)).count() == 0


def test_large_ids_stay_beside_a_null(spark):
    ids = [None, 2**62 + 1, 2**53 + 1, -(2**60) - 1]
    docs = spark.createDataFrame([(i, "one two") for i in ids], "doc_id long, text string")
    assert sorted((r.doc_id for r in packed(docs).collect()), key=str) == sorted(ids, key=str)


def test_the_first_opened_of_equal_bins_is_filled():
    bins, offsets, capacity = pack(np.array([5, 5, 3, 3, 3], np.int64), (8,))
    assert bins.tolist() == [0, 1, 0, 1, 2] and offsets.tolist() == [0, 0, 5, 5, 0] and capacity == [8, 8, 8]
