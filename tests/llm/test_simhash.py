import random
import re

import numpy as np
import pytest
import xxhash
from corpus import documents, none, prose

from patchsieve.llm import simhash
from patchsieve.llm.simhash import fingerprint, linked_fingerprints, near, pivot_table, simhash_groups, spanning_links


def plain(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[n:n + 3]) for n in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Least member, by place, of everything reachable."""
    prints = np.array(prints, np.uint64)
    comp = np.arange(len(prints))
    changed = True
    while changed:
        changed = False
        for n in range(len(prints)):
            least = comp[np.bitwise_count(prints ^ prints[n]) <= 3].min()
            if least < comp[n]:
                comp[n], changed = least, True
    return comp.tolist()


def brute(rows):
    prints = [plain(t) for _, t in rows]
    comp = groups(prints)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[n]] = min(i, least.get(comp[n], i))
    return sorted(((i, f"{prints[n]:016x}", least.get(comp[n])) for n, (i, _) in enumerate(rows)), key=str)


def got(docs):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()), key=str)


def test_cases(spark):
    docs = documents(spark)
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash_groups(none(spark)).count() == 0


def test_long_texts_are_read_in_parts(monkeypatch):
    texts = [prose(n, 700) for n in range(3)] + ["one " * 3_000, "x" * 5_000, "a b", " \n ", "A  b\x0bc d"]
    monkeypatch.setattr(simhash, "CHUNK", 1_000)
    assert [fingerprint(t.encode()) for t in texts] == [plain(t) for t in texts]


def test_hash_is_that_of_spark(spark):
    row = spark.sql("SELECT xxhash64('one two three') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42) == fingerprint("One two\nthree".encode())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_table_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def clouds(seed, centers, members, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centers):
        center = rng.getrandbits(64)
        out += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips))) for _ in range(members)]
    return sorted(set(out))


def linked(spark, prints):
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    rows = linked_fingerprints(spark.createDataFrame(signed, "fp long")).collect()
    return {r.fp % 2**64: r.comp for r in rows}


@pytest.mark.parametrize("block_rows", [8_192, 40])
def test_links_of_clouds_against_all_pairs(spark, monkeypatch, block_rows):
    """Small buckets, buckets searched in one block, and buckets cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    prints = clouds(1, 60, 4, 4) + clouds(2, 6, 40, 7) + clouds(3, 1, 300, 5) + [0, 7, 2**64 - 1, 2**64 - 8]
    prints = sorted(set(prints))
    got, want = linked(spark, prints), groups(prints)
    names = {}
    assert len(got) == len(prints)
    for p, c in zip(prints, want):
        assert names.setdefault(c, got[p]) == got[p]
    assert len(set(names.values())) == len(names)


def test_the_table_discards_no_pair_to_be_linked():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 64, 4_000, dtype=np.uint64)
    for r in range(0, 4_000, 2):
        prints[r + 1] = prints[r] ^ np.bitwise_or.reduce(np.left_shift(np.uint64(1), rng.choice(64, r // 2 % 6, replace=False).astype(np.uint64)), initial=np.uint64(0))
    a, b = np.arange(0, 4_000, 2), np.arange(1, 4_000, 2)
    assert near(prints, pivot_table(prints), a, b).tolist() == np.flatnonzero(np.bitwise_count(prints[a] ^ prints[b]) <= 3).tolist()


def test_spanning_links_connect_what_is_connected():
    prints = np.array(clouds(4, 3, 200, 6), np.uint64)
    comp = np.arange(len(prints))
    links = spanning_links(prints)
    for a, b in links:
        assert np.bitwise_count(prints[a] ^ prints[b]) <= 3
        comp[comp == comp[b]] = comp[a]
    want = groups(prints)
    assert len(links) == len(prints) - len(set(want))
    assert len(set(comp)) == len(set(want))


def test_every_close_pair_shares_a_bucket():
    rng = random.Random(8)
    for _ in range(2_000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        assert any(not differ & int(m) for m in simhash._MASKS)
    assert int(np.bitwise_or.reduce(simhash._BLOCKS)) == 2**64 - 1
