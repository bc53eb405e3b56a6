import random
import zlib

from corpus import documents, none

from patchsieve.llm.sharding import sharded


def check(rows, docs, shards):
    sizes = [len((t or "").encode()) + 8 for _, t in docs]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(
        ((i, n, zlib.crc32((t or "").encode())) for (i, t), n in zip(docs, sizes)), key=str)
    assert {r.law for r in rows} <= {"bytes"} and {r.grown_shard for r in rows} <= {None}
    ids = []
    for shard in range(shards):
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids += [-(2**63) if r.doc_id is None else r.doc_id for r in own]
    assert ids == sorted(ids) and len(ids) == len(rows)
    # a boundary lies at the row that covers its target
    before, total = 0, sum(sizes)
    for shard in range(shards - 1):
        before += sum(r.size for r in rows if r.shard == shard)
        assert abs(before - total * (shard + 1) / shards) <= max(sizes) / 2 + 1 + total / shards * 1e-4


def test_cases(spark):
    docs = documents(spark)
    check(sharded(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 24)
    assert sharded(none(spark)).count() == 0


def test_one_id_may_hold_most_rows(spark):
    rng = random.Random(1)
    rows = [(7, "x" * rng.randrange(50)) for _ in range(900)] + [(rng.randrange(-2**63, 2**63), "y" * rng.randrange(90)) for _ in range(500)] + [(None, "n"), (None, None)] * 9
    got = sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 24).collect()
    check(got, rows, 24)


def test_ends_of_the_range_of_ids(spark):
    rows = [(2**63 - 1, "a"), (-2**63, "b"), (0, "c"), (-1, "d")] * 20
    check(sharded(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect(), rows, 5)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(sharded(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 24)
