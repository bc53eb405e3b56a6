import hashlib

from corpus import DOCUMENTS, documents, none, prose
from pyspark.sql import functions as F

from patchsieve.llm.fingerprints import _below, fingerprints, likeness, with_signature


def edited(docs):
    """(doc_id, text, edited text) by descending id, nulls last."""
    out = []
    for n, (i, text) in enumerate(docs):
        follows = docs[(n + 1) % len(docs)][1]
        third = len(text) // 3
        out.append((i, text, text[:len(text) - third] + follows[:third]))
    return out


def check(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: -r[0], )
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert len(got) == len(rows)
    known = {}
    for i, text, new in edited(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert known.setdefault(text, r.fingerprint) == r.fingerprint and known.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (text != new or r.near_edited == 1)
    return got


def test_unique_ids(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check(spark, docs)


def test_cases(spark):
    docs = documents(spark)
    got = fingerprints(docs).collect()
    assert len(got) == docs.count() and sum(r.doc_id is None for r in got) == 2
    assert {r.fingerprint for r in got if r.doc_id in (4, 5, 6)} == {""}
    assert fingerprints(none(spark)).count() == 0
    alone = fingerprints(spark.createDataFrame([(1, "abcdef", *[None] * 10)], DOCUMENTS)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_whole_table(spark):
    got = check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).values()
    long = [r for r in got if r.n_chars > 400]
    assert all(r.near_edited > r.near_next for r in long)


def test_order_counts(spark):
    """The same k-mers in another order are less alike than a text with a few edits, and repeats are told apart."""
    words = prose(4, 900).split()
    parts = [words[n:n + 90] for n in range(0, 900, 90)]
    text = " ".join(words)
    turned = " ".join(w for p in reversed(parts) for w in p)
    few = " ".join("new" if n % 150 == 3 else w for n, w in enumerate(words))
    rows = spark.createDataFrame([(text, turned), (text, few), ("ab " * 400, "ab " * 800), (text, text)], "a string, b string")
    signed = with_signature(with_signature(rows, "a", "x"), "b", "y")
    near = [r.n for r in signed.select(likeness(F.col("x"), F.col("y")).alias("n")).collect()]
    assert near[0] < 0.75 < near[1] < 1 == near[3]


def test_order_counts_in_short_texts(spark):
    """Every order of a text with two k-mers has a pair, so that rearranged short texts are far apart."""
    rows = []
    for size in (20, 40, 64, 130):
        for seed in range(8):
            words = [f"{w}{n}" for n, w in enumerate(prose(seed, size).split()[:size])]
            cut = len(words) // 2
            few = words[:-1] + ["new"]
            rows.append((size, " ".join(words), " ".join(words[cut:] + words[:cut]), " ".join(few)))
    signed = spark.createDataFrame(rows, "size int, a string, b string, c string")
    for text in "abc":
        signed = with_signature(signed, text, f"s{text}")
    got = signed.groupBy("size").agg(
        F.min(F.size("sa")).alias("orders"), F.avg(likeness(F.col("sa"), F.col("sb"))).alias("turned"), F.avg(likeness(F.col("sa"), F.col("sc"))).alias("few")).collect()
    for r in got:
        assert r.orders == 64 and r.turned < 0.65 and r.turned < r.few, r
    one = with_signature(spark.createDataFrame([("a b c",), ("a b c d",), ("",), ("a",)], "t string"), "t", "s")
    assert [len(r.s) for r in one.collect()] == [1, 64, 0, 1]


def test_no_python_in_the_plan(spark, capsys):
    fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "regexp_extract_all" in plan
    # no step is repeated inside the lambda of the next
    assert max(line.count("regexp_extract_all") for line in plan.splitlines()) == 1


def test_search_in_cuts(spark):
    cuts = [3, 3, 5, 9, 9, 9, 20]
    rows = spark.createDataFrame([(k, cuts) for k in range(25)], "key long, cuts array<bigint>")
    got = rows.select("key", _below("cuts", F.col("key"), 8, False).alias("less"), _below("cuts", F.col("key"), 8, True).alias("most")).collect()
    assert all((r.less, r.most) == (sum(c < r.key for c in cuts), sum(c <= r.key for c in cuts)) for r in got)


def plain_likeness(one, two, orders=1_024):
    """Share of independent orders whose two least numbered k-mers, in text order, are the same."""
    import numpy as np
    import xxhash

    from patchsieve.llm.shingles import mix

    salts = np.random.default_rng(5).integers(0, 1 << 64, orders, dtype=np.uint64)

    def pairs(words):
        seen, keys, names = {}, [], []
        for n in range(len(words) - 2):
            kmer = " ".join(words[n:n + 3])
            seen[kmer] = seen.get(kmer, 0) + 1
            names.append(xxhash.xxh64_intdigest(kmer))
            keys.append(xxhash.xxh64_intdigest(f"{kmer} {seen[kmer]}"))
        keys, names = np.array(keys, np.uint64), np.array(names, np.uint64)
        least = np.array([np.sort(np.argpartition(mix(keys ^ s), 1)[:2]) for s in salts])
        return names[least]

    return float((pairs(one) == pairs(two)).all(1).mean())


def test_estimates_follow_independent_orders(spark):
    """The binned orders against a plain Order MinHash of independent ones; README has the error."""
    import random

    rows, want = [], []
    for size in (20, 60, 200, 600, 2_000):
        for seed in range(4):
            rng = random.Random(size * 10 + seed)
            words = [f"w{rng.randrange(size)}" for _ in range(size)]
            few = [f"n{rng.random()}" if rng.random() < 0.03 * (seed + 1) else w for w in words]
            cut = rng.randrange(size // 4, size // 2)
            for other in (few, words[cut:] + words[:cut], words[:-(size // 3)] + few[:size // 3]):
                rows.append((len(rows), size, " ".join(words), " ".join(other)))
                want.append(plain_likeness(words, other))
    df = spark.createDataFrame(rows, "n int, size int, a string, b string")
    got = with_signature(with_signature(df, "a", "x"), "b", "y").select("n", "size", likeness(F.col("x"), F.col("y")).alias("near")).collect()
    errors = {}
    for r in got:
        errors.setdefault(r["size"], []).append(r["near"] - want[r["n"]])
    told = {s: (round(sum(e) / len(e), 3), round(sum(abs(x) for x in e) / len(e), 3)) for s, e in sorted(errors.items())}
    print("mean error and mean absolute error by tokens:", told)
    assert all(abs(bias) < 0.12 and off < 0.15 for bias, off in told.values()), told
