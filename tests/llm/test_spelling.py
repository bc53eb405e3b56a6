import random
import re
import zlib
from collections import Counter

import pytest
from corpus import documents, none
from hypothesis import given, settings
from hypothesis import strategies as st

from patchsieve.llm.spelling import gram_counts, near_words, pivots, prefix_grams, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:p] + long[p + 1:] == short for p in range(len(long)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, out = {}, []
    friends = {w: [o for o in words if near(w, o)] for w in words}
    for w, n in words.items():
        best = min(friends[w], key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, n, len(friends[w]), forms[w], words[forms[w]] if forms[w] else None, root))
    return sorted(out)


def got(docs):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(docs).collect())


def test_cases(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # the long run is quadratic in the plain version
    assert got(docs.where("doc_id <> 12 OR doc_id IS NULL")) == brute([r for r in rows if r[0] != 12])
    assert spelling_variants(none(spark)).count() == 0


def test_a_very_long_run_is_a_word(spark):
    run = "ab" * 4_000 + "xyz" * 200
    docs = spark.createDataFrame([(1, f"{run} {run} {run} {run[:70]}q{run[70:]} " * 2)], "doc_id long, text string")
    assert got(docs) == brute([(1, docs.first().text)])


def test_chains_ties_and_repeated_letters(spark):
    counts = {"aaaaa": 40, "aaaaaa": 3, "aaaaaaa": 9, "baaaa": 20, "aaaab": 20, "stone": 12, "stones": 6, "stoned": 6, "tstone": 3,
              "ÀÉîõü": 3, "ÀÉîõé": 8, "naïve": 5, "naive": 10, "nave": 9, "ababab": 7, "bababa": 14, "ababa": 3}
    rows = [(n, " ".join(w for w, k in counts.items() if n < k)) for n in range(40)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_random_words_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(n, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(4, 8))) for _ in range(90))) for n in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_table_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=300)
@given(st.text("abc", min_size=5, max_size=9), st.randoms(use_true_random=False))
def test_pivots_are_disjoint_and_cheapest(word, rng):
    counts = {a + b: rng.randrange(1, 6) for a in "abc" for b in "abc"}
    grams = prefix_grams(word, counts)
    assert len(grams) >= 3 and all((counts[word[p:p + 2]], word[p:p + 2]) > grams[-1][:2] or (counts[word[p:p + 2]], word[p:p + 2], p) in grams for p in range(len(word) - 1))
    one, two = pivots(grams)
    assert abs(one[2] - two[2]) >= 2
    assert one[0] + two[0] == min(a[0] + b[0] for a in grams for b in grams if b[2] - a[2] >= 2)


def test_one_common_first_gram_gives_no_pairs_by_itself(spark):
    """Words that share a gram and its place are no candidates unless the text on one side of it is the same."""
    words = spark.createDataFrame([(f"q{n:04d}".translate(str.maketrans("0123456789", "abcdefghij")) + "zz", 5) for n in range(0, 9_999, 37)], "word string, n long")
    assert gram_counts(words)["zz"] == 271
    want = sum(near(a.word, b.word) for a in words.collect() for b in words.collect())
    assert near_words(words).count() == want
