import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchsieve.operators import attribution as A
from patchsieve.operators import metrics as M
from patchsieve.operators import models as L
from patchsieve.operators import populations as P
from patchsieve.operators import stats as S
from patchsieve.operators.ranking import MODULUS


def ranked(spark, rows):
    df = spark.createDataFrame(rows, "g string, seq int, score double, positive boolean")
    return M.group_counts(M.rank_in_group(df, ["g"], "score", [F.col("seq")]), ["g"], "positive")


GROUPS = [("none", 0, 1.0, False), ("none", 1, 2.0, False), ("all", 0, 1.0, True), ("all", 1, 1.0, True),
          ("late", 0, 3.0, False), ("late", 1, 3.0, True), ("late", 2, 1.0, False), ("late", 3, 0.0, True)]


def test_within_group(spark):
    long = {(r["g"], r["k"]): r for r in M.per_budget(ranked(spark, GROUPS), ["g"]).collect()}
    assert long["none", 1]["recall"] == 0.0 and long["none", 1]["all_captured"] and long["none", 1]["reciprocal_rank"] is None
    assert long["all", 1]["recall"] == 0.5 and long["all", 1]["enrichment"] == 1.0 and not long["all", 1]["all_captured"]
    assert long["late", 2]["recall"] == 0.5 and long["late", 2]["first_rank"] == 2 and long["late", 3]["enrichment"] == pytest.approx(0.5 / 0.75)


def test_aggregate(spark):
    r = M.aggregate_group_metrics(ranked(spark, GROUPS)).first()
    assert (r["groups"], r["groups_with_positive"]) == (3, 2) and r["mean_files"] == pytest.approx(8 / 3)
    assert r["mrr"] == pytest.approx(0.75) and r["median_reciprocal_rank"] == pytest.approx(0.75) and r["median_first_rank"] == 1.5
    empty = M.aggregate_group_metrics(ranked(spark, GROUPS[:2])).first()
    assert empty["mrr"] == 0.0 and empty["recall_1"] == 0.0 and empty["median_first_rank"] == 0.0


def test_areas_on_ties_and_one_class(spark):
    def areas(rows):
        r = M.ranking_areas(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()
        return r["roc_auc"], r["average_precision"]
    assert areas([(1.0, True), (1.0, False)]) == (0.5, 0.5)
    assert areas([(1.0, True), (0.5, True)]) == (0.0, 0.0)
    auc, ap = areas([(0.9, True), (0.8, False), (0.8, True), (0.1, False)])
    assert auc == pytest.approx(0.875) and ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_two_sample_statistics(spark):
    rnd = random.Random(5)
    rows = [(float(rnd.randint(0, 9) + (i % 3 == 0) * 2), i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "v double, y boolean")
    a, b = [v for v, y in rows if y], [v for v, y in rows if not y]
    u = sum((x > z) + 0.5 * (x == z) for x in a for z in b)
    got = S.mann_whitney(df, "v", "y").first()
    assert got["u"] == pytest.approx(u) and got["effect_size"] == pytest.approx(1 - 2 * u / (len(a) * len(b))) and 0 < got["p_value"] < 0.01
    ks = max(abs(np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x)) for x in range(12))
    assert S.ks_two_sample(df, "v", "y").first()["ks"] == pytest.approx(ks)


def test_gini_and_concentration(spark):
    counts = [0, 0, 1, 5, 5, 9]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "name int, n long")
    c = S.concentration(df, "name", "n").first()
    x = np.sort(counts)
    assert c["gini"] == pytest.approx(2 * np.sum(np.arange(1, 7) * x) / (6 * x.sum()) - 7 / 6) and c["with_signal"] == 4
    f = [n / 20 for n in counts if n]
    pairwise = sum(abs(a - b) for a in f for b in f) / (2 * len(f))
    g = S.gini_variants(df, "name", "n").first()
    assert g["gini_pairwise"] == pytest.approx(pairwise)


def draw(replicate, d, n, seed=42):
    h = seed % MODULUS
    for k in (replicate, d):
        h = (h * 48271 + (k % MODULUS) * 16807 + 12345) % MODULUS
    return ((h * 69621 + 7919) % MODULUS * 48271 + 11) % MODULUS % n


def test_bootstrap_keeps_duplicates_and_the_paired_one_does_not(spark):
    rnd = random.Random(1)
    rows = [(f"g{g:02}", i, rnd.random(), rnd.random() < 0.4) for g in range(12) for i in range(4)]
    other = [(g, i, rnd.random(), p) for g, i, _, p in rows]
    counts, second = ranked(spark, rows), ranked(spark, other)
    rr = [r["reciprocal_rank"] for r in counts.orderBy("g").collect()]
    rr2 = [r["reciprocal_rank"] for r in second.orderBy("g").collect()]
    mean = lambda xs: float(np.mean([x for x in xs if x is not None] or [0.0]))
    kept, paired = [], []
    for rep in range(40):
        idx = [draw(rep, d, 12) for d in range(12)]
        kept.append(mean([rr[i] for i in idx]))
        paired.append(mean([rr[i] for i in set(idx)]) - mean([rr2[i] for i in set(idx)]))
    got = {r["metric"]: r for r in S.bootstrap_ci(counts, ["g"], 40).collect()}["mrr"]
    assert (got["mean"], got["ci_lower"], got["ci_upper"]) == pytest.approx((np.mean(kept), *np.percentile(kept, [2.5, 97.5])))
    got = {r["metric"]: r for r in S.paired_bootstrap(counts, second, ["g"], 40).collect()}["mrr"]
    assert (got["mean"], got["ci_lower"], got["ci_upper"]) == pytest.approx((np.mean(paired), *np.percentile(paired, [2.5, 97.5])))


def test_pairs_are_counted_and_compared_without_building_them(spark):
    rnd = random.Random(2)
    rows = [("r", f"c{i % 3}", i, rnd.choice(["FILE_STRONG", "FILE_WEAK", "UNKNOWN"]), rnd.randint(0, 4) / 4, True) for i in range(60)]
    df = spark.createDataFrame(rows, "repo string, sha string, seq int, level string, score double, identity boolean")
    by = lambda c, x: [r for r in rows if r[1] == c and r[3] == x]
    pairs = [(s[4], w[4]) for c in ("c0", "c1", "c2") for s in by(c, "FILE_STRONG") for w in by(c, "FILE_WEAK")]
    got = S.pairwise_accuracy(df, ["sha"], "score", "level", "FILE_STRONG", "FILE_WEAK", ["seq"]).first()
    assert got["pairs"] == len(pairs) and got["accuracy"] == pytest.approx(sum(a > b for a, b in pairs) / len(pairs))
    counted = P.pair_counts(df, ["repo", "sha"]).where("category = 'STRONG_vs_WEAK'").agg(F.sum("pairs")).first()[0]
    assert counted == len(pairs)
    none = S.pairwise_accuracy(df.where("level = 'UNKNOWN'"), ["sha"], "score", "level", "FILE_STRONG", "FILE_WEAK", ["seq"]).first()
    assert none["accuracy"] == 0.5
    aligned = P.aligned_pairs(df, ["sha"], ["seq"])
    want = sum(max(len(by(c, "FILE_STRONG")), len(by(c, "FILE_WEAK"))) for c in ("c0", "c1", "c2"))
    assert aligned.count() == want


def brute_pairs(left, right):
    used, out = set(), []
    for a in left:
        best, pick = 0.0, None
        for b in right:
            x, y = set(a.split()), set(b.split())
            if b in used or not x or not y:
                continue
            s = len(x & y) / len(x | y)
            if s > best and s > 0.3:
                best, pick = s, b
        if pick is not None:
            used.add(pick)
            out.append((a, pick, round(best, 4)))
    return out


def test_partial_matches_equal_a_full_scan(spark):
    rnd = random.Random(9)
    line = lambda: " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 5)))
    rows = [(i, sorted({line() for _ in range(12)}), sorted({line() for _ in range(12)})) for i in range(40)]
    rows.append((99, ["a b c"], ["a b x y z w p q r s"]))  # 2 of 11 is below the limit
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = {r["i"]: [tuple(m) for m in r["m"]] for r in df.select("i", A.partial_matches(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {i: brute_pairs(a, b) for i, a, b in rows}


def test_contents(spark):
    df = spark.createDataFrame([("x\n y \nz", "x\nw"), (None, "x"), ("", ""), ("a\nb", "a\nb")], "p string, c string")
    got = [(r["restored"], r["line_diff_count"], r["similarity_ratio"]) for r in A.content_restoration(df, "p", "c").collect()]
    assert got == [(False, 2, 0.3333), (False, -1, 0.0), (True, 0, 1.0), (True, 0, 1.0)]
    sets = df.select(A.introduced(F.col("p"), F.col("c")).alias("i"), A.removed(F.col("p"), F.col("c")).alias("r")).collect()
    assert (sets[0]["i"], sets[0]["r"]) == (["w"], [" y", "z"]) and (sets[1]["i"], sets[1]["r"]) == ([], [])


def test_chain_stops_at_cycles_and_gaps(spark):
    edges = spark.createDataFrame(
        [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("d", "p", None), ("x", "p", "y"), ("y", "p", "x"), ("n", None, None), ("s", "p", "s")],
        "sha string, prefix string, corrective string")
    got = {r["sha"]: tuple(r)[1:] for r in A.reference_chain(edges).collect()}
    assert got["a"] == (3, True, "d") and got["c"] == (2, False, None) and got["d"] == (1, False, None)
    assert got["x"] == (2, True, "x") and got["n"] == (0, False, None) and got["s"] == (1, True, "s")


def test_populations(spark):
    rows = spark.createDataFrame([("r", "s", p, i) for i, p in enumerate(["a", "a", "b", "x/dev/null/y", "c", "d", "e"])], "repo string, sha string, path string, i int")
    ev = spark.createDataFrame([("r", "s", "a", "FILE_STRONG"), ("r", "s", "c", "FILE_WEAK"), ("r", "s", "d", "odd"), ("r", "s", "e", "UNKNOWN")], "repo string, sha string, path string, level string")
    pop = P.supervision_populations(rows, ev)
    assert [r["population"] for r in pop.orderBy("i").collect()] == [
        "OBSERVED_POSITIVE", "OBSERVED_POSITIVE", "UNLABELED", "OUT_OF_SCOPE", "EVIDENCE_WEAK", "UNLABELED", "EVIDENCE_UNKNOWN"]
    flags = lambda mode: [(r["label"], r["included"]) for r in P.pu_labels(rows, pop, mode).orderBy("i").collect()]
    assert flags("primary") == [(1, True), (1, True), (0, True), (0, False), (0, False), (0, True), (0, False)]
    assert flags("sensitivity")[4] == (0, True)
    with pytest.raises(ValueError):
        P.pu_labels(rows, pop, "other")
    assert all(r["ok"] for r in P.disjointness(pop, ["repo", "sha", "path"]).collect())


def test_only_the_safe_strategy_is_allowed():
    assert L.allowed_strategy("B1_CHANGE_SIZE") == "B1_CHANGE_SIZE"
    for name in ("B0_RANDOM", "B9"):
        with pytest.raises(ValueError):
            L.allowed_strategy(name)


def test_logistic_separates(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), float(i > 60)) for i in range(100)], "a double, b double, label double")
    scored = L.probability(L.fit_balanced_logistic(df, ["a", "b"], "label", 50), df).withColumn("y", F.col("label") == 1)
    assert M.ranking_areas(scored, "score", "y").first()["roc_auc"] > 0.99


@pytest.mark.parametrize("span", [1, 3, 8_192])
def test_draws_dealt_to_ranges_are_the_plain_draws(spark, monkeypatch, span):
    """Ranges without a draw, groups without a metric and duplicates, against draws in plain Python."""
    monkeypatch.setattr(S, "_RANGE_GROUPS", span)
    values = [0.5, None, 2.0, 3.25, None, 7.0, -1.0]
    df = spark.createDataFrame(list(enumerate(values)), "idx long, m double")
    for once in (False, True):
        got = {r.replicate: r.m for r in S._replicate_means(df, ["m"], 9, 42, once).collect()}
        for r in range(9):
            h = 42
            drawn = []
            for d in range(len(values)):
                h = (42 * 48271 + r * 16807 + 12345) % MODULUS
                h = (h * 48271 + d * 16807 + 12345) % MODULUS
                drawn.append(((h * 69621 + 7919) % MODULUS * 48271 + 11) % MODULUS % len(values))
            known = [values[i] for i in (set(drawn) if once else drawn) if values[i] is not None]
            assert got[r] == pytest.approx(sum(known) / len(known) if known else 0.0)


def test_strong_weak_pairs_are_all_or_every_kth(spark):
    rnd = random.Random(9)
    rows = [(f"c{g}", i, rnd.choice(["FILE_STRONG", "FILE_WEAK", "UNKNOWN"]), rnd.random() < 0.9) for g in range(30) for i in range(rnd.randrange(1, 14))]
    df = spark.createDataFrame(rows, "sha string, seq int, level string, identity boolean")
    want = [(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[3] and b[3] and a[2] == "FILE_STRONG" and b[2] == "FILE_WEAK"]
    got = [(r.sha, r.s.seq, r.w.seq) for r in P.strong_weak_pairs(df, ["sha"], ["seq"]).collect()]
    assert sorted(got) == sorted(want)
    part = [(r.sha, r.s.seq, r.w.seq) for r in P.strong_weak_pairs(df, ["sha"], ["seq"], most=40).collect()]
    step = -(-len(want) // 40)
    assert len(part) == len(set(part)) == -(-len(want) // step) and set(part) <= set(want)
    counted = {r.category: r.n for r in P.pair_counts(df, ["sha"]).groupBy("category").agg(F.sum("pairs").alias("n")).collect()}
    assert len(want) in counted.values()


def test_top_cuts_by_group(spark):
    from patchsieve.operators.ranking import top_cut_capture
    rows = [("a", n, float(n), n >= 28) for n in range(30)] + [("b", n, 0.0, False) for n in range(3)]
    df = spark.createDataFrame(rows, "g string, seq int, score double, positive boolean")
    got = {(r.g, r.cut): (r.rows, r.captured, r.percent) for r in top_cut_capture(df, "score", "positive", ["seq"], by=["g"]).collect()}
    assert got["a", "top_10"] == (10, 2, 100.0) and got["a", "top_10_percent"] == (3, 2, 100.0) and got["b", "top_100"] == (3, 0, None) and len(got) == 12
