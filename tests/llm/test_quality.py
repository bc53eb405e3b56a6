import zlib

import numpy as np
import pyarrow as pa
from corpus import documents, none

from patchsieve.llm.quality import FEATURES, class_prior, features, fit, quality, train, with_scores

FOLDER = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_features_bear_any_text():
    got = features(pa.array([None, "", " ", "a b c", "!!" * 300_000, "from " * 1_000]))
    assert got.shape == (6, FEATURES) and np.isfinite(got).all()
    assert (got[0] == got[1]).all()


def test_prior_and_scores_on_made_samples():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0, 1, (4_000, FEATURES)), rng.normal(0, 1, (1_000, FEATURES)) + 3
    network, prior = fit(good[:1_500], np.concatenate([good[1_500:], bad]))
    assert abs(prior - 2_500 / 3_500) < 0.1
    z = network.logits(np.concatenate([good[1_500:], bad]))
    assert (z[:2_500] > 0).mean() > 0.97 and (z[2_500:] < 0).mean() > 0.97
    assert class_prior(np.arange(100.0), np.arange(100.0)) > 0.9
    assert fit(np.zeros((0, FEATURES)), good)[0] is None


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([r.predicted == q for q, r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (7, 1, 0), (8, None, 0), (None, 1, 0), (999, 1, 1), (13, 0, 0), (2, 1, 0), (2, 0, 0)], LABELS)
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality(docs, empty).collect()} == {0.5}
    assert quality(none(spark), labels).count() == 0


def test_words_themselves_count(spark):
    """A text and the same text with other letters have the same classes, sizes and repetition, but not the same score."""
    import codecs

    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    texts = [r.text for r in docs.where("lang = 'en' AND n_chars BETWEEN 800 AND 3000").orderBy("doc_id").limit(40).collect()]
    turned = [codecs.encode(t, "rot13") for t in texts]
    one, two = features(pa.array(texts)), features(pa.array(turned))
    assert np.allclose(one[:, :33], two[:, :33]) and all(abs(a - b).max() > 0.01 for a, b in zip(one[:, 33:], two[:, 33:]))
    network, prior = train(docs, labels)
    scored = with_scores(spark.createDataFrame(list(enumerate(texts + turned)), "doc_id long, text string"), network, prior)
    score = {r.doc_id: r.score for r in scored.collect()}
    assert np.mean([score[n] != score[n + len(texts)] for n in range(len(texts))]) > 0.9
