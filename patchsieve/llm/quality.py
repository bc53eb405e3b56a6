"""Quality scores by positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled texts train a small network on features of whole texts: byte classes,
sizes, repetition, and the words themselves, hashed to a fixed number of shares. Two bounded samples reach the driver as feature rows only; everything else is distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchsieve.llm.common import strings, utf8
from patchsieve.llm.shingles import _PLACES, _U, mix, words_of

_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?",
    b";:", b"\"'`", b"-_", b"()[]{}<>", b"|", b"#", b"$", b"%", b"&", b"*", b"+=^~", b"@/\\", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)),
]
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _n, _members in enumerate(_GROUPS):
    _CLASS[list(_members)] = _n
CLASSES = len(_GROUPS) + 1
WORD_BITS = 4  # words fall into so many shares, as a power of two, by the upper bits of their hash
COUNTS = CLASSES + 8
FEATURES = COUNTS + (1 << WORD_BITS)


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: shares of byte classes, sizes, how often words and word groups repeat, shares of hashed words."""
    texts = strings(texts)
    raw, at = utf8(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, h, counts in words_of(texts):
        word = 0
        wide = sum((h[j:len(h) - 2 + j] * _PLACES[j] for j in range(3)), np.zeros(max(len(h) - 2, 0), _U)) if len(h) > 2 else h[:0]
        wide = mix(wide)
        for row, n in enumerate(counts.tolist(), i):
            lo, hi = at[row], at[row + 1]
            size = hi - lo
            for part in range(lo, hi, 1 << 20):
                out[row, :CLASSES] += np.bincount(_CLASS[raw[part:min(part + (1 << 20), hi)]], minlength=CLASSES)
            tail = out[row, CLASSES:COUNTS]
            out[row, :CLASSES] /= max(size, 1)
            tail[0], tail[1] = np.log1p(size), np.log1p(n)
            if n:
                own = np.sort(h[word:word + n])
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                tail[2] = size / n
                tail[3] = len(new) / n
                tail[4] = np.diff(np.append(new, n)).max() / n
                tail[5] = len(new) / np.sqrt(n)
                out[row, COUNTS:] = np.bincount((h[word:word + n] >> _U(64 - WORD_BITS)).view(np.int64), minlength=1 << WORD_BITS) / n
            if n > 2:
                tri = np.sort(wide[word:word + n - 2])
                tail[6] = 1 + np.count_nonzero(tri[1:] != tri[:-1])
                tail[6] /= n - 2
                tail[7] = np.count_nonzero(h[word + 1:word + n] == h[word:word + n - 1]) / n
            word += n
    return out


def _logit_loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss of the label 1 and its slope; the label 0 has those of -z."""
    return np.logaddexp(0, -z), -1 / (1 + np.exp(np.clip(z, -50, 50)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ a + b) @ c + d


def _train(x_pos: np.ndarray, x_all: np.ndarray, prior: float | None, hidden: int, epochs: int, seed: int) -> Network:
    """Minimise the non-negative unbiased risk; without a prior, tell positives from all texts.

    Where a batch's estimated negative risk falls below zero, its gradient is turned round, so that
    the network cannot fit the unlabelled rows one by one.
    """
    rng = np.random.default_rng(seed)
    mean, scale = x_all.mean(0), x_all.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (x_pos, x_all))
    n = p.shape[1]
    w = [rng.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    step, size = 0, min(1_024, len(p), len(u))
    for epoch in range(epochs):
        for _ in range(max(1, len(u) // size)):
            bp, bu = p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]
            both = np.concatenate([bp, bu])
            inner = np.tanh(both @ w[0] + w[1])
            z = inner @ w[2] + w[3]
            zp, zu = z[:size], z[size:]
            up_p, slope_up_p = _logit_loss(zp)
            down_p, slope_down_p = _logit_loss(-zp)
            down_u, slope_down_u = _logit_loss(-zu)
            if prior is None:
                g = np.concatenate([slope_up_p, -slope_down_u])
            elif down_u.mean() - prior * down_p.mean() >= 0:
                g = np.concatenate([prior * slope_up_p + prior * slope_down_p, -slope_down_u])
            else:
                g = np.concatenate([-prior * slope_down_p, slope_down_u])
            g = g / size
            back = np.outer(g, w[2]) * (1 - inner**2)
            grads = [both.T @ back + 1e-4 * w[0], back.sum(0), inner.T @ g + 1e-4 * w[2], g.sum()]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, w)


def class_prior(pos_scores: np.ndarray, all_scores: np.ndarray, risk: float = 0.05) -> float:
    """The share of positives among unlabelled rows: the least ratio, over score cuts, of the share of
    unlabelled rows above the cut to that of positives, with a margin for the sample size."""
    cuts = np.quantile(pos_scores, np.linspace(0.02, 0.98, 97))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    margin = np.sqrt(np.log(4 / risk) / 2) * (len(pos_scores)**-0.5 + len(all_scores)**-0.5)
    qp, qu = above(pos_scores), above(all_scores)
    best = np.argmin((qu + margin) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.99))


def fit(x_pos: np.ndarray, x_all: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7) -> tuple[Network | None, float]:
    """The network and the prior. The prior is read off the half of each sample that its own
    network did not see. No positives or no texts give no network."""
    if not len(x_pos) or not len(x_all):
        return None, 0.5
    probe = _train(x_pos[::2], x_all[::2], None, hidden, max(20, epochs // 2), seed)
    one, two = x_pos[1::2] if len(x_pos) > 1 else x_pos, x_all[1::2] if len(x_all) > 1 else x_all
    prior = class_prior(probe.logits(one), probe.logits(two))
    return _train(x_pos, x_all, prior, hidden, epochs, seed), prior


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array(list(features(batch.column("text"))), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], names=["doc_id", "x"])


def held_out(doc_id="doc_id"):
    """Every fifth document by the checksum of its id is never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _rows(df: DataFrame, bound: int) -> np.ndarray:
    got = df.limit(bound).toPandas()["x"]
    return np.array(got.tolist(), np.float32).reshape(-1, FEATURES).astype(np.float64)


def train(documents: DataFrame, labels: DataFrame, positives: int = 20_000, unlabelled: int = 40_000, seed: int = 7) -> tuple[Network | None, float]:
    """Fit on at most `positives` trusted and `unlabelled` other documents outside the held-out fold.

    A document is trusted if all its labels say quality 1. Ids, languages and sources are not inputs.
    """
    trusted = labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1 AND doc_id IS NOT NULL")
    share = positives / max(trusted.count(), 1)
    # a little over the bound is drawn and cut back, so that a small table gives all it has
    chosen = trusted.select("doc_id").where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 1.1 * share) * (1 << 30))).limit(positives)
    learn = documents.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, x array<float>"
    # at most `positives` ids are broadcast
    first = learn.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(_feature_rows, schema).dropDuplicates(["doc_id"])
    share = 1.1 * unlabelled / max(learn.count(), 1)
    other = (learn if share >= 1 else learn.where(F.rand(seed) < share)).mapInArrow(_feature_rows, schema)
    return fit(_rows(first, positives), _rows(other, unlabelled), seed=seed)


def with_scores(documents: DataFrame, network: Network | None, prior: float) -> DataFrame:
    """`documents` with a column score from 0 to 1, in place of one of that name; without a network every score is the prior."""
    documents = documents.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if network is None:
                score = np.full(batch.num_rows, prior)
            else:
                score = 1 / (1 + np.exp(-np.clip(network.logits(features(batch.column("text")).astype(np.float64)), -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    schema = T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())])
    return documents.mapInArrow(run, schema)


def quality(documents: DataFrame, labels: DataFrame, cut: float = 0.3, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `documents` (doc_id, text).

    Null texts score as empty ones, equal texts alike. Labels of ids that are not there, repeated or
    null are passed over; without any positive every score is 0.5. More columns are ignored.
    """
    network, prior = train(documents, labels, **bounds)
    scored = with_scores(documents.select("doc_id", "text"), network, prior)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
