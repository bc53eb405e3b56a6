import random

import numpy as np
import pytest
from corpus import documents, none

from patchsieve.llm.token_matrices import VOCABULARY, Tokens, best_fit_decreasing, segments, texts, token_matrices


@pytest.mark.parametrize("capacity", [1, 2, 7, 16, 100, 2_048])
def test_tree_finds_the_least_room(capacity):
    rng = random.Random(capacity)
    for _ in range(20):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(150))]
        rows = best_fit_decreasing(lengths, capacity)
        assert sorted(n for row in rows for n in row) == list(range(len(lengths)))
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - n)
        assert sorted(capacity - sum(lengths[n] for n in row) for row in rows) == sorted(rooms)


def test_ids_give_the_text_back():
    tokens = Tokens(VOCABULARY)
    for text in ("", "a", "é ß  \n\t", "a" * 120_000, " " * 120_000, "日本語" * 500, "x y " * 40_000, "^" * 60_000, "<|endoftext|>"):
        ids = tokens.ids(text)
        assert tokens.text(ids) == text and ids[-1] == tokens.end and (ids[:-1] < tokens.end).all()


@pytest.mark.parametrize("window", [3_000, 4_000_000])
def test_cases(spark, window):
    docs = documents(spark)
    matrices = token_matrices(docs, row_tokens=512, window_tokens=window)
    rows = matrices.collect()
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 512
        starts = [int(p) for s, e in zip(r.cu_seqlens, r.cu_seqlens[1:]) for p in range(e - s)]
        assert positions[:r.n_tokens].tolist() == starts and not positions[r.n_tokens:].any()
    assert len({r.row_id for r in rows}) == len(rows)
    back = texts(matrices).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    parts = segments(matrices).collect()
    assert all(p.resets for p in parts) and sum(p.n_tokens for p in parts) == sum(r.n_tokens for r in rows)


def test_no_rows(spark):
    assert segments(token_matrices(none(spark))).count() == 0
