"""Queries that search the whole texts of a change, not the first of them."""

from types import SimpleNamespace

import __spark_entry__  # noqa: F401
from patchsieve.plans import attribution, functions


def tables(spark):
    rows = [(0, "xx", "a one b"), (1, "xx", "a two b"), (2, "xx", "a three b"), (3, "xx", "c"), (5, "xx", None)]
    return SimpleNamespace(documents=spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_every_text_of_a_change_is_searched(spark):
    got = {r["sha"]: (r["files"], r["matched"]) for r in attribution.message_mentions_whole(tables(spark)).collect()}
    assert got[0] == (3, 3)
    first = {r["sha"]: (r["files"], r["matched"]) for r in attribution.message_mentions(tables(spark)).collect()}
    assert first[0] == (3, 1)  # what is kept by the older query: the first text only


def test_the_reference_stands_before_the_text(spark):
    rows = [(2, "xx", "was reverted by " + "d" * 40), (6, "xx", "nothing")]
    t = SimpleNamespace(documents=spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert {r["doc_id"]: r["prefix"] for r in functions.fix_prefix(t).collect()} == {2: None, 6: None}
    assert {r["doc_id"]: r["prefix"] for r in functions.fix_prefix_whole(t).collect()}[2] == "d" * 40
