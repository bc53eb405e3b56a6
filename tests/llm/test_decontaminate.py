import random

from corpus import documents, none, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from patchsieve.llm.decontaminate import Pattern, Searcher, budget, contaminated, item_text, nearest, normal, pieces, without_passages

ITEMS = "item_id long, text string"


def distance(item, text):
    """The least edits to any part of `text`, by the table of all prefixes."""
    row = [0] * (len(text) + 1)
    for n, c in enumerate(item, 1):
        new = [n]
        for m, d in enumerate(text, 1):
            new.append(min(row[m] + 1, new[m - 1] + 1, row[m - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_bit_parallel_distance(item, text):
    found, end = Pattern(item).best(text)
    assert found == distance(item, text)
    hit = nearest(item, text, len(item))
    assert hit[0] == found and distance(item, text[hit[1]:hit[2]]) == found


@given(st.text("abcdefgh", min_size=1, max_size=400))
def test_pieces_make_the_item(item):
    k = budget(len(item))
    cut = pieces(item, k)
    assert len(cut) == k + 1 and "".join(p for _, p in cut) == item and all(item[a:].startswith(p) for a, p in cut)


def test_every_passage_within_the_budget_is_found():
    rng = random.Random(3)
    items = [(n, prose(100 + n, 25)) for n in range(4)]
    search = Searcher(items)
    for n, text in items:
        item = item_text(text)
        for _ in range(4):
            letters = list(item)
            for _ in range(budget(len(item))):
                at = rng.randrange(len(letters))
                letters[at:at + rng.randrange(2)] = rng.choice("qwzü")
            body = normal(f"{prose(7, 12)} {''.join(letters)} {prose(8, 12)}")[0]
            near = [i for i, t in items if distance(item_text(t), body) <= budget(len(item_text(t)))]
            assert sorted(h[0] for h in search.hits(body)) == near and n in near


def test_cases(spark):
    docs = documents(spark)
    passage = " ".join(prose(2, 90).split()[20:50])
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "!!"), (5, "one two"), (6, "ne tw"), (None, "straße")], ITEMS)
    rows = contaminated(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == sorted([(7, 1), (8, 5), (9, 5), (2**62, None)], key=str)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in (8, 9, 2**62)}
    assert {r.doc_id: texts[r.doc_id][r.start:r.end] for r in rows if r.doc_id in texts} == {8: "one two", 9: "ONE  two", 2**62: "straße"}
    clean = without_passages(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 4
    assert contaminated(docs, items, block_chars=10).count() == 4
    assert contaminated(none(spark), items).count() == 0
    assert contaminated(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).where("distance = 0").collect()}
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if f" {item_text(i.text)} " in f" {item_text(d.text or '')} "}
    assert got >= want and want


def test_many_blocks_leave_no_block_in_the_plan(spark, capsys):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "one two"), (2, "straße"), (3, "a new sentence that is found nowhere"), (1, "one two")], ITEMS)
    one, many = without_passages(docs, items), without_passages(docs, items, block_chars=10)
    count = lambda df: sorted(map(str, df.collect()))
    assert many.columns == docs.columns and count(many) == count(one) and len(count(one)) < docs.count()
    capsys.readouterr()
    many.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    one.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
