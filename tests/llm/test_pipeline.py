from corpus import documents

import corpus_pipeline as p
from patchsieve.llm.near_dups import near_duplicates
from patchsieve.llm.packing import packed

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage on what the one before it kept; clean documents stay, leaks and copies go."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "packing"]
    good = p.STAGES[0][1](spark, docs, FOLDER).cache()
    ids = {r.doc_id for r in good.collect()}
    judged = [(q, i in ids) for i, q in labels.items()]
    assert sum(q == kept for q, kept in judged) >= 0.97 * len(judged)
    single = p.STAGES[1][1](spark, good, FOLDER).cache()
    want = sorted(r.component_id for r in near_duplicates(good).where("kept").collect())
    assert sorted(r.doc_id for r in single.collect()) == want and single.columns == p.COLUMNS
    clean = p.STAGES[2][1](spark, single, FOLDER)
    kept = clean.collect()
    assert not [r.doc_id for r in kept if any(t in r.text for t in items)]
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in kept}
    assert gone and clean.columns == p.COLUMNS
    assert p.STAGES[3][1](spark, clean, FOLDER).select("doc_id").distinct().count() == len(kept)


def test_run_is_the_stages_in_turn(spark):
    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.columns == packed(documents(spark)).columns and 0 < out.count() <= 400


def test_stages_bear_the_cases(spark):
    docs = documents(spark)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == p.COLUMNS
    assert p.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()
