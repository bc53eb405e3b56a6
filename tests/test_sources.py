import json

import pytest
from pyspark.sql import functions as F

from patchsieve.sources import contracts as C
from patchsieve.sources import examples as X
from patchsieve.streaming.resume import resume_stream


def line(sha, path, values=(0, 1, 2, 3, 4, 5)):
    return json.dumps({"commit_sha": sha, "file_path": path, "experimental_feature_version": "exp-4.5a", "experimental_features": [float(v) for v in values]})


def put(path, *lines, end="\n"):
    path.write_text("\n".join(lines) + end)
    return str(path)


def test_a_cut_last_record_is_left_out(spark, tmp_path):
    a = put(tmp_path / "a.jsonl", line("s1", "p"), "", line("s1", "q"), line("s2", "p")[:40], end="")
    b = put(tmp_path / "b.jsonl", line("s3", "p"), "  ")
    rows = X.read_checkpoint_lenient(spark, [a, b]).collect()
    assert sorted((r["commit_sha"], r["file_path"]) for r in rows) == [("s1", "p"), ("s1", "q"), ("s3", "p")]


@pytest.mark.parametrize("lines", [["{bad", line("s", "p")], ["{bad", "{bad"]])
def test_a_bad_record_inside_is_an_error(spark, tmp_path, lines):
    with pytest.raises(ValueError, match="malformed"):
        X.read_checkpoint_lenient(spark, [put(tmp_path / "a.jsonl", *lines)])


def test_strict_reading(spark, tmp_path):
    good = put(tmp_path / "g.jsonl", line("s1", "p"), "", line("s2", "p"))
    assert X.read_examples(spark, [good], X.EXPERIMENTAL).count() == 2
    bad = put(tmp_path / "b.jsonl", line("s1", "p"), "{bad")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        X.read_examples(spark, [bad], X.EXPERIMENTAL).collect()


def test_vectors_without_an_experimental_row_are_filled(spark):
    base = spark.createDataFrame([("s", "p", [1.0], [2.0]), ("s", "q", [1.0], [2.0])], "commit_sha string, file_path string, commit_features array<double>, file_features array<double>")
    exp = spark.createDataFrame([("s", "p", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "commit_sha string, file_path string, experimental_features array<double>")
    got = lambda mode: {r["file_path"]: r["vector"] for r in X.assemble_features(base, exp, mode).collect()}
    assert got("E0")["p"] == [1.0, 2.0] and got("E2") == {"p": [1.0, 2.0, 4.0, 5.0, 6.0], "q": [1.0, 2.0, 0.0, 0.0, 0.0]}
    with pytest.raises(ValueError):
        X.assemble_features(base, exp, "E3")


def test_malformed_vectors_stay_and_are_counted(spark):
    schema = "commit_sha string, file_path string, commit_features array<double>, file_features array<double>"
    base = spark.createDataFrame([("s", "p", [1.0], [2.0, 3.0]), ("s", "q", [1.0], [-1.0]), ("t", "r", [1.0], None)], schema)
    exp = spark.createDataFrame([("s", "q", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "commit_sha string, file_path string, experimental_features array<double>")
    out = X.assemble_features(base, exp, "E0", 2)
    assert {r["file_path"]: (r["vector"], r["malformed"]) for r in out.collect()} == {"p": ([1.0, 2.0, 3.0], False), "q": (None, True), "r": (None, True)}
    assert sorted(map(tuple, X.malformed_per_change(out).collect())) == [("s", 2, 1), ("t", 1, 1)]


def test_fingerprint_does_not_depend_on_the_layout(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 3).unionByName(spark.range(40).withColumn("x", F.lit(1).cast("long")))
    one = C.fingerprint(df.repartition(1)).first()["digest"]
    assert one == C.fingerprint(df.repartition(7, "x")).first()["digest"]
    assert one != C.fingerprint(df.where("id <> 3")).first()["digest"]
    C.verify_fingerprint(df, one)
    for wrong in ("", "0" * 64):
        with pytest.raises(ValueError):
            C.verify_fingerprint(df, wrong)


def test_groups_are_done_when_all_files_are(spark):
    rows = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "commit_sha string, file_path string")
    done = spark.createDataFrame([("a", "p"), ("b", "p")], "commit_sha string, file_path string")
    assert [tuple(r) for r in X.resume_todo(rows, done).collect()] == [("a", "q")]
    assert [r[0] for r in X.done_groups(rows, done).collect()] == ["b"]


def test_merge_defaults_to_train(spark):
    part = spark.createDataFrame([("a", "p"), ("b", "p")], "commit_sha string, file_path string")
    keys = spark.createDataFrame([("a", "p", "test")], "commit_sha string, file_path string, split string")
    assert {r["commit_sha"]: r["split"] for r in X.merge_checkpoints([part], keys).collect()} == {"a": "test", "b": "train"}


def test_an_ambiguous_supervised_row_is_an_error(spark):
    rows = spark.createDataFrame([("a", -1)], "commit_sha string, defect_label int")
    with pytest.raises(Exception, match="ambiguous row"):
        X.check_supervised(rows).collect()


def test_stream_resumes_without_repeating(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, schema = str(tmp_path / "out"), "commit_sha string, file_path string"

    def run(checkpoint):
        rows = spark.readStream.schema(schema).json(str(source))
        resume_stream(rows, lambda df: df.withColumn("n", F.length("file_path")), out, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r["commit_sha"], r["file_path"]) for r in spark.read.parquet(out).collect())

    put(source / "1.json", '{"commit_sha":"a","file_path":"p"}', '{"commit_sha":"a","file_path":"p"}')
    assert run("one") == [("a", "p")]
    put(source / "2.json", '{"commit_sha":"a","file_path":"p"}', '{"commit_sha":"b","file_path":"q"}')
    assert run("one") == [("a", "p"), ("b", "q")]
    assert run("two") == [("a", "p"), ("b", "q")]  # another run sees all files again and writes none twice


def test_examples_are_written_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "RECORDS", 40)
    rows = spark.range(200).select(*[
        (F.lit("ambiguous") if n == "label_status" else F.concat(F.lit("s"), "id") if n == "commit_sha" else F.lit(None)).cast(t).alias(n)
        for n, t in ((f.name, f.dataType) for f in X.EXAMPLES.fields)])
    X.write_examples(rows, str(tmp_path))
    files = [p for p in (tmp_path / "ambiguous").iterdir() if p.name.startswith("part-")]
    assert len(files) >= 5 and all(p.name.endswith(".json.gz") for p in files)
    assert X.read_examples(spark, [str(tmp_path / "ambiguous")]).select("commit_sha").distinct().count() == 200
