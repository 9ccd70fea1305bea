from fidelis.operators.fidelity import Check
from fidelis.sources import files
from fidelis.streaming import streams


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("text a\n", "utf-8")
    (tmp_path / "a.glossary.txt").write_text("# words\none\n\n two \n", "utf-8")
    (tmp_path / "a.humanized.md").write_text("text b\n", "utf-8")
    (tmp_path / "b.txt").write_text("more", "utf-8")
    got = {r.doc_id: (r.text, r.glossary) for r in files.corpus(spark, str(tmp_path)).collect()}
    assert got == {"a": ("text a\n", ["one", "two"]), "b": ("more", None)}
    assert [(r.doc_id, r.text) for r in files.revisions(spark, str(tmp_path)).collect()] == [("a", "text b\n")]


def test_prompts(spark, tmp_path):
    (tmp_path / "review.prompt.md").write_text("---\nname: review\nversion: 1.2\n---\nJudge {{text}}\n---\n")
    (tmp_path / "rewrite.prompt.md").write_text("Rewrite {{text}}")
    got = {r.name: (r.version, r.body) for r in files.prompts(spark, str(tmp_path)).collect()}
    assert got == {"review": ("1.2", "Judge {{text}}\n---\n"), "rewrite": ("0", "Rewrite {{text}}")}


def test_requests(spark):
    rows = spark.createDataFrame([('{"text": "x", "glossary": ["a"]}',), ('{"text": " "}',), ("[1]",), ("{bad",), ('{"text": "x", "glossary": ["%s"]}' % ("y" * 201),)], "body string")
    got = [r.error for r in files.requests(rows).collect()]
    assert got == [None, "no text", "not a JSON object", "not a JSON object", "term too long"]


def test_artifacts_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "It was 5%. Good.")], "doc_id long, text string")
    gate = Check(docs, docs).gate()
    files.write_artifacts(gate, str(tmp_path / "out"), "gate", "run1")
    assert spark.read.json(str(tmp_path / "out/gate")).first().run_id == "run1"
    assert "preserved: 100.0%" in files.reports(gate).first().report


def test_stream_gate(spark, tmp_path):
    spark.sql("SELECT 1L AS doc_id, timestamp'2024-01-01 00:00:00' AS ts, 'It was 5%. Good.' AS text").write.parquet(str(tmp_path / "o"))
    spark.sql("SELECT 1L AS doc_id, timestamp'2024-01-01 01:00:00' AS ts, 'It was 6%. Good.' AS text").write.parquet(str(tmp_path / "r"))
    kind = "doc_id long, ts timestamp, text string"
    pairs = streams.paired(spark.readStream.schema(kind).parquet(str(tmp_path / "o")), spark.readStream.schema(kind).parquet(str(tmp_path / "r")))
    streams.gated(pairs, str(tmp_path / "gate"), str(tmp_path / "state")).awaitTermination()
    assert [r.passed for r in spark.read.parquet(str(tmp_path / "gate")).collect()] == [False]
