import json

from pyspark.sql import functions as F

from quern.operators.current import current_files
from quern.sources import records
from quern.sources.issues import IssueSource
from quern.sources.report import render_report
from quern.sources.store import VectorTable
from quern.sources.tree import scan_tree
from quern.streaming.incremental import event_windows, file_versions, keep_current, run


def test_scan_tree(spark, tmp_path):
    for p, b in {"src/main.py": b"x = 1\n", "README.md": b"# A\n", "node_modules/l.js": b"1", "bin.py": b"a\0b", "bad.txt": b"caf\xe9", "x.bin": b"1"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    got = {r["repo_path"]: (r["language"], r["raw_content"], r["file_ord"]) for r in scan_tree(spark, str(tmp_path), "r").collect()}
    assert got == {"README.md": ("markdown", "# A\n", 0), "bad.txt": ("text", "caf�", 1), "src/main.py": ("python", "x = 1\n", 2)}


def test_vector_table(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "v"))
    assert t.count() == 0
    s = "repo_name string, id string, seq int, document string"
    t.upsert(spark.createDataFrame([("r", "1", 1, "x"), ("r", "1", 2, "y"), ("q", "1", 1, "z")], s), "seq")
    t.upsert(spark.createDataFrame([("r", "1", 9, "new"), ("r", "2", 1, "w")], s), "seq")
    assert sorted((r["repo_name"], r["id"], r["document"]) for r in t.rows().collect()) == [("q", "1", "z"), ("r", "1", "new"), ("r", "2", "w")]
    t.delete_repo("r")
    assert t.count() == 1


def test_json_round_trips(spark, tmp_path):
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "c")], "src string, ord int, dst string")
    records.write_json(records.graph_for_export(edges), str(tmp_path / "g"))
    assert {tuple(r) for r in records.read_graph(spark, str(tmp_path / "g")).collect()} == {tuple(r) for r in edges.collect()}
    files = spark.createDataFrame([("r", "a.py", "/a.py", "python", 3, "x=1")], "repo_name string, repo_path string, abs_path string, language string, size_bytes bigint, raw_content string")
    chunks = spark.createDataFrame([("r", "a.py", "i", "x=1", "module", 1, 1, None, 3, None)], "repo_name string, repo_path string, id string, content string, chunk_type string, start_line int, end_line int, symbol_name string, token_count int, language string")
    records.write_json(records.chunks_for_export(chunks, files.select("repo_name", "repo_path", "abs_path", "language", "size_bytes", "raw_content")).drop("language"), str(tmp_path / "c"))
    assert records.read_chunks(spark, str(tmp_path / "c")).first()["repo_path"] == "a.py"
    (tmp_path / "d.json").write_text(json.dumps({"name": "x", "qa_pairs": [{"id": "1", "question": "q", "answer_score": 3}]}, indent=2))
    assert records.read_dataset(spark, str(tmp_path / "d.json")).first()["answer_score"] == 3


def test_results_and_report(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"type": "metadata"}\n\n{"type": "result", "config": "full", "retrieval_recall": 0.5}\n{"type": "result", "config": "x", "error": "boom"}\n')
    rows = records.read_results(spark, str(tmp_path / "r.jsonl"))
    assert [r["config"] for r in rows.collect()] == ["full"]
    t = rows.groupBy("config").agg(F.avg("retrieval_recall").alias("recall"))
    assert "| full | 0.500 |" in render_report([("Recall", t, "config")])
    records.write_scores_csv(t, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["recall"] == "0.500"


def test_issue_source(spark, tmp_path):
    base = tmp_path / "api/repos/a/b/issues"
    (base / "1").mkdir(parents=True)
    (base / "page_1.json").write_text(json.dumps([{"number": 1, "title": "T", "body": "B", "html_url": "u"}, {"number": 2, "pull_request": {}}]))
    (base / "1/comments.json").write_text(json.dumps([{"body": "c", "reactions": {"+1": 4, "url": "x"}}]))
    spark.dataSource.register(IssueSource)
    rows = spark.read.format("issues").option("repos", "a/b,no/ne").option("base", f"file://{tmp_path}/api").load().collect()
    assert [(r["repo"], r["issue"], r["comment"], r["reactions"]) for r in rows] == [("a/b", 1, "c", {"+1": 4})]


def test_streaming_keeps_the_newest(spark, tmp_path):
    from datetime import datetime as d

    s = "repo_name string, repo_path string, language string, size_bytes bigint, raw_content string, crawled_at timestamp_ntz"
    table = VectorTable(spark, str(tmp_path / "t"))
    for rows in ([("r", "a", "py", 1, "new", d(2024, 2, 1)), ("q", "z", "py", 1, "z", d(2024, 1, 1))], [("r", "a", "py", 1, "late and old", d(2024, 1, 1)), ("r", "b", "py", 1, "b", d(2024, 1, 1))]):
        spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        run(keep_current(file_versions(spark, str(tmp_path / "in"), schema), table, str(tmp_path / "cp")))
    assert sorted((r["repo_path"], r["raw_content"]) for r in table.rows().collect()) == [("a", "new"), ("b", "b"), ("z", "z")]
    assert current_files(table.rows().drop("id")).count() == 3


def test_event_windows(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    assert event_windows(e).agg(F.sum("n")).first()[0] == e.count()
