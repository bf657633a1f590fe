from pyspark.sql import functions as F

from quern.operators.citations import citation_accuracy, coverage, extract_citations, parse_answer, verify_citations
from quern.operators.current import current_files
from quern.operators.current_rows import first_by, last_by, symmetric_difference, with_ordinal
from quern.operators.evaluation import aggregate_by, config_deltas, error_bucket, extract_identifiers, judge_aggregate, keyword_recall, parse_judge, pivot_mean_std, reference_keywords
from quern.operators.mining import best_answers, curated, mined_pairs
from quern.operators.packing import build_context, pack_prefix, pack_skip
from quern.operators.summaries import summarize


def test_extract_citations(spark):
    a = spark.createDataFrame([("1", "see [a/b.py:10-42] and [c.py] [TODO] [x/y.py:7]"), ("2", None), ("3", "none")], "id string, answer string")
    got = {(r["answer_id"], r["file_path"], r["start_line"], r["end_line"]) for r in extract_citations(a).collect()}
    assert got == {("1", "a/b.py", 10, 42), ("1", "c.py", None, None), ("1", "x/y.py", 7, 7)}


def test_verify_and_coverage(spark):
    a = spark.createDataFrame([("1", "[p.py:10-20] [q.py] [gone.py]"), ("2", "[p.py:50-60]")], "id string, answer string")
    chunks = spark.createDataFrame([("p.py", 1, 9, 1), ("p.py", 20, 30, 2), ("q.py", None, None, 3), ("p.py", 20, 30, 2)], "repo_path string, start_line int, end_line int, seq bigint")
    v = verify_citations(extract_citations(a), chunks)
    got = {(r["answer_id"], r["file_path"]): (r["verified"], r["chunk_seq"]) for r in v.collect()}
    assert got == {("1", "p.py"): (True, 2), ("1", "q.py"): (True, 3), ("1", "gone.py"): (False, None), ("2", "p.py"): (False, None)}
    c = {r["answer_id"]: (r["n_citations"], r["n_verified"], r["low_coverage"]) for r in coverage(v).collect()}
    assert c == {"1": (3, 2, False), "2": (1, 0, True)}
    acc = {r["answer_id"]: r["accuracy"] for r in citation_accuracy(a.union(spark.createDataFrame([("3", "no")], "id string, answer string")), extract_citations(a), chunks).collect()}
    assert abs(acc["1"] - 2 / 3) < 1e-9 and acc["2"] == 1.0 and acc["3"] == 1.0


def test_parse_answer(spark):
    raw = spark.createDataFrame([("plain text",), ("ANSWER: it works\nCITATIONS: [a.py]\nCONFIDENCE: HIGH",), ("answer: x CONFIDENCE: sure",)], "raw string")
    a, c = parse_answer(F.col("raw"))
    assert [(r[0], r[1]) for r in raw.select(a, c).collect()] == [("plain text", "medium"), ("it works", "high"), ("x", "medium")]


def test_packing(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 9), (1, 4, 1), (2, 1, 50), (2, 2, 1)], "q int, rank int, n int")
    got = {(r["q"], r["rank"]) for r in pack_prefix(rows, ["q"], ["rank"], "n", 9).collect()}
    assert got == {(1, 1), (1, 2), (2, 1)}
    skip = spark.createDataFrame([("f", 1, 3), ("f", 2, 9), ("f", 3, 2), ("f", 4, 4)], "f string, k int, n int")
    r = pack_skip(skip, ["f"], ["k"], "k", "n", 9).first()
    assert r["items"] == [1, 3, 4] and r["used"] == 9
    c = spark.createDataFrame([(1, 1, "a.py", 1, 2, "function", "f", "python", "x"), (1, 2, "b.py", None, None, None, None, None, "y")], "question_id int, rank int, repo_path string, start_line int, end_line int, chunk_type string, symbol_name string, language string, content string")
    assert build_context(c).first()["context"] == "[a.py:1-2 | function: f]\n```python\nx\n```\n\n[b.py:?-? | prose]\n```\ny\n```"


def test_keywords(spark):
    t = spark.createDataFrame([("Use `Foo.bar()` with snake_case and CamelCase, the öffnet",), ("",)], "t string")
    rows = [r[0] for r in t.select(reference_keywords(F.col("t"))).collect()]
    assert rows == [["bar", "camelcase", "foo.bar", "snake_case"], []]
    r = spark.range(1).select(keyword_recall(F.array(F.lit("foo"), F.lit("bar")), F.lit("FOO x")), keyword_recall(F.array().cast("array<string>"), F.lit("x"))).first()
    assert (r[0], r[1]) == (0.5, 0.0)


def test_judge(spark):
    raw = spark.createDataFrame([("q", '{"accuracy": 3} then {"accuracy": 11, "completeness": 0, "relevance": 7, "clarity": 5, "reasoning": "ok"}'), ("q", "broken"), ("p", '{"accuracy": 7}')], "q string, raw string")
    s = raw.select(parse_judge(F.col("raw")).alias("s")).first()["s"]
    assert (s["accuracy"], s["completeness"], s["relevance"], s["reasoning"]) == (10, 1, 7, "ok")
    agg = {r["q"]: (r["n_runs"], r["accuracy_mean"], r["accuracy_std"]) for r in judge_aggregate(raw, "q").collect()}
    assert agg == {"q": (1, 10.0, 0.0), "p": (1, 7.0, 0.0)}


def test_tables(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 5.0)], "c string, t string, v double")
    got = {r["c"]: (r["n"], r["v_mean"], round(r["v_std"], 6)) for r in aggregate_by(rows, ["c"], ["v"]).collect()}
    assert got == {"a": (2, 2.0, 1.414214), "b": (1, 5.0, 0.0)}
    p = {r["c"]: (r["x_mean"], r["y_mean"]) for r in pivot_mean_std(rows, "c", "t", ["x", "y"], "v").collect()}
    assert p == {"a": (2.0, 0.0), "b": (0.0, 5.0)}
    d = {r["c"]: r["delta"] for r in config_deltas(rows.groupBy("c").agg(F.avg("v").alias("v")), "c", "a", "v").collect()}
    assert d == {"a": 0.0, "b": -3.0}
    e = spark.createDataFrame([(0.0, 1, True, True, 1.0, 9.0), (0.5, 0, True, True, 1.0, 9.0), (0.5, 1, False, True, 1.0, 9.0), (0.5, 1, True, False, 1.0, 9.0), (0.5, 1, True, True, 0.0, 9.0), (0.5, 1, True, True, 1.0, 5.9), (0.5, 1, None, True, None, None)], "r double, n int, t boolean, g boolean, c double, j double")
    got = [r[0] for r in e.select(error_bucket(*[F.col(x) for x in ("r", "n", "t", "g", "c", "j")])).collect()]
    assert got == ["retrieval_miss", "empty_context", "wrong_routing", "cited_wrong_path", "unverified_citation", "low_judge_quality", "clean_pass"]
    i = spark.range(1).select(extract_identifiers(F.lit("`parse_it` calls run() and `a b` or `xy`"))).first()[0]
    assert i == ["parse_it", "run"]
    i = spark.range(1).select(extract_identifiers(F.lit("`@app.route` `file` `None` ` x() ` `x_y()`, run() name()"))).first()[0]
    assert i == ["app.route", "run", "x_y"]


def test_mining(spark):
    c = spark.createDataFrame([("r", 1, 0, "first", {"+1": 3}), ("r", 1, 1, "second", {"+1": 2, "heart": 3}), ("r", 1, 2, "third", {"rocket": 5}), ("r", 2, 0, "low", {"+1": 1}), ("r", 3, 0, "none", None)], "repo string, issue bigint, comment_ord int, body string, reactions map<string,int>")
    best = best_answers(c).collect()
    assert [(r["issue"], r["body"]) for r in best] == [(1, "second")]
    issues = spark.createDataFrame([("r", 1, "T", "b" * 40), ("r", 2, "T", "short")], "repo string, issue bigint, title string, body string")
    assert mined_pairs(issues, c).count() == 1
    pairs = spark.createDataFrame([(5, "q" * 80), (5, "see https://x " + "q" * 80), (4, "q" * 90), (None, "q" * 90)], "answer_score int, question string")
    assert curated(pairs).count() == 1


def test_row_choices(spark):
    t = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("z", 3, "w")], "id string, seq int, c string")
    assert {(r["id"], r["c"]) for r in first_by(t, ["id"], "seq").collect()} == {("k", "x"), ("z", "w")}
    assert {(r["id"], r["c"]) for r in last_by(t, ["id"], "seq").collect()} == {("k", "y"), ("z", "w")}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r["x"], r["side"]) for r in symmetric_difference(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]


def test_ordinals(spark):
    rows = spark.range(1000).selectExpr("concat('p', lpad((id * 7919) % 1000, 4, '0')) p").repartition(7)
    got = sorted((r["p"], r["o"]) for r in with_ordinal(rows, ["p"], "o").collect())
    assert [o for _, o in got] == list(range(1000))


def test_current_files(spark):
    s = "repo_name string, repo_path string, language string, size_bytes bigint, raw_content string, crawled_at timestamp_ntz"
    from datetime import datetime as d

    rows = [("r", "a", "py", 1, "old", d(2024, 1, 1)), ("r", "a", "py", 1, None, d(2024, 2, 1)), ("r", "b", None, None, "x", None), ("r", "b", None, None, "y", d(2020, 1, 1)), (None, "c", "py", 0, "z", None)]
    got = {(r["repo_path"], r["raw_content"]) for r in current_files(spark.createDataFrame(rows, s)).collect()}
    assert got == {("a", None), ("b", "y"), ("c", "z")}


def test_summaries(spark):
    s = "repo_name string, id string, repo_path string, content string, chunk_type string, start_line int, end_line int, token_count int, chunk_ord int, seq bigint"
    rows = [("r", "1", "src/a.py", "x = 1\ny", "module", 1, 2, 3, 0, 1), ("r", "2", "src/a.py", "def f(): pass", "function", 3, 3, 5, 1, 2), ("r", "3", "src/sub/b.py", "z", "prose", 1, 1, 1, 0, 3), ("r", "3", "src/sub/b.py", "z", "prose", 1, 1, 1, 0, 3)]
    got = {(r["level"], r["path"]): r for r in summarize(spark.createDataFrame(rows, s)).collect()}
    assert set(got) == {("file", "src/a.py"), ("file", "src/sub/b.py"), ("directory", "src"), ("directory", "src/sub"), ("project", ".")}
    assert got["file", "src/a.py"]["source_ids"] == ["1", "2"] and got["file", "src/a.py"]["content"].startswith("def f")


def test_first_chunk_over_the_budget_is_cut(spark):
    from quern.operators.packing import build_context

    chunk = lambda n, rank: (1, rank, "a.py", 1, 2, "function", "f", "python", "word " * n)
    schema = "question_id bigint, rank int, repo_path string, start_line int, end_line int, chunk_type string, symbol_name string, language string, content string"
    r = build_context(spark.createDataFrame([chunk(9000, 1), chunk(5, 2)], schema), 4000).first()
    assert r["n_chunks"] == 1 and 3950 <= r["used"] <= 4000 and r["context"].endswith("[...truncated...]\n```") and r["context"].count("word") == 3950
    r = build_context(spark.createDataFrame([chunk(5, 1), chunk(9000, 2), chunk(5, 3)], schema), 4000).first()
    assert r["n_chunks"] == 1 and "truncated" not in r["context"]


def test_report_order_is_a_parameter(spark):
    from quern.sources.report import markdown_table

    t = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "config string, n int")
    assert [x.split(" ")[1] for x in markdown_table(t, "config", ("c", "b")).split("\n")[2:]] == ["c", "b", "a"]
