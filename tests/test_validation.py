from pyspark.sql import functions as F

from quern.operators.evaluation import finding, retrieval_verdict
from quern.operators.index import build_index, chunk_rows, embed, first_files, readme_excerpt, with_sentinels
from quern.operators.summaries import complete, summarize
from quern.operators.validation import cited_paths, gold_coverage, level_checks, pass_rates, rewrite_answers, source_texts, split_identifiers

CHUNKS = "repo_name string, id string, repo_path string, content string, chunk_type string, start_line int, end_line int, symbol_name string, token_count int, language string, chunk_ord int, seq bigint"
ROWS = [
    ("o/repo", "1", "src/a.py", "def keep_it(): pass", "function", 1, 2, "keep_it", 5, "python", 0, 1), ("o/repo", "1", "src/a.py", "def keep_it(): pass", "function", 1, 2, "keep_it", 5, "python", 0, 1),
    ("o/repo", "1", "src/b.py", "other text", "module", None, None, None, 2, None, 0, 2), ("o/repo", "3", "README.md", "\n".join(f"line {i} of the readme" for i in range(200)), "prose", 1, 200, None, 900, "markdown", 0, 3),
]


def test_identifiers(spark):
    code, paths = split_identifiers(F.lit("`keep_it` calls run() in `src/a.py`, `the` and `docs/x y.md`"))
    r = spark.range(1).select(code, paths).first()
    assert r[0] == ["keep_it", "run"] and r[1] == ["docs/x y.md", "src/a.py"]
    assert spark.range(1).select(cited_paths(F.lit("[a b.py:1-2] [x] [c.ts] [c.ts:3]"))).first()[0] == ["a b.py", "c.ts"]


def test_level_checks(spark):
    chunks = spark.createDataFrame(ROWS, CHUNKS)
    words = " ".join(["word"] * 40)
    s = spark.createDataFrame([("o/repo", "file", "src/a.py", f"a.py has `keep_it` {words}", 45), ("o/repo", "file", "src/b.py", "nothing `gone_one` `gone_two`", 5), ("o/repo", "directory", "src", f"src holds `a.py` {words}", 60)], "repo_name string, level string, path string, content string, token_count int")
    got = {r["path"]: (r["mentions_self"], r["length_ok"], r["scope_ok"], r["grounded_ok"], r["passed"]) for r in level_checks(s, source_texts(chunks)).collect()}
    assert got == {"src/a.py": (True, True, True, True, True), "src/b.py": (False, False, True, False, False), "src": (True, True, True, True, True)}
    assert {r["level"]: (r["n"], r["passed"]) for r in pass_rates(level_checks(s, source_texts(chunks))).collect()} == {"file": (2, 1), "directory": (1, 1)}


def test_gold_and_answers(spark):
    gold = spark.createDataFrame([("q", "o/repo", "src/a.py", 2, 9), ("q", "o/repo", "gone.py", None, None), ("p", "o/repo", "src/b.py", None, None)], "qid string, repo_name string, path string, lo int, hi int")
    got = {r["qid"]: (r["n_paths"], r["n_indexed"], r["n_chunks"]) for r in gold_coverage(gold, spark.createDataFrame(ROWS, CHUNKS)).collect()}
    assert got == {"q": (2, 1, 1), "p": (1, 1, 1)}
    pairs = spark.createDataFrame([("1", "old"), ("2", "kept")], "id string, answer string")
    out = {r["id"]: (r["answer"], r["original_answer"]) for r in rewrite_answers(pairs, spark.createDataFrame([("1", "new"), ("9", "x")], "id string, answer string")).collect()}
    assert out == {"1": ("new", "old"), "2": ("kept", None)}


def test_index(spark):
    chunks = spark.createDataFrame(ROWS, CHUNKS)
    rows = build_index(chunks, summarize(chunks)).collect()
    ids = [(r["doc_type"], r["id"]) for r in rows]
    assert ids.count(("chunk", "1")) == 1 and ids.count(("chunk", "3")) == 1 and all(len(r["embedding"]) == 64 for r in rows if r["document"])
    flat = {r["seq"]: (r["start_line"], r["symbol_name"]) for r in with_sentinels(chunk_rows(chunks)).collect()}
    assert flat[2] == (-1, "") and flat[1] == (1, "keep_it")
    vec = embed(spark.createDataFrame([("ab",), (None,)], "document string"), lambda ts: [[float(len(t))] for t in ts]).collect()
    assert [list(r["embedding"]) for r in vec] == [[2.0], [0.0]]
    excerpt = readme_excerpt(chunks).first()["excerpt"]
    assert excerpt.startswith("line 0") and excerpt.endswith("\n...[truncated]") and len(excerpt.split("\n")) == 101
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "c")], "question_id int, rank int, repo_path string")
    assert first_files(ranked, 2).first()["files"] == ["a", "b"]


def test_failing_provider(spark):
    def boom(_):
        raise RuntimeError

    assert complete(spark.createDataFrame([("x",)], "prompt string"), boom).first()["content"] is None
    assert embed(spark.createDataFrame([("x",)], "document string"), boom).first()["embedding"] is None


def test_verdicts(spark):
    r = spark.range(1).select(retrieval_verdict(F.lit(0.5), F.lit(0.4), F.lit(0.5)), finding(F.lit(0.4)), finding(F.lit(-0.1)), finding(F.lit(0.01))).first()
    assert tuple(r) == ("equal", "validated", "noticeable", "marginal")


def test_no_text_per_scope(spark, monkeypatch):
    """Names go to the files: no row holds more than one chunk's text, and a scope of many files is dealt to several tasks."""
    from quern.operators import validation

    monkeypatch.setattr(validation, "SCOPE_FILES", 2)
    t = [("o/r", str(i), f"src/d{i % 2}/f{i}.py", f"def name_{i}(): pass", "function", 1, 1, None, 4, "python", 0, i) for i in range(9)]
    t.append(("o/r", "x", "src/d0/f0.py", "def second_part(): pass", "function", 2, 2, None, 4, "python", 1, 100))
    chunks = spark.createDataFrame(t, CHUNKS)
    assert max(len(r["text"]) for r in source_texts(chunks).collect()) == max(len(x[3]) for x in t)
    names = lambda *xs: " ".join(f"`{x}`" for x in xs)
    said = {
        ("project", "."): (names("name_0", "name_7", "second_part", "gone_a", "gone_b"), True), ("directory", "."): (names("name_0", "name_7", "gone_a", "gone_b"), False),
        ("directory", "src/d0"): (names("name_0", "second_part", "d0/f2.py", "name_1"), True), ("directory", "src/d1"): (names("name_0", "name_2", "f2.py", "name_1"), False),
        ("file", "src/d0/f0.py"): (names("name_0", "second_part", "f0.py", "0/f0.py"), True), ("file", "src/d0/f2.py"): (names("ame_2", "f0.py", "name_4"), False), ("directory", "gone"): ("`name_0`", False),
    }
    s = spark.createDataFrame([("o/r", level, path, text, 60) for (level, path), (text, _) in said.items()], "repo_name string, level string, path string, content string, token_count int")
    got = {(r["level"], r["path"]): r["grounded_ok"] for r in level_checks(s, source_texts(chunks)).collect()}
    assert got == {k: ok for k, (_, ok) in said.items()}


def test_roll_up_collects_no_omitted_bullet(spark):
    from quern.operators.summaries import _fitting

    n = 3000
    rows = spark.range(n).selectExpr("'r' repo_name", "'d' parent", "concat('d/f', lpad(id, 5, '0')) path", "cast(id as string) id", "repeat('word ', 50) bullet", "if(id = 2, 900, 50) n")
    got = {r["path"]: r["entry"] for r in _fitting(rows, ["repo_name", "parent"], 300).collect()}
    kept = [p for p, e in got.items() if "<omitted>" not in e]
    assert len(got) == n and sorted(kept) == [f"d/f{i:05}" for i in (0, 1, 3, 4, 5, 6)]
