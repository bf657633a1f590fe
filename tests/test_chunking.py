import random

from pyspark.sql import functions as F

from quern.functions.languages import file_type, is_skipped
from quern.functions.text import short_hash, split_lines, suffix, token_count
from quern.operators.chunking import chunk_files, chunk_text, count_tokens, lines_of, sections, uncovered_islands, window

FILES = "repo_name string, repo_path string, raw_content string"


def test_file_types(spark):
    paths = ["src/main.py", "Dockerfile", "Dockerfile.prod", "binary.bin", "a/Makefile", "x.PY", ".env", "prod.env", "noext"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", file_type(F.col("p")).alias("t"))
    got = {r["p"]: r["t"] for r in rows.collect()}
    assert got == {"src/main.py": "python", "Dockerfile": "dockerfile", "Dockerfile.prod": "dockerfile", "binary.bin": "unknown", "a/Makefile": "text", "x.PY": "python", ".env": "unknown", "prod.env": "text", "noext": "unknown"}


def test_skipped_folders(spark):
    paths = {"src/main.py": False, "node_modules/lodash.js": True, "a/.git/x": True, ".env": False, "README.md": False, "a/build/x.c": True, "builds/x.c": False}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_skipped(F.col("p")).alias("s"))
    assert {r["p"]: r["s"] for r in rows.collect()} == paths


def test_text_functions(spark):
    r = spark.createDataFrame([("a\r\nb\nc\n", "x.tar.gz")], "t string, p string").select(
        split_lines(F.col("t")).alias("l"), suffix(F.col("p")).alias("s"), short_hash(F.lit("a.py"), F.lit(1)).alias("h"), token_count(F.lit("a_b + \U0001f600 é")).alias("n")
    ).first()
    assert (r["l"], r["s"], r["h"], r["n"]) == (["a", "b", "c"], ".gz", "39bc19215926032f", 4)


def test_window_tail_and_long_line():
    assert [(a, b) for _, a, b in window(["x"] * 20, 1, 512, 64)] == [(1, 20), (15, 20)]
    parts = list(window(["a " * 30, "b"], 1, 10, 0))
    assert parts[0][1:] == (1, 1) and parts[1][1:] == (2, 2)


def test_window_covers_all_lines_within_budget():
    rng = random.Random(5)
    for _ in range(30):
        lines = ["w " * rng.randint(0, 9) + "." for _ in range(rng.randint(1, 60))]
        seen = set()
        for text, a, b in window(lines, 1, 40, 64):
            seen.update(range(a, b + 1))
            assert count_tokens(text) <= 40 or a == b
        assert seen == set(range(1, len(lines) + 1))


def test_structured_files():
    assert len(chunk_text("markdown", "# Section 1\ntext\n## Subsection\ntext\n# Section 2\n")) >= 3
    assert all(c[1] == "prose" for c in chunk_text("markdown", "# A\nb"))
    assert [c[1] for c in chunk_text("json", '{"name": "my-app", "version": "1.0.0"}')] == ["config"]
    big = '{"a": "%s", "b": "%s", "c": "%s"}' % tuple(["x " * 40] * 3)
    parts = chunk_text("json", big, max_tokens=60)
    assert len(parts) == 3 and {p[2] for p in parts} == {1}
    assert [c[1] for c in chunk_text("json", "[1, 2]")] == ["prose"]
    assert [c[1] for c in chunk_text("json", "{broken")] == ["prose"]
    assert {c[1] for c in chunk_text("dockerfile", "FROM x\nRUN y\n")} == {"config"}
    assert [c[1] for c in chunk_text("toml", "a = 1\n[b]\nc = 2\n")] == ["config"]


def test_python_chunks():
    source = "import os\n\nCONSTANT = 42\n\ndef add(a, b):\n    return a + b\n\n@cached\ndef twice(x):\n    return 2 * x\n\nclass Calculator:\n    pass\n"
    got = [(c[1], c[2], c[3], c[4]) for c in chunk_text("python", source, 200)]
    assert ("function", 5, 6, "add") in got and ("module", 8, 10, None) in got and ("class", 12, 13, "Calculator") in got
    assert got[0][0] == "module" and got[0][1] == 1
    assert {c[1] for c in chunk_text("python", "def broken(:\n", 50)} == {"prose"}


def test_chunk_files(spark):
    rows = [("r", "foo.py", "x = 1\n"), ("r", "data.rb", "line one two three\n" * 20), ("r", "none.py", None), (None, "empty.md", "")]
    a = chunk_files(spark.createDataFrame(rows, FILES), 50).orderBy("repo_path", "chunk_ord").collect()
    b = chunk_files(spark.createDataFrame(rows, FILES), 50).orderBy("repo_path", "chunk_ord").collect()
    assert a == b and all(r["token_count"] <= 50 for r in a) and {r["repo_path"] for r in a} == {"foo.py", "data.rb"}
    assert chunk_files(spark.createDataFrame([], FILES)).count() == 0


def test_lines_of_matches_sql(spark):
    texts = ["", "a", "a\n", "\n", "a\r\n\r\nb", "a\x0bb c\x85d", "x\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines(F.col("t")).alias("l")).collect()
    assert {r["t"]: r["l"] for r in rows} == {t: lines_of(t) for t in texts}


def test_sections_and_islands(spark):
    files = spark.createDataFrame([("r", "a.md", "# A\nx\n# B\n"), ("r", "b.md", "intro\n# C")], FILES)
    got = {(r["repo_path"], r["section"], r["start_line"], r["end_line"]) for r in sections(files).collect()}
    assert got == {("a.md", 0, 1, 2), ("a.md", 1, 3, 3), ("b.md", 0, 1, 1), ("b.md", 1, 2, 2)}
    lines = spark.createDataFrame([("r", "f", "\n".join("abcdefghij"))], FILES)
    chunks = spark.createDataFrame([("r", "f", 4, 6), ("r", "f", 9, 9), ("r", "f", None, None)], "repo_name string, repo_path string, start_line int, end_line int")
    assert {(r[2], r[3]) for r in uncovered_islands(lines, chunks).collect()} == {(1, 3), (7, 8), (10, 10)}
