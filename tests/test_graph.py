from pyspark.sql import functions as F

from quern.operators.imports import extract_imports, graph_neighbor_ranks, graph_summary, importers, neighbors, raw_targets, resolve_imports

FILES = "repo_name string, repo_path string, raw_content string"


def edges_of(spark, files):
    df = spark.createDataFrame([("r", p, t) for p, t in files], FILES)
    found = resolve_imports(extract_imports(df, go_blocks=True), df.select("repo_name", "repo_path"))
    return {(r["src"], r["dst"]) for r in found.collect()}


def test_absolute_python(spark):
    files = [("main.py", "import utils\nfrom models import X\n"), ("utils.py", ""), ("models.py", "")]
    assert edges_of(spark, files) == {("main.py", "utils.py"), ("main.py", "models.py")}


def test_relative_python(spark):
    files = [("src/app.py", "from .helpers import f\nfrom ..top import g\nfrom . import z\n"), ("src/helpers.py", ""), ("top.py", ""), ("src/__init__.py", "")]
    assert edges_of(spark, files) == {("src/app.py", "src/helpers.py"), ("src/app.py", "top.py"), ("src/app.py", "src/__init__.py")}


def test_external_and_aliased(spark):
    assert edges_of(spark, [("a.py", "import os\nimport flask\nfrom pathlib import Path\nimport b as c\n"), ("b.py", "")]) == set()


def test_javascript(spark):
    files = [("src/index.js", "import App from './App';\nimport h from '../utils/helper';\nimport React from 'react';\n"), ("src/App.js", ""), ("utils/helper.js", "")]
    assert edges_of(spark, files) == {("src/index.js", "src/App.js"), ("src/index.js", "utils/helper.js")}


def test_java_c_go_rust(spark):
    files = [
        ("A.java", "import com.foo.Bar;\n"), ("src/main/java/com/foo/Bar.java", ""),
        ("src/m.c", '#include "u.h"\n#include <stdio.h>\n'), ("src/u.h", ""),
        ("x.go", 'package x\n\nimport (\n\t"pkg/y"\n)\n'), ("pkg/y.go", "package y\n"),
        ("l.rs", "use crate::a::B;\n"),
    ]
    assert edges_of(spark, files) == {("A.java", "src/main/java/com/foo/Bar.java"), ("src/m.c", "src/u.h"), ("x.go", "pkg/y.go")}
    go = spark.createDataFrame([("r", "x.go", 'import "pkg/y"\n')], FILES)
    assert extract_imports(go).count() == 0 and extract_imports(go, go_blocks=True).count() == 1


def test_nested_imports_are_not_seen(spark):
    assert edges_of(spark, [("a.py", "try:\n    import b\nexcept ImportError:\n    pass\n"), ("b.py", "")]) == set()


def test_graph_queries(spark):
    e = spark.createDataFrame([("r", "a", 0, "b"), ("r", "a", 1, "c"), ("r", "b", 0, "c"), ("r", "c", 0, "c")], "repo_name string, src string, ord int, dst string")
    s = graph_summary(e).first()
    assert (s["n_sources"], s["n_edges"], s["n_nodes"]) == (3, 4, 3) and abs(s["avg_edges"] - 4 / 3) < 1e-9
    assert {(r["path"], r["neighbor"]) for r in neighbors(e).collect()} == {("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")}
    assert {(r["path"], r["n_imports"], r["n_importers"]) for r in importers(e).collect()} == {("a", 2, 0), ("b", 1, 1), ("c", 1, 3)}
    hits = spark.createDataFrame([(1, 1, "r", "a")], "question_id int, rank int, repo_name string, path string")
    assert [r["path"] for r in graph_neighbor_ranks(hits, e).orderBy("rank").collect()] == ["b", "c"]


def test_stored_lines(spark):
    rows = [("r", "a.js", 0, "const x = require('./b');"), ("r", "a.js", 0, "const x = require('./b');"), ("r", "a.py", 0, "nothing here"), ("r", "a.py", 1, None)]
    got = raw_targets(spark.createDataFrame(rows, "repo_name string, src string, ord int, raw string")).collect()
    assert [(r["src"], r["raw"]) for r in got] == [("a.js", "./b")]


def test_imports_of_statements(spark):
    """Over several lines, but not inside comments, long strings and templates; any number of levels up."""
    from quern.operators.imports import candidates, extract_imports

    texts = {
        "a.py": '"""Doc.\nimport fake\n"""\nimport os, sys\nfrom . import (\n    b,\n)\nfrom .c \\\n    import d\n# import no\nx = \'import no\'\n',
        "a.js": "import {\n  b\n} from './d'\n/*\nimport x from 'no'\n*/\nimport './e'\nconst t = `\nimport y from 'no'\n`\n// import z from 'no'\nimport('no')\n",
        "a.rs": "use a::{\n    b,\n    c::d,\n};\nuse e;\n// use no;\n", "a.go": 'package a\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\nimport "os"\n\nvar s = []string{\n\t"no",\n}\n',
        "A.java": "import a.b.C;\n/* import no.No; */\nimport static d.E.*;\n", "a.c": '#include <x.h>\n#include "y/z.h"\n// #include "no.h"\n', "n.py": None,
    }
    df = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo_name string, repo_path string, raw_content string")
    got = {}
    for r in sorted(extract_imports(df, go_blocks=True).collect(), key=lambda r: (r["src"], r["ord"])):
        got.setdefault(r["src"], []).append(r["raw"])
    assert got == {"a.py": ["os", ".", ".c"], "a.js": ["./d", "./e"], "a.rs": ["a::{ b, c::d, }", "e"], "a.go": ["fmt", "a/b", "os"], "A.java": ["a.b.C", "d.E"], "a.c": ["x.h", "y/z.h"]}
    deep = spark.range(1).select(candidates(F.lit("." * 12 + "m"), F.lit("/".join(f"d{i}" for i in range(12)) + "/x.py"), F.lit("python")).alias("c")).first()["c"]
    assert deep == ["d0/m.py", "d0/m/__init__.py"]
