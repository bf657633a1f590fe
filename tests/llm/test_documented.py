import pytest

pytest.importorskip("quern.llm")
from quern.llm.documented import documented_functions, is_substantive

CHUNKS = "seq bigint, repo_name string, repo_path string, chunk_type string, start_line int, end_line int, content string, lang string, i int, doc string, n int"
DOC = "Keeps the newest entries of the cache after a restart."
SOURCES = {
    "a.py": f'def keep(x):\n    """{DOC}"""\n    if x:\n        return 1\n    return 2\n\n@cached\ndef plain(y):\n    return y\n\n# {DOC}\n@cached\nasync def front(\n    y, z=(1, 2),\n):\n    # inside\n    return y\n\nclass A:\n    """Holds things of the cache that are read."""\n    def inner(self):\n        r\'\'\'{DOC}\'\'\'\n        s = "def no(): # x"\n',
    "a.js": f"// {DOC}\nexport function keep(a, {{b, c}}) {{\n  const r = s.replace(/[)}}]+/g, '');\n  return r;\n}}\n\n/**\n * {DOC}\n * @param x thing\n */\nconst arrow = async (x) => {{\n  if (x) {{ return `}}`; }}\n}};\n\nclass A {{\n  /* {DOC} */\n  method(a) {{\n    items.forEach(function (i) {{ use(i); }});\n  }}\n\n  // {DOC}\n\n  far(a) {{\n  }}\n}}\n",
    "a.ts": f"/** {DOC} */\nprivate async load(a: string[], b?: number): Promise<Map<string, number>> {{\n}}\n",
    "A.java": f"public class A {{\n    /** {DOC} */\n    @Override\n    public List<String> keep(Map<String, Integer> a) throws IOException {{\n        char c = '{{';\n        return null;\n    }}\n}}\n",
    "a.go": f"// Keep — {DOC}\n// More.\nfunc (c *Cache) Keep(a []string, b interface{{}}) (int, error) {{\n\tx := `}}`\n\treturn 1, nil\n}}\n",
    "a.rs": f"/// {DOC}\n#[must_use]\npub fn keep<'a>(x: &'a [u64]) -> Option<u64> {{\n    let c = '{{';\n    let r = r#\"raw \" }}\"#;\n    Some(1)\n}}\n",
    "a.c": f"/* {DOC} */\nstatic int keep(struct node *x, int n) {{\n    while (n) {{ n--; }}\n    return n;\n}}\n",
    "a.cpp": f'/// {DOC}\nstd::vector<int> Cache::keep(const std::string& a) const {{\n    auto r = R"(raw }} text)";\n    return {{}};\n}}\n',
}
EXPECTED = {
    ("a.py", "keep"), ("a.py", "front"), ("a.py", "inner"), ("a.js", "keep"), ("a.js", "arrow"), ("a.js", "method"), ("a.ts", "load"), ("A.java", "keep"), ("a.go", "Keep"), ("a.rs", "keep"), ("a.c", "keep"), ("a.cpp", "keep"),
}


def test_languages(spark):
    rows = [(i, "r", p, "module", 1, None, t, "clash", 0, "x", 0) for i, (p, t) in enumerate(SOURCES.items())]
    rows += rows[:1] + [(99, "r", "a.txt", "module", 1, 1, SOURCES["a.py"], None, 0, "", 0), (98, "r", None, "module", 1, 1, "x", None, 0, "", 0), (97, "r", "b.py", "function", None, None, None, None, 0, "", 0), (96, "r", "b.py", "prose", 1, 1, SOURCES["a.py"], None, 0, "", 0), (95, None, "c.py", "function", None, None, "", None, 0, "", 0)]
    df = spark.createDataFrame(rows, CHUNKS)
    got = documented_functions(df).collect()
    assert {(r["repo_path"], r["function_name"]) for r in got} == EXPECTED and len(got) == len(EXPECTED)
    code = {(r["repo_path"], r["function_name"]): r["code"] for r in got}
    assert code["a.py", "keep"] == f'def keep(x):\n    """{DOC}"""\n    if x:\n        return 1\n    return 2'
    for p, end in (("a.js", "}"), ("a.go", "}"), ("a.rs", "}"), ("a.c", "}"), ("a.cpp", "}"), ("A.java", "}")):
        for (q, n), c in code.items():
            if q == p:
                assert c.rstrip().endswith(end) and c.count("\n") >= 2, (p, n, c)
    assert "return null" in code["A.java", "keep"] and code["a.js", "keep"].endswith("return r;\n}")
    assert documented_functions(df.limit(0)).count() == 0


def test_comment_in_the_chunk_before(spark):
    rows = [
        (1, "r", "a.go", "module", 1, 8, f"package a\n\n// Keep {DOC}", None, 0, "", 0), (2, "r", "a.go", "function", 9, 10, "func Keep() {\n}", None, 0, "", 0),
        (3, "r", "b.go", "module", 1, 3, f"package a\n\n// Keep {DOC}", None, 0, "", 0), (4, "r", "b.go", "function", 9, 10, "func Keep() {\n}", None, 0, "", 0),
        (5, "r", "c.go", "module", 1, None, f"package a\n\n// Keep {DOC}", None, 0, "", 0), (6, "r", "c.go", "function", 4, 5, "func Keep() {\n}", None, 0, "", 0),
        (7, "q", "c.go", "function", 4, 5, "func Keep() {\n}", None, 0, "", 0),
    ]
    assert {r["seq"] for r in documented_functions(spark.createDataFrame(rows, CHUNKS)).collect()} == {2, 6}


@pytest.mark.parametrize(
    "doc, name, good",
    [
        ("/** */", "f", False), ("// TODO: document", "f", False), ("// TODO aside, this will keep the entries whenever the cache is read", "f", True), ("/** The splitCounter method. */", "splitCounter", False), ("// Splits counter.", "split_counter", False),
        ("/**\n * @param x the thing\n * @return it\n */", "f", False), ('"""Args:\n    x (int):\n"""', "f", False), ('"""Parameters\n----------\nx : int\n"""', "f", False), ("// eslint-disable-next-line", "f", False), ("// NOLINT", "f", False), ("// =====", "f", False), ("// return old(item, 3);", "f", False),
        ("# SPDX-License-Identifier: MIT", "f", False), ("/** {@inheritDoc} */", "f", False), ("// Auto-generated method stub", "f", False), ("/** 只有在服务完全写入之后，新的游标才会被加载。 */", "f", True), ("/// Guards the cache against writes", "f", True), (f'"{DOC}"', "keep", True), (None, "f", False), ("/** @brief Keeps the newest entries. */", "f", True),
    ],
)
def test_substance(doc, name, good):
    assert is_substantive(doc, name) is good


def test_only_delimited_functions(spark):
    """A header whose body is missing or never closes is no function; docstrings behind a comment, nested comments."""
    texts = {
        "open.go": f"// {DOC}\nfunc Keep() {{\n\tx := 1\n", "part.js": f"// {DOC}\nfunction keep() {{\n  if (x) {{\n}}\n", "end.py": f"# {DOC}\ndef keep(x):\n",
        "note.py": f'def keep(x):\n    # a remark\n    """{DOC}"""\n    return x\n', "nested.rs": f"/* {DOC} /* of old */ and new */\nfn keep() {{\n}}\n", "one.py": f"# {DOC}\ndef keep(x): return 1\ndef other(x):\n    return 2\n",
    }
    df = spark.createDataFrame([(i, "r", p, "function", 1, 4, t, None, 0, "", 0) for i, (p, t) in enumerate(texts.items())], CHUNKS)
    for code in (True, False):
        got = {r["repo_path"]: r for r in documented_functions(df, with_code=code).collect()}
        assert set(got) == {"note.py", "nested.rs", "one.py"}
    assert documented_functions(df).where("repo_path = 'one.py'").first()["code"] == "def keep(x): return 1"


def test_depth_and_code_agree_with_ast(spark):
    import ast
    import random

    r = random.Random(3)
    lines, spans = [], {}

    def block(depth, name):
        pad = "    " * depth
        first = len(lines)
        lines.append(f"{pad}def {name}(a, b=(1, 2)):")
        lines.append(f'{pad}    """{DOC}"""')
        for k in range(r.randint(1, 3)):
            lines.append(f"{pad}    x = {{'a': [{k}]}}")
            if depth < 3 and r.random() < 0.6:
                block(depth + 1, f"{name}_{k}")
        lines.append(f"{pad}    return x")
        spans[name] = (first, depth)

    for i in range(4):
        block(0, f"f{i}")
    text = "\n".join(lines)
    got = {x["function_name"]: (x["code"], x["depth"]) for x in documented_functions(spark.createDataFrame([(1, "r", "a.py", "module", 1, 2, text, None, 0, "", 0)], CHUNKS)).collect()}
    nodes = {n.name: n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef)}
    assert set(got) == set(nodes) == set(spans)
    for name, n in nodes.items():
        assert got[name] == (ast.get_source_segment(text, n), spans[name][1])


def test_long_chunk(spark):
    text = f"// {DOC}\nfunc Keep() {{\n" + "\tx += 1 // one\n" * 30_000 + "}\n"
    got = documented_functions(spark.createDataFrame([(1, "r", "a.go", "function", 1, 2, text, None, 0, "", 0)], CHUNKS)).collect()
    assert len(got) == 1 and got[0]["code"].count("\n") == 30_001
