"""Import extraction, resolution and the import graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.languages import code_language
from ..functions.text import parent_dir

# What is no code: comments and long strings; short strings are kept (group 1), as they may be targets.
# Repeated groups are unrolled and possessive, so long texts need no deep stack.
_SHORT = r"""("[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""
_NO_CODE = {
    "python": r'''"{3}[\s\S]*?"{3}|'{3}[\s\S]*?'{3}|#[^\n]*|''' + _SHORT,
    "javascript": r"/\*[\s\S]*?\*/|//[^\n]*|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|" + _SHORT,
    "c": r"/\*[\s\S]*?\*/|//[^\n]*|" + _SHORT,
    "go": r"/\*[\s\S]*?\*/|//[^\n]*|`[^`]*`|" + _SHORT,
    "rust": r'''/\*[\s\S]*?\*/|//[^\n]*|("[^"\\]*+(?:\\[\s\S][^"\\]*+)*+")''',
}
# A Go file's imports: one of a line, or the literals of a block.
_GO_IMPORTS = r'(?m)^import[ \t]*(?:\([^)]*\)|(?:[\w.]+[ \t]+)?"[^"\n]+")'
# Per language: a root-level import statement and the group that holds its target; a statement may take several lines.
IMPORT_LINES = {
    "python": r"^(?:from[ \t]+(\.*[\w.]*)[ \t]+import\b|import[ \t]+([\w.]+)(?=[ \t]*(?:,|;|#|$)))",
    "javascript": r"""^import\b[^'";()]*['"]([^'"]+)['"]""",
    "typescript": r"""^import\b[^'";()]*['"]([^'"]+)['"]""",
    "java": r"^import[ \t]+(?:static[ \t]+)?([\w.]+?)(?:\.\*)?[ \t]*;",
    "c": r'^#[ \t]*include[ \t]*[<"]([^>"]+)[>"]',
    "cpp": r'^#[ \t]*include[ \t]*[<"]([^>"]+)[>"]',
    "rust": r"^use[ \t]+([^;]+);",
    # an import of a Go block holds its literal below the spec: found only where go_blocks is set
    "go": r'^(?:import[ \t]+)?[ \t]*(?:[\w.]+[ \t]+)?"([^"]+)"',
}


def import_target(line: Column, language: Column) -> Column:
    """The module string of an import line, null for other lines."""
    out = F.when(F.lit(False), F.lit(""))
    for lang, pattern in IMPORT_LINES.items():
        groups = 2 if lang == "python" else 1
        found = F.coalesce(*[F.nullif(F.regexp_extract(line, pattern, g), F.lit("")) for g in range(1, groups + 1)])
        out = out.when(language == lang, found)
    return out


def extract_imports(files: DataFrame, go_blocks: bool = False) -> DataFrame:
    """(repo_name, src, ord, raw): import targets of each file's statements in order, from 0. Go has none unless go_blocks is set.

    Comments, long strings and templates are taken out first, so an import inside them is none; a statement may take
    several lines. A null content has no imports.
    """
    lang = code_language(F.col("repo_path"))
    text, kept = F.regexp_replace("raw_content", r"\r\n?", "\n"), files.where("raw_content is not null").withColumn("lang", lang)
    kept = kept.where("lang is not null" if go_blocks else "lang is not null and lang <> 'go'")
    found = F.when(F.lit(False), F.array(F.lit("")))
    for name, pattern in IMPORT_LINES.items():
        code = F.regexp_replace(text, _NO_CODE.get(name, _NO_CODE["javascript" if name == "typescript" else "c"]), "$1")
        if name == "python":
            code = F.regexp_replace(code, r"\\\n", " ")
            first, second = (F.regexp_extract_all(code, F.lit(f"(?m){pattern}"), F.lit(g)) for g in (1, 2))
            targets = F.zip_with(first, second, lambda x, y: F.when(x != "", x).otherwise(y))
        elif name == "go":
            blocks = F.regexp_extract_all(code, F.lit(_GO_IMPORTS), F.lit(0))
            targets = F.flatten(F.transform(blocks, lambda x: F.regexp_extract_all(x, F.lit(r'"([^"\n]+)"'), F.lit(1))))
        else:
            targets = F.transform(F.regexp_extract_all(code, F.lit(f"(?m){pattern}"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " "))
        found = found.when(F.col("lang") == name, targets)
    return kept.select("repo_name", F.col("repo_path").alias("src"), F.posexplode(found).alias("ord", "raw"))


def fold_path(path: Column) -> Column:
    """Folds '.' and '..' parts; '..' at the top is dropped."""
    step = lambda a, p: F.when((p == ".") | (p == ""), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _ancestor(folder: Column, ups: Column) -> Column:
    """The folder `ups` levels above, '.' at the top."""
    parts = F.split(folder, "/")
    return F.when(ups >= F.size(parts), F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - ups, F.lit(1))), "/"))


def candidates(raw: Column, src: Column, language: Column) -> Column:
    """Paths that an import may mean, in order of preference."""
    folder = parent_dir(src)
    at = lambda base, ends: F.array(*[F.concat(base, F.lit(e)) for e in ends])
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(raw, r"^\.+", ""), F.lit("."), F.lit("/"))
    base = _ancestor(folder, dots - 1)
    relative = F.when(module == "", at(base, ["/__init__.py"])).otherwise(at(F.concat(base, F.lit("/"), module), [".py", "/__init__.py"]))
    slashed = F.replace(raw, F.lit("."), F.lit("/"))
    absolute = F.concat(at(slashed, [".py", "/__init__.py"]), at(F.concat(F.lit("src/"), slashed), [".py", "/__init__.py"]))
    joined = fold_path(F.concat(folder, F.lit("/"), raw))
    js = F.when(raw.startswith("."), at(joined, [".js", ".ts", ".tsx", ".jsx", "/index.js", "/index.ts", ""]))
    java = F.array(F.concat(slashed, F.lit(".java")), F.concat(F.lit("src/main/java/"), slashed, F.lit(".java")))
    c = F.array(F.concat(folder, F.lit("/"), raw), raw, F.concat(F.lit("src/"), raw), F.concat(F.lit("include/"), raw))
    go = F.when(F.contains(raw, F.lit("/")), F.array(F.concat(raw, F.lit(".go"))))
    found = (
        F.when(language == "python", F.when(raw.startswith("."), relative).otherwise(absolute))
        .when(language.isin("javascript", "typescript"), js)
        .when(language == "java", java)
        .when(language.isin("c", "cpp"), c)
        .when(language == "go", go)
    )
    clean = F.transform(found, lambda p: F.regexp_replace(p, r"^(?:\./)+", ""))
    return F.coalesce(clean, F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges (repo_name, src, ord, dst): the first candidate that is a path of the same repository.

    imports: (repo_name, src, ord, raw target); paths: (repo_name, repo_path). Repeated import lines give repeated
    edges, self-edges are possible; repeated rows of one (src, ord) count once.
    """
    wanted = imports.dropDuplicates(["repo_name", "src", "ord"]).select(
        "repo_name", "src", "ord", F.posexplode(candidates(F.col("raw"), F.col("src"), code_language(F.col("src")))).alias("pos", "dst")
    )
    known = paths.select("repo_name", F.col("repo_path").alias("dst")).distinct()
    return wanted.join(known, ["repo_name", "dst"]).groupBy("repo_name", "src", "ord").agg(F.min_by("dst", "pos").alias("dst"))


def importers(edges: DataFrame) -> DataFrame:
    """(repo_name, path, n_imports, n_importers) of every node of the graph."""
    out = edges.groupBy("repo_name", F.col("src").alias("path")).agg(F.countDistinct("dst").alias("n_imports"))
    back = edges.groupBy("repo_name", F.col("dst").alias("path")).agg(F.countDistinct("src").alias("n_importers"))
    both = out.join(back, ["repo_name", "path"], "full_outer")
    return both.select("repo_name", "path", F.coalesce("n_imports", F.lit(0)).alias("n_imports"), F.coalesce("n_importers", F.lit(0)).alias("n_importers"))


def neighbors(edges: DataFrame) -> DataFrame:
    """(repo_name, path, neighbor): files that a file imports or that import it, without itself."""
    there = edges.select("repo_name", F.col("src").alias("path"), F.col("dst").alias("neighbor"))
    back = edges.select("repo_name", F.col("dst").alias("path"), F.col("src").alias("neighbor"))
    return there.unionByName(back).where("path <> neighbor").distinct()


def graph_summary(edges: DataFrame) -> DataFrame:
    """Per repository: files with edges, nodes, edges, edges per file with edges."""
    nodes = edges.select("repo_name", F.col("src").alias("n")).unionByName(edges.select("repo_name", F.col("dst").alias("n"))).groupBy("repo_name").agg(F.countDistinct("n").alias("n_nodes"))
    sums = edges.groupBy("repo_name").agg(F.countDistinct("src").alias("n_sources"), F.count("*").alias("n_edges"))
    return sums.join(nodes, "repo_name").select("*", (F.col("n_edges") / F.greatest("n_sources", F.lit(1))).alias("avg_edges"))


def graph_neighbor_ranks(hits: DataFrame, edges: DataFrame, weight: float = 0.5) -> DataFrame:
    """A further ranked list for fusion: neighbours of the hit files, ranked by their best hit.

    hits: (question_id, rank, repo_name, path). Optional; the default retrieval has no such list.
    """
    near = hits.join(neighbors(edges), ["repo_name", "path"]).groupBy("question_id", "repo_name", F.col("neighbor").alias("path")).agg(F.min("rank").alias("best"))
    w = W.partitionBy("question_id").orderBy("best", "repo_name", "path")
    return near.select("question_id", "repo_name", "path", F.row_number().over(w).alias("rank"), F.lit(weight).alias("weight"))


def raw_targets(raw_imports: DataFrame) -> DataFrame:
    """(repo_name, src, ord, raw): targets of stored import lines; lines without a target are left out."""
    lang = code_language(F.col("src"))
    required = F.regexp_extract(F.col("raw"), r"""require\(['"]([^'"]+)['"]\)""", 1)
    target = F.coalesce(import_target(F.col("raw"), lang), F.when(lang.isin("javascript", "typescript"), F.nullif(required, F.lit(""))))
    return raw_imports.select("repo_name", "src", "ord", target.alias("raw")).where("raw is not null").distinct()


