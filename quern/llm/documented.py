"""Problem 3: functions paired with their documentation."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.languages import code_language

_BLOCK = r"/\*[\s\S]*?(?:\*/|\z)"
# Rust's block comments nest; the pattern follows them three deep.
_NESTED = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/"
for _ in range(2):
    _NESTED = rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|{_NESTED})*+(?:\*/|\z)"
_LINE = r"//[^\n]*"
_STRING = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
_CHAR = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
_NOT = r"(?!(?:if|else|for|while|switch|catch|return|new|do|try|throw|case|function|with|await|yield|typeof|super|sizeof|delete|void 0|match|loop|in|of|instanceof|package|import|using|namespace|struct|class|enum|union|interface)\b)"
_PARAMS = r"[^(){};]*+(?:\([^(){};]*+\)[^(){};]*+)*+"
# JavaScript parameters may hold patterns and defaults in braces.
_JS_PARAMS = r"[^(){}]*+(?:(?:\([^(){}]*+\)|\{[^{}]*+\})[^(){}]*+)*+"
_PY_PARAMS = r"[^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+"
_JS_RETURN = r"(?::\s*[^{};=\n]+?(?:\{[^{}]*\}[^{};=\n]*)?)?\s*"

# Per language: function headers, up to the brace that opens the body; the last group that matches is the name.
HEADERS: dict[str, tuple[str, ...]] = {
    "python": (rf"(?:async[ \t]+)?def[ \t]+(?<name>\w+)[ \t]*(?:\[[^\]]*\])?\({_PY_PARAMS}\)\s*(?:->[^:\n]+)?:",),
    "go": (r"func[ \t]*(?:\([^)\n]*\)[ \t]*)?(?<name>[A-Za-z_]\w*)[ \t]*(?:\[[^\]\n]*\])?\([^{};]*?(?:(?:interface|struct)\s*\{\s*\}[^{};]*?)*\{",),
    "rust": (r'(?:pub(?:\([^)\n]*\))?\s+)?(?:(?:default|const|async|unsafe)\s+|extern\s+(?:"[^"]*"\s+)?)*fn\s+(?<name>\w+)[^{};]*?(?:\[[^\]]*\][^{};]*?)*\{',),
    "java": (rf"{_NOT}(?:<[^<>(){{}};]*>\s+)?[\w.$][\w.$<>\[\],? \t]*?\s+{_NOT}(?<name>[A-Za-z_$][\w$]*)\s*\({_PARAMS}\)\s*(?:throws\s+[\w.,\s]+?)?\s*\{{",),
    "c": (rf"{_NOT}[A-Za-z_][\w:<>,*& \t\[\]]*?[\s*&]+{_NOT}(?:\w+::)*(?<name>~?[A-Za-z_]\w*)\s*\({_PARAMS}\)\s*\{{",),
    "cpp": (
        rf"{_NOT}(?:template\s*<[^{{}};]*?>\s*)?[A-Za-z_][\w:<>,*& \t\[\]]*?[\s*&]+{_NOT}(?:\w+::)*(?<name>~?[A-Za-z_]\w*)\s*\({_PARAMS}\)\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>*& ]+)?\s*(?::[^{{}};]+)?\{{",
    ),
    "javascript": (
        rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>{{}}]*>)?\s*\({_JS_PARAMS}\)\s*{_JS_RETURN}\{{",
        rf"(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+(?<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b[^({{]*\({_JS_PARAMS}\)\s*{_JS_RETURN}\{{|(?:(?:<[^<>]*>\s*)?\({_JS_PARAMS}\)\s*{_JS_RETURN}|[A-Za-z_$][\w$]*\s*)=>\s*\{{?)",
        rf"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?{_NOT}(?<name>[A-Za-z_$#][\w$]*)\s*(?:<[^<>{{}}()]*>)?\({_JS_PARAMS}\)\s*{_JS_RETURN}\{{",
    ),
}
HEADERS["typescript"] = HEADERS["javascript"]
_STRINGS = {
    "python": r"""[rRuUbBfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z)|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?)""",
    "go": rf"{_STRING}|`[^`]*`?|{_CHAR}",
    "rust": rf"""r(#*)"[\s\S]*?"\1|b?{_STRING}|'(?:\\[^'\n]*|[^'\\\n])'""",
    "java": rf'"""[\s\S]*?"""|{_STRING}|{_CHAR}',
    "c": rf"{_STRING}|{_CHAR}",
    "cpp": rf'R"(\w*)\([\s\S]*?\)\1"|{_STRING}|{_CHAR}',
    "javascript": rf"{_STRING}|{_CHAR}|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?|(?<=[(,=:\[!&|?;]\s{{0,3}})/(?![*/])[^/\\\n\[]*+(?:(?:\\.|\[[^\]\n]*\])[^/\\\n\[]*+)*+/[a-z]*",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_ANNOTATION = {
    "python": r"@[\w.]+[^\n]*",
    "rust": r"#!?\[[^\]\n]*\]",
    "java": r"@[\w.]+(?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\))?",
    "typescript": r"@[\w.]+(?:\([^()\n]*\))?",
    "javascript": r"@[\w.]+(?:\([^()\n]*\))?",
    "c": r"__attribute__\s*\(\([^)]*\)\)",
    "cpp": r"\[\[[^\]\n]*\]\]|__attribute__\s*\(\([^)]*\)\)",
    "go": r"//go:\w+[^\n]*+",
}


def _lexer(lang: str) -> str:
    """Coarse lexemes with the white space before them; together they are the whole text. Line comments that follow each
    other on lines of their own are one lexeme. Repeated groups are possessive: they match without recursion."""
    header = "|".join(h.replace("(?<name>", "(?:") for h in HEADERS[lang])
    mark = "#" if lang == "python" else "//"
    run = rf"(?:\A[ \t]*+|\s*\n[ \t]*+){mark}[^\n]*+(?:\r?\n[ \t]*+{mark}[^\n]*+)*+"
    comment = r"#[^\n]*+" if lang == "python" else f"{_NESTED if lang == 'rust' else _BLOCK}|{_LINE}"
    rest = r"[^\s\"'#@\[][^\n\"'#]*+" if lang == "python" else r"[^\s\"'`/@#{}\[][^\n\"'`/{}]*+"
    return rf"{run}|\s*+(?:{comment}|{_ANNOTATION[lang]}|{_STRINGS[lang]}|{header}|[{{}}]|{rest}|\S)|\s+"


def lexemes(content: Column, lang: Column) -> Column:
    """The coarse lexemes of a text, by language; each language's pattern is a constant and is compiled once."""
    return reduce(lambda c, name: c.when(lang == name, F.regexp_extract_all(content, F.lit(_lexer(name)), F.lit(0))), HEADERS, F.when(F.lit(False), F.array(F.lit(""))))


# Where the name stands in a header that ends with its brace.
_ID = r"[A-Za-z_$][\w$]*"
_NAMED = {
    "go": r"func[ \t]*(?:\([^)\n]*\)[ \t]*)?(\w+)",
    "rust": r"\bfn\s+(\w+)",
    "java": rf"({_ID})\s*\(",
    "c": r"(~?[A-Za-z_]\w*)\s*\(",
    "cpp": r"(~?[A-Za-z_]\w*)\s*\(",
    # behind "function" or a declaration's word, else in front of the first parenthesis
    "javascript": rf"^(?:(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*|(?:const|let|var)\s+)|[^(]*?(?=#?{_ID}\s*(?:<[^<>{{}}()]*>)?\())(#?{_ID})",
}
_NAMED["typescript"] = _NAMED["javascript"]


# Python's headers end with a colon, arrows with theirs: for those the whole header is the pattern.
_NAMED["python"] = rf"^(?:{HEADERS['python'][0]})$"
_ARROW = rf"^(?:{HEADERS['javascript'][1]})$"


def _by_language(values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))


# Documentation that says nothing.
PLACEHOLDERS = (
    "summary", "description", "no description", "docstring", "documentation", "documentation goes here", "add description here", "add documentation here",
    "undocumented", "self explanatory", "see name", "see above", "see below", "as above", "auto generated method stub", "autogenerated method stub", "method stub", "stub",
    "stub to be documented later", "to be documented", "to be documented later", "document me", "write me", "fill me in", "fill in", "placeholder", "tbd", "tba", "wip",
    "docs missing", "missing docs", "no docs", "no documentation", "not documented", "coming soon", "n a", "na", "none", "nothing", "lorem ipsum", "todo", "fixme", "xxx",
    "insert description here", "description here", "your description here", "short description", "brief description", "short summary", "one line summary", "doc", "docs", "comment", "inheritdoc",
)
_TODO = re.compile(r"^\W*(?:@?todo|fixme|xxx|hack|tbd|tba)\b(?:\([^)]*\))?[\s:,.-]*", re.I)
_TODO_FILLER = frozenset("write add explain describe document docs doc documentation missing needs need fill later me here comment comments description aside please still someone".split())
_DIRECTIVE = re.compile(
    r"^\W*(?:nolint|clang-(?:format|tidy)|eslint|jshint|jslint|tslint|prettier|@?ts-(?:ignore|nocheck|expect)|noqa|type:\s*ignore|pylint|flake8|mypy|pyright|ruff|isort|fmt:|yapf|pragma|go:\w|\+build|istanbul|c8|v8 ignore|"
    r"coverage|noinspection|suppress|checkstyle|spotless|rustfmt|clippy|cppcheck|lint|region\b|endregion\b|#?region|global\s+\w+$|exported\b|@?formatter:|nosonar|nosec|swiftlint|language=|vim?:|-\*-)", re.I)  # fmt: skip
_LICENCE = re.compile(r"spdx-|copyright|\blicen[cs]ed?\b|all rights|notice for terms|©", re.I)
_TAG = re.compile(r"^\s*(?:[@\\](?!brief|summary|description|desc|remarks|note|details)\w+|:\w+[^:\n]*:|\{@\w+[^}]*\}\s*$)")
_SECTION = re.compile(r"^\s*(?:args?|arguments|params?|parameters|returns?|return type|yields?|raises|throws|exceptions?|attributes|examples?|see also|notes?|rtype|input|output|inputs|outputs)\s*:?\s*$", re.I)
_SECTION_INLINE = re.compile(r"^\s*(?:args?|arguments|params?|parameters|returns?|yields?|raises|throws|rtype)\s*:", re.I)
_CODE = re.compile(
    r"^\s*(?:return\b.*[(\[;=]|.*[;{}]\s*$|[\w.$:>-]+\s*\(.*\)\s*;?\s*$|[\w.$\[\]]+\s*(?:[-+*/|&]|:)?=\s*\S.*|(?:if|for|while|switch|elif)\b.*[:{)]\s*$|(?:else|try|except|finally)\b\s*:?\s*$|(?:import|from|use|#include|package)\s+[\w.{}\"<]+.*;?$|(?:const|let|var|int|auto|def|func|fn|void)\s+\w+.*[=({;:].*)"
)
_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?!\S*\*\*)|//[/!]*|#+!?|--+)?[ \t]?|\s*\*+/\s*$")
_FILLER = frozenset(
    "the a an of this that these it its is are be was will would shall does do did to for and or in on with by as function method procedure routine func fn def helper returns return "
    "der die das ein eine la el le les un una de du des".split()
)
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_a-zA-Z]+")


def _lines(doc: str) -> list[str]:
    text = re.sub(r'^[rRuUbBfF]{0,2}("""|\'\'\'|"|\')([\s\S]*?)\1?$', r"\2", doc.strip()) if doc.lstrip()[:1] in "rRuUbBfF\"'" else doc
    return [_MARK.sub("", x.replace("*/", "")).strip() for x in text.replace("\r", "").split("\n")]


def is_substantive(doc: str | None, name: str | None, least: int = 2) -> bool:
    """Whether a documentation comment says something beyond the name."""
    if not doc:
        return False
    kept = []
    for line in _lines(doc):
        if _SECTION.match(line) or _SECTION_INLINE.match(line):
            break
        line = re.sub(r"^[@\\](?:brief|summary|description|desc|remarks|note|details)\b", "", line)
        if not line or _TAG.match(line) or _DIRECTIVE.match(line) or _LICENCE.search(line) or _CODE.match(line):
            continue
        if m := _TODO.match(line):
            # a remark that only asks for documentation says nothing
            rest = [w for w in re.findall(r"[^\W_]+", line[m.end() :].lower()) if w not in _TODO_FILLER and w not in _FILLER]
            if len(rest) < 4:
                continue
        kept.append(line)
    text = " ".join(kept)
    plain = re.sub(r"[\W_]+", " ", text).strip().lower()
    if not plain or plain in PLACEHOLDERS:
        return False
    wide = len(re.findall(r"[぀-ヿ㐀-鿿가-힯]", plain))
    if wide >= 4:
        return True
    parts = {p.lower() for p in _PART.findall(name or "")}
    beyond = 0
    for w in (p.lower() for p in _PART.findall(text)):
        if w in _FILLER or w.isdigit():
            continue
        if w in parts or any(w.startswith(p) and w[len(p) :] in ("s", "es", "d", "ed", "ing", "er", "or") or p.startswith(w) and p[len(w) :] in ("s", "es") for p in parts):
            continue
        if len(w) > 3 and any(len(p) > 3 and p[:-1] == w[: len(p) - 1] and len(w) - len(p) <= 3 for p in parts):
            continue
        beyond += 1
        if beyond >= least:
            return True
    return False


def _judge(docstring: pd.Series, comment: pd.Series, name: pd.Series) -> pd.Series:
    """1 when the docstring says something, else 2 when the comment does, else 0."""
    return pd.Series([1 if is_substantive(d, n) else 2 if is_substantive(c, n) else 0 for d, c, n in zip(docstring, comment, name)], dtype="int32")


_DEF = r"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]"


def _lexed(chunks: DataFrame, file_of: list[str], whole: bool) -> DataFrame:
    """One row per lexeme of the function, class and module chunks, each seq once; in Python with the indents at which
    the chunk defines functions. Blank lexemes and annotations only if whole."""
    lang = code_language(F.col("repo_path"))
    indents = F.when(F.col("lang") == "python", F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(_DEF), F.lit(1)), F.length)))
    rows = (
        chunks.where("chunk_type in ('function', 'class', 'module') and content is not null")
        .withColumn("lang", lang)
        .where("lang is not null")
        .select(*file_of, "seq", "chunk_type", "start_line", "end_line", "content", "lang")
        .repartition(*file_of)
        .withColumn("_copy", F.row_number().over(W.partitionBy(*file_of, "seq").orderBy("start_line")))
        .where("_copy = 1")
        .withColumn("lines", F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))))
        # below the explode, so that no text is repeated in its rows
        .withColumn("indents", indents)
        .withColumn("named", _by_language(_NAMED))
        .select(*file_of, "seq", "chunk_type", "start_line", "end_line", "lines", "lang", "indents", "named", F.posexplode(lexemes(F.col("content"), F.col("lang"))).alias("i", "x"))
        .withColumn("t", F.ltrim(F.col("x"), F.lit(" \t\r\n\f\x0b")))
        .withColumn("gap", F.substring(F.col("x"), F.lit(1), F.length("x") - F.length("t")))
    )
    t_starts = lambda *heads: reduce(lambda c, h: c | h, [F.col("t").startswith(h) for h in heads])
    one, two, last = F.substring("t", 1, 1), F.substring("t", 2, 1), F.substring(F.col("t"), -1, 1)
    is_comment = F.when(F.col("lang") == "python", one == "#").otherwise((one == "/") & two.isin("/", "*"))
    is_string = one.isin('"', "'") | (one.isin("r", "R", "u", "U") & two.isin('"', "'"))
    annotation = (one == "@") | F.col("t").startswith("[[") | F.col("t").startswith("__attribute__") | ((F.col("lang") == "rust") & (F.col("t").startswith("#[") | F.col("t").startswith("#![")))
    if not whole:
        # told by their first letters, so that the filter copies none of the dearer expressions
        rows = rows.where((F.col("t") != "") & ~annotation)
    plain = F.when(F.col("t") == "", "blank").when(is_comment, "comment").when(F.col("t") == "{", "open").when(F.col("t") == "}", "close").when(is_string, "string")
    # of the lexemes with more than a brace, headers alone end with one; the patterns are data, so one expression serves all languages
    shape = F.when(F.col("plain").isNotNull(), None).when((last == "{") | ((last == ":") & t_starts("def", "async")), F.col("named")).when((last == ">") & F.col("lang").isin("javascript", "typescript") & F.col("t").endswith("=>"), F.lit(_ARROW))
    name = F.call_function("regexp_extract", F.col("t"), F.col("shape"), F.lit(1))
    kind = F.coalesce("plain", F.when(F.col("name") != "", "header").when(annotation, "annotation").otherwise("rest"))
    delta = F.when((F.col("kind") == "open") | ((F.col("kind") == "header") & F.col("t").endswith("{")), 1).when(F.col("kind") == "close", -1).otherwise(0)
    # the rows are sorted from here on: of the texts, they keep comments and strings alone
    return rows.withColumn("plain", plain).withColumn("shape", shape).withColumn("name", name).withColumn("kind", kind).select(
        *file_of, "seq", "chunk_type", "start_line", "end_line", "lines", "lang", "indents", "i", "kind",
        F.when(F.col("name") != "", F.col("name")).alias("name"),
        delta.alias("delta"),
        F.when(F.col("kind").isin("comment", "string"), F.col("t")).alias("said"),
        (F.length("gap") - F.length(F.replace(F.col("gap"), F.lit("\n"), F.lit("")))).alias("nl"),
        F.length(F.substring_index("gap", "\n", -1)).alias("indent"),
        F.length("x").alias("wide"),
        F.length("t").alias("text_wide"),
    )


def documented_functions(chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """Function-documentation pairs: seq, repo_name, repo_path, language, function_name, documentation, and with
    with_code also depth and code (it is cut out of the chunk's text afterwards; the pairs are the same).

    Method: the text of each function, class and module chunk is lexed into rows (comments, strings, annotations,
    function headers, braces, and the rest of a line). Windows over a file's rows in order attach a comment row to the
    header behind it, past annotations (lag), a docstring to the header before it (lead), and sum the braces up to the
    depth. The rows that open or close a depth alternate within the partition of that depth, so the next one there
    delimits the function (gaps and islands). In Python the rows of a depth are those indented at most as far as a
    function is; the next of them ends it. A header without a body, or whose body doesn't end, is no function. The
    window runs over the whole file, so a comment at the end of the module chunk that ends on the line before reaches
    the function in the next chunk. A pair is kept when its documentation says something beyond the name: see
    is_substantive.

    A seq that is delivered twice counts once. The language is told by the extension of repo_path; other files, null
    paths and null contents give nothing. A null start_line or end_line only keeps a comment in the chunk before from
    being attached unless the line counts agree. Chunks are shuffled once, by file; a file is the unit that stays whole.
    """
    file_of = ["repo_name", "repo_path"]
    in_file = W.partitionBy(*file_of).orderBy("start_line", "seq", "i")
    upto = in_file.rowsBetween(W.unboundedPreceding, 0)
    rows = _lexed(chunks, file_of, with_code)
    places: list[str] = []
    if with_code:
        # characters of the file's chunks up to the end of a lexeme, before its text, and before its chunk
        places = ["until", "at", "chunk_at"]
        rows = rows.withColumn("until", F.sum("wide").over(upto)).withColumn("at", F.col("until") - F.col("text_wide"))
        rows = rows.withColumn("chunk_at", F.last(F.when(F.col("i") == 0, F.col("until") - F.col("wide")), True).over(upto))
        rows = rows.where("kind <> 'blank' and kind <> 'annotation'")
    rows = rows.withColumn("fresh", (F.col("nl") > 0) | (F.col("i") == 0))
    near = F.struct("seq", "i", "kind", "said", "fresh", "nl", "indent", "chunk_type", "start_line", "lines", "end_line", *places)
    rows = rows.withColumn("p", F.lag(near).over(in_file)).withColumn("n", F.lead(near).over(in_file)).withColumn("m", F.lead(near, 2).over(in_file)).withColumn("sum", F.sum("delta").over(upto))
    if with_code:
        rows = rows.withColumn("p2", F.lag("until", 2).over(in_file)).withColumn("base", F.last(F.when(F.col("p").isNull() | (F.col("p.seq") != F.col("seq")), F.col("sum") - F.col("delta")), True).over(upto))
    # the rows that open or close a depth; what lies around a header stays with it
    python, is_header = F.col("lang") == "python", F.col("kind") == "header"
    marks = rows.where("kind in ('header', 'open', 'close') or (lang = 'python' and fresh and kind <> 'comment')")
    if with_code:
        # a comment of the same indent belongs to its row, so what is before ends in front of it
        own = (F.col("p.kind") == "comment") & F.col("p.fresh") & (F.col("p.indent") == F.col("indent"))
        marks = marks.withColumn("before", F.when(own, F.col("p2")).otherwise(F.col("p.until")))
        marks = marks.withColumn("depth", F.when(python, F.size(F.filter("indents", lambda d: d < F.col("indent")))).otherwise(F.col("sum") - F.greatest("delta", F.lit(0)) - F.col("base")).cast("int"))
        places = [*places, "before", "depth"]
    at_brace = F.when(F.col("delta") == 1, F.col("sum") - 1).when(F.col("delta") == -1, F.col("sum"))
    # an arrow without a brace opens nothing; its row stands alone, at no depth
    levels = F.when(python, F.filter("indents", lambda d: d >= F.col("indent"))).otherwise(F.array(at_brace.cast("int")))
    around = [F.when(is_header, F.col(c)).alias(c) for c in ("p", "n", "m")]
    marks = marks.select(*file_of, "seq", "lang", "i", "kind", "delta", "nl", "indent", "chunk_type", "start_line", "name", *places, *around, F.explode(levels).alias("level"))
    in_level = W.partitionBy(*file_of, "seq", "level").orderBy("i")
    following = F.struct("i", "delta", *(c for c in places if c in ("until", "before")))
    headers = marks.withColumn("next", F.lead(following).over(in_level)).where(is_header)
    has_more = F.col("n.seq") == F.col("seq")
    in_python = has_more & (F.col("level") == F.col("indent")) & (F.col("next").isNull() | (F.col("next.i") > F.col("i") + 1))
    headers = headers.where(F.when(python, in_python).when(F.col("delta") == 1, F.col("next.delta") == -1).otherwise(has_more))
    same_chunk = (F.col("p.seq") == F.col("seq")) & ((F.col("nl") <= 1) | F.col("p.nl").isNull())
    p_end = F.col("p.start_line") + F.col("p.lines")
    ends_before = F.when(F.col("p.end_line").isNull(), F.col("start_line") - p_end <= 3).otherwise(F.col("p.end_line") == F.col("start_line") - 1)
    chunk_before = (F.col("p.seq") != F.col("seq")) & (F.col("p.chunk_type") == "module") & (F.col("start_line") - 1 >= p_end) & ends_before
    # the docstring is the next row, behind comments of its own
    at_second = (F.col("n.kind") == "comment") & (F.col("m.kind") == "string") & (F.col("m.seq") == F.col("seq"))
    inside = F.when((F.col("n.kind") == "string") & has_more, F.col("n.said")).when(at_second & has_more, F.col("m.said"))
    told = headers.withColumn("comment", F.when((F.col("p.kind") == "comment") & F.col("p.fresh") & (same_chunk | chunk_before), F.col("p.said"))).withColumn("docstring", F.when(python, inside))
    # one evaluation: the mark keeps the optimizer from copying the function into the filter
    judge = F.pandas_udf(_judge, "int").asNondeterministic()
    found = (
        told.where("comment is not null or docstring is not null")
        .withColumn("says", judge("docstring", "comment", "name"))
        .where("says > 0")
        .withColumn("documentation", F.when(F.col("says") == 1, F.col("docstring")).otherwise(F.col("comment")))
    )
    columns = ["seq", *file_of, F.col("lang").alias("language"), F.col("name").alias("function_name"), "documentation"]
    if not with_code:
        return found.select(*columns)
    ends = F.when(python, F.col("next.before")).when(F.col("delta") == 1, F.col("next.until")).when(F.col("m.seq") == F.col("seq"), F.col("m.at"))
    texts = chunks.where("content is not null").groupBy(*[F.col(c).alias(f"_{c}") for c in (*file_of, "seq")]).agg(F.min_by("content", "start_line").alias("content"))
    same = [F.equal_null(found[c], texts[f"_{c}"]) for c in (*file_of, "seq")]
    start, length = F.col("at") - F.col("chunk_at"), F.coalesce(ends - F.col("at"), F.length("content"))
    return found.join(texts, same).select(*columns, "depth", F.rtrim(F.substring("content", start.cast("int") + 1, length.cast("int"))).alias("code"))
