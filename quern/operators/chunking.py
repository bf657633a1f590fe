"""Chunkers: one file row in, several chunk rows out."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.languages import CODE_TYPES, file_type
from ..functions.text import TOKEN_PATTERN, short_hash, split_lines, token_count

CHUNKS = "repo_name string, id string, repo_path string, content string, chunk_type string, start_line int, end_line int, symbol_name string, token_count int, language string, chunk_ord int, error string"
_TOKEN = re.compile(TOKEN_PATTERN)
_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_HEADING = re.compile(r"#{1,6}\s")


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def window(lines: list[str], first_line: int, max_tokens: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """Next-fit windows over lines: at least one line, at most max_tokens; the next window steps back max(1, overlap // 10)
    lines where that leaves progress, so a last window that spans more lines is followed by its own tail."""
    counts = [count_tokens(x) for x in lines]
    start, n = 0, len(lines)
    while start < n:
        end, used = start, 0
        while end < n and (end == start or used + counts[end] <= max_tokens):
            used += counts[end]
            end += 1
        text = "\n".join(lines[start:end])
        if text.strip():
            yield text, first_line + start, first_line + end - 1
        back = end - max(1, overlap // 10)
        start = back if back > start else end


def lines_of(text: str) -> list[str]:
    parts = _LINE_END.split(text)
    return parts[:-1] if parts and parts[-1] == "" else parts


def _sections(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = 0
    for i, x in enumerate(lines):
        if i > start and _HEADING.match(x):
            yield start, lines[start:i]
            start = i
    if start < len(lines):
        yield start, lines[start:]


def _mapping(data: object, raw: str, dump, short, limit: int) -> list[str] | None:
    if not isinstance(data, dict):
        return None
    whole = dump(data)
    if count_tokens(whole) <= limit:
        return [whole]
    out = []
    for key, value in data.items():
        part = dump({key: value})
        out.append(part if count_tokens(part) <= limit else short(key, value))
    return out


def chunk_text(kind: str, text: str, max_tokens: int = 512, overlap: int = 64) -> list[tuple[str, str, int, int, str | None]]:
    """(content, chunk_type, start_line, end_line, symbol) of one file by its type. Parse failures fall back to lines."""
    lines = lines_of(text)
    if kind == "markdown":
        return [(c, "prose", a, b, None) for at, part in _sections(lines) for c, a, b in window(part, at + 1, max_tokens, overlap)]
    if kind in ("json", "yaml", "toml"):
        try:
            parts = _config(kind, text, max_tokens)
        except Exception:  # noqa: BLE001  any parse failure means plain text
            parts = None
        if parts is not None:
            return [(p, "config", 1, max(1, len(lines)), None) for p in parts]
    if kind == "python":
        found = _python_chunks(text, lines, max_tokens, overlap)
        if found:
            return found
    config = kind == "dockerfile"
    return [(c, "config" if config else "prose", a, b, None) for c, a, b in window(lines, 1, max_tokens, overlap)]


def _config(kind: str, text: str, limit: int) -> list[str] | None:
    if kind == "json":
        dump = lambda d: json.dumps(d, indent=2)
        return _mapping(json.loads(text), text, dump, lambda k, v: dump({k: str(v)[:200]}), limit)
    if kind == "yaml":
        import yaml

        dump = lambda d: yaml.dump(d, default_flow_style=False)
        return _mapping(yaml.safe_load(text), text, dump, lambda k, v: f"{k}: <truncated>", limit)
    import tomllib

    data = tomllib.loads(text)
    if count_tokens(text) <= limit:
        return [text]
    return _mapping(data, text, lambda d: "\n".join(f"[{k}]\n{json.dumps(v, indent=2, default=str)}" for k, v in d.items()), lambda k, v: f"[{k}]\n# <truncated>", limit)


def _python_chunks(text: str, lines: list[str], max_tokens: int, overlap: int) -> list[tuple[str, str, int, int, str | None]]:
    """Top-level definitions as chunks, the lines between them as module chunks; nothing for text that does not parse."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple[str, str, int, int, str | None]] = []
    covered: set[int] = set()
    for node in tree.body:
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        a = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        b = node.end_lineno or node.lineno
        covered.update(range(a, b + 1))
        content = "\n".join(lines[a - 1 : b])
        kind = "module" if node.decorator_list else "class" if isinstance(node, ast.ClassDef) else "function"
        name = None if node.decorator_list else node.name
        if count_tokens(content) <= max_tokens:
            out.append((content, kind, a, b, name))
        else:
            out += [(c, "module", x, y, name) for c, x, y in window(lines[a - 1 : b], a, max_tokens, overlap)]
    island: list[int] = []
    for i in [*(k for k in range(1, len(lines) + 1) if k not in covered), None]:
        if island and (i is None or i != island[-1] + 1):
            body = "\n".join(lines[island[0] - 1 : island[-1]]).strip()
            if body:
                out += [(c, "module", x, y, None) for c, x, y in window(body.split("\n"), island[0], max_tokens, overlap)]
            island = []
        if i is not None:
            island.append(i)
    return sorted(out, key=lambda c: c[2])


def chunk_files(files: DataFrame, max_tokens: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of every file: see CHUNKS. A file that fails gives one row with its error and no content; null contents
    give nothing. Files are independent rows, so the work is spread as the files are."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for b in batches:
            rows = []
            for repo, path, kind, text in zip(b["repo_name"], b["repo_path"], b["kind"], b["raw_content"]):
                try:
                    parts = chunk_text(kind, text, max_tokens, overlap)
                except Exception as e:  # noqa: BLE001  isolation per file
                    rows.append((repo, None, path, None, None, None, None, None, None, kind, None, repr(e)[:300]))
                    continue
                for i, (content, chunk_type, a, z, symbol) in enumerate(parts):
                    key = hashlib.sha256(f"{path}:{a}".encode()).hexdigest()[:16]
                    rows.append((repo, key, path, content, chunk_type, a, z, symbol, count_tokens(content), kind, i, None))
            yield pd.DataFrame(rows, columns=names)

    return files.where("raw_content is not null").select("repo_name", "repo_path", file_type(F.col("repo_path")).alias("kind"), "raw_content").mapInPandas(cut, CHUNKS)


def is_code(path: Column) -> Column:
    return file_type(path).isin(*CODE_TYPES)


def sections(files: DataFrame) -> DataFrame:
    """Markdown sections: (repo_name, repo_path, section, start_line, end_line, n_tokens). A heading opens a section unless it is the first line."""
    lines = files.where("raw_content is not null").select("repo_name", "repo_path", F.posexplode(split_lines(F.col("raw_content"))).alias("i", "line"))
    w = W.partitionBy("repo_name", "repo_path").orderBy("i")
    opens = (F.col("line").rlike(r"^#{1,6}\s") & (F.col("i") > 0)).cast("int")
    marked = lines.withColumn("section", F.sum(opens).over(w)).withColumn("n", token_count(F.col("line")))
    return marked.groupBy("repo_name", "repo_path", "section").agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.sum("n").alias("n_tokens"))


def uncovered_islands(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Runs of lines that no chunk covers: (repo_name, repo_path, start_line, end_line); gaps and islands."""
    keys = ["repo_name", "repo_path"]
    counted = files.where("raw_content is not null").select(*keys, F.size(split_lines(F.col("raw_content"))).alias("n")).where("n > 0")
    lines = counted.select(*keys, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    covered = chunks.where("start_line is not null and end_line >= start_line").select(*keys, F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    free = lines.join(covered, [*keys, "line"], "left_anti")
    w = W.partitionBy(*keys).orderBy("line")
    return free.withColumn("g", F.col("line") - F.row_number().over(w)).groupBy(*keys, "g").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("g")


def chunk_id(path: Column, start_line: Column) -> Column:
    return short_hash(path, start_line)
