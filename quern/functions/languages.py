"""Programming languages by file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of the code languages.
CODE_EXTENSIONS = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java",
    ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cc": "cpp",
}


def code_language(path: Column) -> Column:
    """The code language told by the extension; null for other files and null paths."""
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    pairs = [F.lit(x) for kv in CODE_EXTENSIONS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), ext)

# File types by extension, by whole name, and folders that a scan leaves out.
FILE_TYPES = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".md": "markdown", ".rst": "text", ".txt": "text", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".ini": "text", ".cfg": "text", ".env": "text", ".sh": "text", ".bash": "text", ".zsh": "text",
}
NAMED_FILES = {"Dockerfile": "dockerfile", "Makefile": "text", "Procfile": "text", "Gemfile": "text", "Rakefile": "text"}
SKIPPED_FOLDERS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "build", "dist", "target", ".gradle", ".idea", ".vscode",
    "vendor", "third_party", ".mypy_cache", ".pytest_cache", "coverage", ".coverage", "htmlcov",
)
CODE_TYPES = ("python", "javascript", "typescript", "java", "go", "rust", "c", "cpp")


def file_type(path: Column) -> Column:
    """Type of a file: whole names, then Dockerfile variants, then the lower-cased extension, else 'unknown'."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(NAMED_FILES), name), F.when(name.startswith("Dockerfile"), "dockerfile"), F.try_element_at(table(FILE_TYPES), ext), F.lit("unknown"))


def is_skipped(path: Column) -> Column:
    """Whether a folder on the path is one that scans leave out, or a hidden one. Hidden files themselves are kept."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS) | f.startswith("."))
