"""Text functions as Spark column expressions (JVM side, inside the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the default tokenizer, also used in TESTDATA.md.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
# Fixed value: the lexical tokenizer of BM25, on lower-cased text.
LEXICAL_PATTERN = r"[a-z_][a-z0-9_]*"
# Fixed value: the line ends that split lines (CRLF counts once).
LINE_END_PATTERN = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def token_count(text: Column) -> Column:
    """Number of default tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def truncate_tokens(text: Column, most: int) -> Column:
    """The text up to the end of its first `most` default tokens; a shorter text as it is."""
    parts = F.regexp_extract_all(text, F.lit(rf"[ \t\r\n]*(?:{TOKEN_PATTERN})"), F.lit(0))
    return F.when(F.size(parts) > most, F.array_join(F.slice(parts, 1, most), "")).otherwise(text)


def lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL_PATTERN), F.lit(0))


def strip(text: Column) -> Column:
    """Strip all white space at both ends (Spark's trim takes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a trailing line end opens no further line."""
    parts = F.split(text, LINE_END_PATTERN)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by ':'."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def parent_dir(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]+$", 1), F.lit("")), F.lit("."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; '' when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def guarded_ratio(x: Column, n: Column) -> Column:
    return x / F.greatest(n, F.lit(1))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null when a vector is null, empty or zero."""
    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)
