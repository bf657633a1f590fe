"""Scan of a source tree into the files table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import file_type, is_skipped
from ..operators.current_rows import with_ordinal
from ..session import spread

PROBE_BYTES = 8192


def scan_tree(spark: SparkSession, root: str, repo_name: str) -> DataFrame:
    """(repo_name, repo_path, abs_path, language, size_bytes, raw_content, file_ord) of a tree.

    Paths are listed without contents and left out by folder and file type; only the files that are kept are then opened,
    inside the tasks. Files with a zero byte in their first 8192 bytes are binary and left out. Malformed UTF-8 becomes
    U+FFFD. file_ord is the rank of the path, the defined order of the scan. The root may lie in any file system that
    Spark lists and pyarrow opens.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    rows = listed.withColumn("repo_path", F.expr(f"substring(path, {len(base) + 1})"))
    kept = rows.where(~is_skipped(F.col("repo_path"))).withColumn("language", file_type(F.col("repo_path"))).where("language <> 'unknown'")
    text = spread(kept).mapInPandas(_contents, "path string, length long, repo_path string, language string, content binary").where("content is not null")
    decoded = text.select(
        F.lit(repo_name).alias("repo_name"), "repo_path", F.regexp_replace("path", r"^file:/*", "/").alias("abs_path"), "language", F.col("length").alias("size_bytes"), _lenient_utf8(F.col("content")).alias("raw_content")
    )
    # numbered by the paths of the kept texts, which is a narrow table
    return decoded.join(with_ordinal(text.select("repo_path"), ["repo_path"], "file_ord"), "repo_path").select(*decoded.columns, "file_ord")


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds each file's bytes; null for binary files and files that are gone."""
    for b in batches:
        for i in range(len(b)):
            row = b.iloc[i : i + 1].copy()
            row["content"] = pd.Series([_read(row["path"].iloc[0])], index=row.index, dtype=object)
            yield row


def _read(path: str) -> bytes | None:
    where = path if not path.startswith("file:") else "file:///" + path.removeprefix("file:").lstrip("/")
    try:
        if where.startswith("file:"):
            with open(where.removeprefix("file://"), "rb") as f:
                data = f.read()
        else:
            system, name = FileSystem.from_uri(where)
            with system.open_input_stream(name) as f:
                data = f.read()
    except FileNotFoundError:
        return None
    return None if b"\0" in data[:PROBE_BYTES] else data


def _lenient_utf8(content):
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="replace"))

    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.pandas_udf(decode, "string")(content))
