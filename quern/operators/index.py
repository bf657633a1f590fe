"""Index rows of chunks and summaries, and embedding by a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_tokens
from .current_rows import first_by
from .lexical import postings
from .vectors import hashed_vectors

Embed = Callable[[list[str]], list[list[float]]]


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Index rows of chunks; a seq that is delivered twice counts once."""
    one = chunks.dropDuplicates(["seq"])
    return one.select(
        "repo_name", "id", F.lit("chunk").alias("doc_type"), F.col("content").alias("document"), "chunk_type", F.col("repo_path").alias("file_path"), "language",
        "start_line", "end_line", "symbol_name", F.lit(None).cast("string").alias("summary_level"), "token_count", "seq",
    )


def summary_rows(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "repo_name", "id", F.lit("summary").alias("doc_type"), F.col("content").alias("document"), F.lit(None).cast("string").alias("chunk_type"), F.col("path").alias("file_path"),
        F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("symbol_name"),
        F.col("level").alias("summary_level"), "token_count", F.lit(None).cast("bigint").alias("seq"),
    )


def with_sentinels(rows: DataFrame) -> DataFrame:
    """The export form: -1 for missing lines and '' for missing texts, as flat metadata stores know no nulls."""
    texts = ("chunk_type", "symbol_name", "summary_level", "language")
    lines = ("start_line", "end_line")
    return rows.withColumns({**{c: F.coalesce(c, F.lit("")) for c in texts}, **{c: F.coalesce(c, F.lit(-1)) for c in lines}})


def embed(texts: DataFrame, provider: Embed, column: str = "document", batch: int = 100, max_tokens: int | None = None, retries: int = 5) -> DataFrame:
    """Adds embedding: the provider's vector per text, in batches within the tasks, of whole texts unless the provider takes
    max_tokens at most; a batch that keeps failing gives nulls."""

    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            values = [x or "" for x in s]
            for i in range(0, len(values), batch):
                got: list = [None] * len(values[i : i + batch])
                for _ in range(retries):
                    try:
                        got = provider(values[i : i + batch])
                        break
                    except Exception:  # noqa: BLE001  a failing provider must not fail the task
                        continue
                out += got
            yield pd.Series(out, dtype=object)

    vectors.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts.withColumn("embedding", F.pandas_udf(vectors, "array<float>")(F.col(column) if max_tokens is None else truncate_tokens(F.col(column), max_tokens)))


def build_index(chunks: DataFrame, summaries: DataFrame | None = None, provider: Embed | None = None) -> DataFrame:
    """Chunks (the first of each id) and summaries with vectors, ready for the vector table.

    Without a provider the vectors are hashed term frequencies, made in the plan.
    """
    rows = first_by(chunk_rows(chunks), ["repo_name", "id"], "seq")
    if summaries is not None:
        rows = rows.unionByName(summary_rows(summaries))
    if provider is not None:
        return embed(rows, provider)
    keyed = rows.withColumn("doc_id", F.xxhash64("repo_name", "id", "doc_type"))
    return keyed.join(hashed_vectors(postings(keyed, "doc_id", "document")), "doc_id", "left").drop("doc_id")


def readme_excerpt(chunks: DataFrame, budget: int = 500) -> DataFrame:
    """(repo_name, excerpt) of the first readme chunk: whole within the budget, else its first lines and a mark."""
    from pyspark.sql import Window as W

    from ..functions.text import split_lines, token_count

    readme = chunks.where(F.contains(F.lower("repo_path"), F.lit("readme")) & F.col("content").isNotNull()).groupBy("repo_name").agg(F.min_by("content", "seq").alias("content"))
    whole = readme.withColumn("n", token_count(F.col("content")))
    lines = whole.where(F.col("n") > budget).select("repo_name", F.posexplode(split_lines(F.col("content"))).alias("i", "line"))
    w = W.partitionBy("repo_name").orderBy("i")
    kept = lines.withColumn("used", F.sum(token_count(F.col("line"))).over(w)).where(F.col("used") <= budget)
    head = kept.groupBy("repo_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("head"))
    cut = F.concat(F.coalesce("head", F.lit("")), F.lit("\n...[truncated]"))
    return whole.join(head, "repo_name", "left").select("repo_name", F.when(F.col("n") <= budget, F.col("content")).otherwise(cut).alias("excerpt"))


def first_files(ranked: DataFrame, n: int = 5) -> DataFrame:
    """The first n distinct files per question in rank order: (question_id, files)."""
    best = ranked.groupBy("question_id", "repo_path").agg(F.min("rank").alias("best"))
    ordered = best.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("best", "repo_path"))).alias("f"))
    return ordered.select("question_id", F.slice(F.transform("f", lambda x: x["repo_path"]), 1, n).alias("files"))


def missing(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")
