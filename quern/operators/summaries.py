"""Hierarchical summaries: files, folders, projects, through a pluggable provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parent_dir, short_hash, token_count
from ..session import ensure_checkpoint_dir
from .packing import chunk_priority, pack_skip

Provider = Callable[[str], str]


def extractive(prompt: str) -> str:
    """The offline provider: the first non-blank line of each excerpt, at most five."""
    heads = [next((x.strip() for x in part.split("\n")[1:] if x.strip()), "") for part in prompt.split("\n\n---\n\n")]
    return " ".join(h for h in heads[:5] if h)[:1000]


def complete(prompts: DataFrame, provider: Provider = extractive, prompt: str = "prompt", retries: int = 3) -> DataFrame:
    """Adds content: the provider's answer per prompt, null after failed retries. One call per row, inside the tasks."""

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for p in b:
                text = None
                for _ in range(retries):
                    try:
                        text = provider(p or "")
                        break
                    except Exception:  # noqa: BLE001  a failed row must not fail the task
                        continue
                out.append(text)
            yield pd.Series(out, dtype=object)

    from pyspark.sql.functions import pandas_udf

    answer.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return prompts.withColumn("content", pandas_udf(answer, "string")(F.col(prompt)))


def file_prompts(chunks: DataFrame, max_tokens: int = 3000) -> DataFrame:
    """(repo_name, path, prompt, source_ids, n_excerpts): a file's chunks by type priority, skip-greedy within the budget."""
    keyed = chunks.dropDuplicates(["seq"]).withColumn("priority", chunk_priority(F.col("chunk_type"))).withColumn("n", token_count(F.col("content")))
    head = F.concat(F.lit("# "), F.col("repo_path"), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")), F.lit("\n"), F.coalesce("content", F.lit("")))
    keyed = keyed.withColumn("excerpt", head)
    kept = pack_skip(keyed, ["repo_name", "repo_path"], ["priority", "chunk_ord", "seq"], "excerpt", "n", max_tokens)
    ids = keyed.groupBy("repo_name", "repo_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", "seq", "id"))), lambda x: x["id"]).alias("source_ids"))
    return kept.join(ids, ["repo_name", "repo_path"]).select("repo_name", F.col("repo_path").alias("path"), F.array_join("items", "\n\n---\n\n").alias("prompt"), "source_ids", F.size("items").alias("n_excerpts"))


def _finish(rows: DataFrame, level: str) -> DataFrame:
    return rows.where("content is not null").select(
        "repo_name", short_hash(F.lit("summary"), F.lit(level), F.col("path")).alias("id"), F.lit(level).alias("level"), "path", "content", "source_ids", token_count(F.col("content")).alias("token_count")
    )


def _fitting(children: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Skip-greedy choice within a budget, in order of (path, id): the bullet that does not fit gives way to a placeholder.

    One pass over sorted rows that carries only the sum of its group, so no group is held in memory.
    """

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used = None, 0
        for b in batches:
            entries = []
            for *key, path, bullet, n in zip(*(b[c] for c in by), b["path"], b["bullet"], b["n"]):
                if key != group:
                    group, used = key, 0
                if used + n <= budget:
                    used += n
                    entries.append(bullet)
                else:
                    entries.append(f"- {path}\n<omitted>")
            yield b.drop(columns=["bullet", "n"]).assign(entry=pd.Series(entries, index=b.index, dtype=object))

    rows = children.select(*by, "path", "id", "bullet", "n").repartition(*by).sortWithinPartitions(*by, "path", "id")
    return rows.mapInPandas(choose, ", ".join(f"{c} string" for c in [*by, "path", "id", "entry"]))


def _roll_up(children: DataFrame, level: str, provider: Provider, budget: int, path) -> DataFrame:
    """One summary per parent of its children's bullets; a bullet that does not fit gives way to a placeholder.

    Only the chosen bullets (within the budget), placeholders and ids are collected per parent, which prompt and
    source_ids name anyway.
    """
    bullets = children.select("repo_name", path.alias("parent"), "path", "id", F.concat(F.lit("- "), F.col("path"), F.lit("\n"), F.col("content")).alias("bullet")).withColumn("n", token_count(F.col("bullet")))
    chosen = _fitting(bullets, ["repo_name", "parent"], budget)
    grouped = chosen.groupBy("repo_name", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.struct("path", "id", "entry"))).alias("e"))
    prompts = grouped.select("repo_name", "path", F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n---\n\n").alias("prompt"), F.transform("e", lambda x: x["id"]).alias("source_ids"))
    return _finish(complete(prompts, provider), level)


def summarize(chunks: DataFrame, provider: Provider = extractive, file_budget: int = 3000, folder_budget: int = 3000, project_budget: int = 3500) -> DataFrame:
    """File, folder and project summaries (repo_name, id, level, path, content, source_ids, token_count).

    A folder is summarised from the files directly in it, the project from its top folders (those without '/'), or
    from all folders where there is none.
    """
    ensure_checkpoint_dir(chunks.sparkSession)
    # each level is kept before the next reads it: a provider is asked once per summary
    files = _finish(complete(file_prompts(chunks, file_budget), provider), "file").checkpoint()
    folders = _roll_up(files, "directory", provider, folder_budget, parent_dir(F.col("path"))).checkpoint()
    tops = folders.withColumn("is_top", ~F.contains(F.col("path"), F.lit("/")))
    any_top = tops.groupBy("repo_name").agg(F.max("is_top").alias("any_top"))
    chosen = tops.join(any_top, "repo_name").where("is_top or not any_top")
    project = _roll_up(chosen, "project", provider, project_budget, F.lit("."))
    return files.unionByName(folders).unionByName(project)


def folder_rollup(chunks: DataFrame) -> DataFrame:
    """Files and tokens below every folder: each path is exploded to its ancestors, so the join with folders is by equality."""
    files = chunks.dropDuplicates(["seq"]).withColumn("n", token_count(F.col("content"))).groupBy("repo_name", "repo_path").agg(F.sum("n").alias("n_tokens"))
    parts = F.split("repo_path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    return files.select("repo_name", "n_tokens", F.explode(folders).alias("folder")).groupBy("repo_name", "folder").agg(F.count("*").alias("n_files"), F.sum("n_tokens").alias("n_tokens"))
