"""Token budgets: prefix-greedy and skip-greedy packing, and context rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_count, truncate_tokens

# Fixed value: order in which a file's chunks represent it.
CHUNK_PRIORITY = ("function", "class", "module", "config", "prose")


def pack_prefix(rows: DataFrame, by: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """Rows in order until the first that does not fit; adds used (running sum). A first row over the budget is kept alone.
    A group is sorted in one task: group by question or file, not by repository."""
    w = W.partitionBy(*by).orderBy(*order)
    run = rows.withColumn("used", F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return run.where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def pack_skip(rows: DataFrame, by: list[str], order: list[str], item: str, tokens: str, budget: int) -> DataFrame:
    """(by..., items, used): items in order, those that do not fit are skipped. The fold runs over one group's array."""
    entries = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("item"), F.col(tokens).cast("bigint").alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{dict(rows.dtypes)[item]}>").alias("items"))
    fold = F.aggregate(
        "entries",
        start,
        lambda s, x: F.when(s["used"] + x["n"] <= budget, F.struct((s["used"] + x["n"]).alias("used"), F.concat(s["items"], F.array(x["item"])).alias("items"))).otherwise(s),
    )
    return rows.groupBy(*by).agg(entries.alias("entries")).select(*by, fold.alias("s")).select(*by, "s.items", "s.used")


def chunk_priority(chunk_type: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in CHUNK_PRIORITY]), chunk_type), F.lit(0)), F.lit(99))


def context_block(path: Column, start: Column, end: Column, chunk_type: Column, symbol: Column, language: Column, content: Column) -> Column:
    """One chunk as a header line and a fenced text."""
    place = F.concat(path, F.lit(":"), F.coalesce(start.cast("string"), F.lit("?")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("?")))
    head = F.concat(F.lit("["), place, F.lit(" | "), F.coalesce(chunk_type, F.lit("prose")), F.when(symbol.isNotNull() & (symbol != ""), F.concat(F.lit(": "), symbol)).otherwise(F.lit("")), F.lit("]"))
    fence = F.when(language.isNull() | language.isin("", "unknown"), F.lit("")).otherwise(language)
    return F.concat(head, F.lit("\n```"), fence, F.lit("\n"), content, F.lit("\n```"))


def build_context(ranked: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """(question_id, context, n_chunks, used) of ranked chunks (question_id, rank and the chunk columns).

    Chunks in order until the first that does not fit. A first chunk that alone is over the budget stands alone, its
    content cut to the budget less 50 tokens, with a mark.
    """
    shown = lambda content: context_block(*[F.col(c) for c in ("repo_path", "start_line", "end_line", "chunk_type", "symbol_name", "language")], content)
    cut = F.concat(truncate_tokens(F.col("content"), max(0, max_tokens - 50)), F.lit("\n[...truncated...]"))
    rows = ranked.withColumn("block", shown(F.col("content"))).withColumn("n", token_count(F.col("block")))
    # a later chunk over the budget is never kept
    rows = rows.withColumn("block", F.when(F.col("n") > max_tokens, shown(cut)).otherwise(F.col("block")))
    kept = pack_prefix(rows, ["question_id"], ["rank"], "n", max_tokens)
    return kept.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"),
        F.count("*").alias("n_chunks"),
        F.sum(token_count(F.col("block"))).alias("used"),
    )
