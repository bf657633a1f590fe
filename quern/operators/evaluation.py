"""Deterministic evaluation: keywords, recall, judge scores, error buckets, grounding, per-config tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Words that are no keywords.
STOP_WORDS = (
    "the and for that this with from which when each into also using their than some like used need have not its your can set use you are has but all "
    "was one any how does own then these those they will them there here where what who why been being under over both only most other such should would "
    "could make made more many much"
).split()


def reference_keywords(text: Column) -> Column:
    """Sorted distinct keywords: back-quoted terms, snake_case words of 3 and CamelCase words of 4 letters or more."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1)), lambda x: F.lower(F.btrim(x, F.lit("@().,:;"))))
    quoted = F.filter(quoted, lambda x: F.length(x) >= 2)
    snake = F.filter(F.regexp_extract_all(text, F.lit(r"\b[a-z_][a-z0-9_]{2,}\b"), F.lit(0)), lambda x: ~x.isin(STOP_WORDS))
    camel = F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z]{3,}\b"), F.lit(0)), lambda x: F.lower(x))
    return F.array_sort(F.array_distinct(F.concat(quoted, snake, camel)))


def keyword_recall(keywords: Column, corpus: Column) -> Column:
    """Share of the keywords that the lower-cased corpus contains; 0.0 without keywords."""
    low = F.lower(F.coalesce(corpus, F.lit("")))
    hits = F.size(F.filter(keywords, lambda k: F.contains(low, k)))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(F.lit(0.0))


def mean_std(column: str, prefix: str | None = None) -> list[Column]:
    """Mean and sample standard deviation, the latter 0 for one value."""
    p = prefix or column
    return [F.avg(column).alias(f"{p}_mean"), F.when(F.count(column) > 0, F.coalesce(F.stddev_samp(column), F.lit(0.0))).alias(f"{p}_std")]


def aggregate_by(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[c for v in values for c in mean_std(v)])


def pivot_mean_std(rows: DataFrame, row_key: str, column_key: str, columns: list[str], value: str) -> DataFrame:
    """One row per row_key, <column>_mean and <column>_std per column, 0 where nothing was measured."""
    wide = rows.groupBy(row_key).pivot(column_key, columns).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    return wide.na.fill(0.0)


def parse_judge(raw: Column) -> Column:
    """struct(accuracy, completeness, relevance, clarity, reasoning) of the last JSON object with an accuracy; scores clipped to 1..10."""
    objects = F.regexp_extract_all(raw, F.lit(r'\{[^{}]*"accuracy"[^{}]*\}'), F.lit(0))
    last = F.get(objects, F.size(objects) - 1)
    data = F.from_json(last, "accuracy double, completeness double, relevance double, clarity double, reasoning string")
    clip = lambda c: F.when(c.isNotNull(), F.least(F.lit(10), F.greatest(F.lit(1), c.cast("int"))))
    fields = ("accuracy", "completeness", "relevance", "clarity")
    return F.when(last.isNotNull(), F.struct(*[clip(data[f]).alias(f) for f in fields], F.substring(F.coalesce(data["reasoning"], F.lit("")), 1, 500).alias("reasoning")))


def judge_aggregate(runs: DataFrame, by: str) -> DataFrame:
    """Mean and deviation of the four scores over the runs that could be parsed, and how many those are."""
    scored = runs.withColumn("s", parse_judge(F.col("raw"))).where("s is not null")
    dims = ("accuracy", "completeness", "relevance", "clarity")
    flat = scored.select(by, *[F.col(f"s.{d}").alias(d) for d in dims])
    return flat.groupBy(by).agg(F.count("*").alias("n_runs"), *[c for d in dims for c in mean_std(d)])


def error_bucket(recall: Column, n_citations: Column, type_correct: Column, gold_hit: Column, citation_accuracy: Column, judge_accuracy: Column, least_judge: float = 6.0) -> Column:
    """The first failure that applies to an answered question, else 'clean_pass'. Missing measurements don't fail."""
    return (
        F.when(F.coalesce(recall, F.lit(0.0)) == 0, "retrieval_miss")
        .when(F.coalesce(n_citations, F.lit(0)) == 0, "empty_context")
        .when(~F.coalesce(type_correct, F.lit(True)), "wrong_routing")
        .when(~F.coalesce(gold_hit, F.lit(False)), "cited_wrong_path")
        .when(F.coalesce(citation_accuracy, F.lit(1.0)) == 0, "unverified_citation")
        .when(F.coalesce(judge_accuracy, F.lit(10.0)) < least_judge, "low_judge_quality")
        .otherwise("clean_pass")
    )


def retrieval_verdict(hybrid: Column, semantic: Column, lexical: Column) -> Column:
    """How fusion compares with the better single list."""
    best = F.greatest(semantic, lexical)
    return F.when(hybrid > best, "better").when(hybrid == best, "equal").otherwise("worse")


def finding(delta: Column, large: float = 0.3, noticeable: float = 0.05) -> Column:
    """What a difference of a mean to the base configuration amounts to."""
    return F.when(delta > large, "validated").when(F.abs(delta) > noticeable, "noticeable").otherwise("marginal")


# Terms that are no identifiers, signs around one, and the patterns of quoted terms and of calls.
NO_IDENTIFIERS = "the and for with this that from into file path name code data list dict true false none null".split()
IDENTIFIER_EDGES = "()@,.:;* "
QUOTED_TERM = r"`([^`]+)`"
CALLED_NAME = r"\b([A-Za-z_][A-Za-z0-9_]{2,})\(\)"


def extract_identifiers(text: Column) -> Column:
    """Identifiers a summary names: back-quoted terms without blanks, freed of the signs around them, and the names of calls name();
    3 letters at least, common words left out, sorted."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit(QUOTED_TERM), F.lit(1)), lambda x: F.btrim(strip(x), F.lit(IDENTIFIER_EDGES)))
    calls = F.regexp_extract_all(text, F.lit(CALLED_NAME), F.lit(1))
    kept = F.filter(F.concat(quoted, calls), lambda x: (F.length(x) >= 3) & ~F.contains(x, F.lit(" ")) & ~F.lower(x).isin(NO_IDENTIFIERS))
    return F.array_sort(F.array_distinct(kept))


def grounding(summaries: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """Per summary: identifiers, how many its source lacks, and a status. sources: (by..., text)."""
    joined = summaries.join(sources.select(*by, F.col("text").alias("_source")), by, "left").withColumn("idents", extract_identifiers(F.col("content")))
    missing = F.filter("idents", lambda x: ~(F.contains(F.col("_source"), x) | F.contains(F.col("_source"), F.replace(x, F.lit("()"), F.lit("")))))
    out = joined.withColumn("missing", F.when(F.col("_source").isNotNull(), missing))
    status = F.when(F.col("_source").isNull(), "source_missing").when(F.size("missing") > 0, "has_missing").otherwise("grounded")
    return out.select(*by, "level", F.size("idents").alias("n_identifiers"), F.coalesce(F.size("missing"), F.lit(0)).alias("n_missing"), status.alias("status"))


def grounding_totals(rows: DataFrame) -> DataFrame:
    ratio = F.when(F.sum("n_identifiers") > 0, 1 - F.sum("n_missing") / F.sum("n_identifiers")).otherwise(F.lit(1.0))
    return rows.groupBy("level").agg(
        F.count("*").alias("n"), F.sum("n_identifiers").alias("n_identifiers"), F.sum("n_missing").alias("n_missing"), F.count_if(F.col("n_missing") > 0).alias("n_with_missing"), ratio.alias("grounded")
    )


def config_deltas(table: DataFrame, key: str, base: str, value: str) -> DataFrame:
    """Difference of each configuration's value to the base configuration's."""
    b = table.where(F.col(key) == base).select(F.col(value).alias("_base"))
    return table.crossJoin(F.broadcast(b)).select(key, value, (F.col("_base") - F.col(value)).alias("delta"))
