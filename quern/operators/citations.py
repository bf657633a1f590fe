"""Citations: extraction, verification by range join, coverage, and parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATION = r"\[([^\[\]\s]+?)(?::(\d+)(?:-(\d+))?)?\]"


def extract_citations(answers: DataFrame, answer_id: str = "id", text: str = "answer") -> DataFrame:
    """(answer_id, cite_ord, raw, file_path, start_line, end_line). Brackets without '/' or '.' are no citations; a single line is its own end."""
    group = lambda g: F.regexp_extract_all(F.col(text), F.lit(CITATION), F.lit(g))
    rows = answers.select(
        F.col(answer_id).alias("answer_id"), F.posexplode(F.arrays_zip(group(0).alias("raw"), group(1).alias("path"), group(2).alias("a"), group(3).alias("z"))).alias("cite_ord", "c")
    )
    start = F.nullif(F.col("c.a"), F.lit("")).cast("int")
    return rows.where("contains(c.path, '/') or contains(c.path, '.')").select(
        "answer_id", "cite_ord", F.col("c.raw").alias("raw"), F.col("c.path").alias("file_path"), start.alias("start_line"), F.coalesce(F.nullif(F.col("c.z"), F.lit("")).cast("int"), start).alias("end_line")
    )


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return ~((a2 < b1) | (a1 > b2))


def verify_citations(citations: DataFrame, chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds verified and chunk_seq: the first chunk (by seq) of the path whose lines overlap; without lines the path is enough.

    Equality on the path (and `by`) makes it a hash join with a residual condition. Chunks without lines only serve
    citations without lines.
    """
    keys = by or []
    c = chunks.select(*keys, F.col("repo_path").alias("file_path"), F.col("start_line").alias("c1"), F.col("end_line").alias("c2"), "seq").distinct()
    joined = citations.join(c, [*keys, "file_path"], "left")
    fits = F.col("start_line").isNull() | overlaps(F.col("start_line"), F.col("end_line"), F.col("c1"), F.col("c2"))
    first = F.min(F.when(fits & F.col("seq").isNotNull(), F.col("seq")))
    columns = [x for x in citations.columns]
    return joined.groupBy(*columns).agg(first.alias("chunk_seq")).withColumn("verified", F.col("chunk_seq").isNotNull())


def coverage(verified: DataFrame) -> DataFrame:
    """Per answer: citations, verified, unverified, coverage = verified / max(n, 1), chunks used, and the low-coverage warning."""
    out = verified.groupBy("answer_id").agg(
        F.count("*").alias("n_citations"), F.count_if("verified").alias("n_verified"), F.countDistinct("chunk_seq").alias("n_chunks")
    )
    ratio = F.col("n_verified") / F.greatest("n_citations", F.lit(1))
    return out.withColumn("coverage", ratio).withColumn("low_coverage", (F.col("n_verified") < F.col("n_citations")) & (ratio < 0.5))


def citation_accuracy(answers: DataFrame, citations: DataFrame, paths: DataFrame, answer_id: str = "id", by: list[str] | None = None) -> DataFrame:
    """(answer_id, accuracy): share of cited paths that exist; 1.0 for an answer without citations."""
    keys = by or []
    known = paths.select(*keys, F.col("repo_path").alias("file_path")).distinct().withColumn("known", F.lit(1.0))
    per = citations.join(known, [*keys, "file_path"], "left").groupBy("answer_id").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("accuracy"))
    every = answers.select(F.col(answer_id).alias("answer_id")).distinct()
    return every.join(per, "answer_id", "left").select("answer_id", F.coalesce("accuracy", F.lit(1.0)).alias("accuracy"))


def parse_answer(raw: Column) -> tuple[Column, Column]:
    """(answer, confidence) of a structured output; without markers the whole text and 'medium'."""
    body = F.regexp_extract(raw, r"(?is)ANSWER:\s*(.*?)(?=CITATIONS:|CONFIDENCE:|$)", 1)
    word = F.lower(F.regexp_extract(raw, r"(?i)CONFIDENCE:\s*(\w+)", 1))
    answer = F.when(raw.rlike("(?i)ANSWER:"), F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return answer, F.when(word.isin("high", "medium", "low"), word).otherwise("medium")
