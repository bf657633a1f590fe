"""From questions to verified answers as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.citations import extract_citations, parse_answer, verify_citations
from ..operators.current_rows import last_by
from ..operators.packing import build_context
from ..operators.summaries import Provider, complete
from .hybrid import hybrid_topk

PROMPT = "Answer the question from the context and cite files as [path:start-end].\n\nQuestion: %s\n\nContext:\n%s\n"


def stub_answer(prompt: str) -> str:
    """Offline provider: names the places of the first context blocks."""
    import re

    places = re.findall(r"^\[([^\s|]+:\d+-\d+) \|", prompt, re.M)[:3]
    return "ANSWER: See " + ", ".join(f"[{p}]" for p in places) + ". CONFIDENCE: " + ("high" if places else "low")


def ask(chunks: DataFrame, questions: DataFrame, provider: Provider = stub_answer, n_results: int = 10, max_tokens: int = 4000, **flags: bool) -> DataFrame:
    """(question_id, answer, confidence, context tokens, citations, verified): retrieval, packing, generation, verification.

    chunks as in the chunks table (rows delivered twice count once); questions: (question_id, question).
    """
    docs = last_by(chunks.select("seq", "repo_path", "content", "chunk_type", "start_line", "end_line", "symbol_name", "language"), ["seq"], "start_line")
    hits = hybrid_topk(docs.select(F.col("seq").alias("doc_id"), F.col("content").alias("text")), questions, n_results, **flags)
    ranked = hits.join(docs.withColumnRenamed("seq", "doc_id"), "doc_id")
    contexts = build_context(ranked, max_tokens)
    prompts = questions.join(contexts, "question_id", "left").withColumn("prompt", F.format_string(PROMPT, F.col("question"), F.coalesce("context", F.lit("(no context retrieved)"))))
    done = complete(prompts, provider)
    answer, confidence = parse_answer(F.col("content"))
    answered = done.withColumn("answer", answer).withColumn("confidence", confidence)
    cited = extract_citations(answered, "question_id")
    checked = verify_citations(cited.withColumnRenamed("answer_id", "question_id"), ranked.select("question_id", "repo_path", "start_line", "end_line", F.col("doc_id").alias("seq")), ["question_id"])
    per = checked.groupBy("question_id").agg(F.count("*").alias("n_citations"), F.count_if("verified").alias("n_verified"))
    return answered.join(per, "question_id", "left").select(
        "question_id", "answer", "confidence", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("used", F.lit(0)).alias("context_tokens"),
        F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"),
    )


def grid(configs: DataFrame, questions: DataFrame, runs: int = 1) -> DataFrame:
    """Every configuration with every question and run; both sides are small lists of an experiment."""
    return questions.crossJoin(F.broadcast(configs)).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
