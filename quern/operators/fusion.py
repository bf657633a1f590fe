"""Reciprocal rank fusion, question classification and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
# Patterns per question type; a question's type is the one with most matching patterns.
QUESTION_PATTERNS = {
    "architecture": (
        r"\barchitect", r"\bstructur", r"\bdesign.pattern", r"\bmodule", r"\bcomponent", r"\borganiz", r"\blayer", r"\brelationship",
        r"\bhow\s+(?:does|do|is)\s+(?:the\s+)?(?:project|app|system|code)", r"\bproject\s+(?:structure|layout|organization)", r"\bdirectory", r"\boverview",
        r"\bhigh[\s-]level", r"\bwhere\s+(?:is|are|does|do)", r"\bwhat\s+(?:is|are)\s+the\s+(?:main|key|core)", r"\bhow\s+.*\bwork", r"\bflow\b", r"\bpipeline",
        r"\bmiddleware", r"\brouting", r"\bdependenc",
    ),
    "logic": (
        r"\bfunction\b", r"\bmethod\b", r"\bclass\b", r"\bimplement", r"\balgorithm", r"\bbug\b", r"\berror\b", r"\bfix\b", r"\breturn\b", r"\bparameter", r"\bargument",
        r"\btype[\s-](?:hint|annotation|error|check)", r"\bwhat\s+does\s+(?:this|the)\s+(?:function|method|code)", r"\bhow\s+does\s+(?:this|the)\s+(?:function|method|code)",
        r"\bwhy\s+(?:does|do|is)", r"\bexception", r"\bvalidat", r"\bpars", r"\btransform", r"\bcallback", r"\basync\b", r"\bawait\b", r"\brecurs", r"\bloop\b",
    ),
    "deployment": (
        r"\bdeploy", r"\bdocker", r"\bcontainer", r"\bci[\s/]cd", r"\bgithub.action", r"\bkubernetes", r"\bk8s", r"\benvironment", r"\bconfig(?:ur)?", r"\binstall\b",
        r"\bsetup\b", r"\bbuild\b", r"\bpackage", r"\bpip\b", r"\bnpm\b", r"\byarn\b", r"\bgradle", r"\bmaven", r"\bmakefile", r"\bvenv\b", r"\brequirements", r"\bserver\b",
        r"\bversion\b", r"\bmigrat", r"\bdatabase\b", r"\b\.env\b",
    ),
}
# Retrieval depth and list weights per question type; a null filter searches everything.
STRATEGIES = (
    ("architecture", 15, 10, None, 1.5, 0.5),
    ("logic", 15, 15, "chunk", 1.0, 1.5),
    ("deployment", 10, 15, None, 1.0, 1.0),
)
STRATEGY_SCHEMA = "question_type string, semantic_k int, bm25_k int, doc_type_filter string, semantic_weight double, bm25_weight double"


def rrf_fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(question_id, doc_id, score, rank) of ranked (question_id, list_no, rank from 1, doc_id, weight).

    score = sum of weight / (k + rank); an id that a list repeats counts each time. Ties go to the id seen first (list,
    then rank).
    """
    fused = ranked.groupBy("question_id", "doc_id").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen")
    )
    w = W.partitionBy("question_id").orderBy(F.round("score", 12).desc(), "seen", "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).drop("seen")


def pattern_score(text: Column, kind: str) -> Column:
    return reduce(lambda a, b: a + b, [F.lower(text).rlike(p).cast("int") for p in QUESTION_PATTERNS[kind]])


def classify_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds the scores per type and question_type: the greatest score, ties in the order of the table, logic without any match."""
    out = questions
    for kind in QUESTION_PATTERNS:
        out = out.withColumn(f"{kind}_score", F.coalesce(pattern_score(F.col(question), kind), F.lit(0)))
    best = F.greatest(*[F.col(f"{k}_score") for k in QUESTION_PATTERNS])
    return out.withColumn(
        "predicted_type",
        F.when(best == 0, "logic").when(F.col("architecture_score") == best, "architecture").when(F.col("logic_score") == best, "logic").otherwise("deployment"),
    )


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRATEGIES), STRATEGY_SCHEMA)


def route(questions: DataFrame, question_type: str = "question_type") -> DataFrame:
    """Joins the strategy of each question's type; unknown and null types take that of logic."""
    table = F.broadcast(strategies(questions.sparkSession))
    known = F.when(F.col(question_type).isin(*[s[0] for s in STRATEGIES]), F.col(question_type)).otherwise("logic")
    return questions.withColumn("_route", known).join(table.withColumnRenamed("question_type", "_route"), "_route").withColumnRenamed("_route", "strategy")
