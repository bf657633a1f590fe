"""Registered queries of the core; their SQL counterparts are in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.languages import file_type
from .functions.text import lexical_tokens, short_hash, token_count
from .operators import chunking, citations, evaluation, fusion, imports, index, lexical, mining, packing, summaries, validation, vectors
from .operators.current import current_files
from .operators.current_rows import symmetric_difference
from .oracles import ORACLE_SQL
from .plans.answering import ask
from .plans.hybrid import hybrid_topk as hybrid
from .session import spread, table
from .streaming.incremental import event_windows as windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["ORACLE_SQL", "QUERIES"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _none(column: str):
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("none"))


def _questions(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: items whose id is divisible by 50, against all documents."""
    return table(s, d, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").dropDuplicates(["seq"])


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return mining.newest_pairs(table(s, d, "qa_pairs"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return imports.resolve_imports(imports.raw_targets(table(s, d, "raw_imports")), table(s, d, "files").select("repo_name", "repo_path"))


@query
def file_types(s, d):
    now = current_files(table(s, d, "files"))
    return now.groupBy("repo_name", file_type(F.col("repo_path")).alias("file_type")).agg(F.count("*").alias("n_files"), F.sum(F.coalesce(F.length("raw_content"), F.lit(0))).alias("n_chars"))


@query
def file_state(s, d):
    return current_files(table(s, d, "files")).select("repo_name", "repo_path", F.length("raw_content").alias("n_chars"), F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss").alias("crawled_at"))


@query
def doc_tokens(s, d):
    return _documents(s, d).select("doc_id", token_count(F.col("text")).alias("n_tokens"), F.coalesce(F.size(lexical_tokens(F.col("text"))), F.lit(0)).alias("n_lexical"))


@query
def term_stats(s, d):
    return lexical.term_stats(_documents(s, d), "doc_id", "text").withColumn("idf", F.round("idf", 6))


@query
def bm25_topk(s, d):
    return lexical.top_k(lexical.bm25_scores(_documents(s, d), _questions(s, d)), 10).withColumn("score", F.round("score", 6))


def _vectors(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return v, v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("question_id"), "embedding")


@query
def knn_topk(s, d):
    v, q = _vectors(s, d)
    return vectors.cosine_topk(v, q, 10).withColumn("score", F.round("score", 6))


@query
def knn_filtered(s, d):
    v, q = _vectors(s, d)
    return vectors.cosine_topk(v, q, 10, where=F.col("label") == 3).withColumn("score", F.round("score", 6))


@query
def knn_ivf(s, d):
    """The inverted-file index: every row indexed, the nearest three quarters of the lists probed (the vectors have little structure)."""
    v, q = _vectors(s, d)
    c = vectors.fit_centroids(v, 16)
    return vectors.ivf_topk(vectors.build_ivf(v, c), c, q, 10, probes=12)


@query
def hybrid_topk(s, d):
    return hybrid(_documents(s, d), _questions(s, d)).withColumn("score", F.round("score", 9))


@query
def question_types(s, d):
    typed = fusion.classify_questions(_pairs(s, d))
    return typed.groupBy(_none("question_type").alias("question_type"), "predicted_type").agg(F.count("*").alias("n"))


@query
def import_edges(s, d):
    return _edges(s, d)


@query
def import_degrees(s, d):
    return imports.importers(_edges(s, d))


@query
def import_neighbors(s, d):
    return imports.neighbors(_edges(s, d))


@query
def graph_summary(s, d):
    return imports.graph_summary(_edges(s, d))


@query
def extracted_imports(s, d):
    """Import targets read from the files themselves."""
    return imports.extract_imports(current_files(table(s, d, "files")), go_blocks=True)


@query
def markdown_sections(s, d):
    return chunking.sections(current_files(table(s, d, "files"), F.lower("repo_path").endswith(".md")))


@query
def uncovered_lines(s, d):
    return chunking.uncovered_islands(current_files(table(s, d, "files")), table(s, d, "chunks"))


@query
def chunked_files(s, d):
    return chunking.chunk_files(current_files(table(s, d, "files")))


@query
def chunk_stats(s, d):
    rows = _chunks(s, d).select("chunk_type", _none("language").alias("language"), token_count(F.col("content")).alias("n"))
    return rows.groupingSets([["chunk_type"], ["language"], []], "chunk_type", "language").agg(F.grouping_id().alias("grouping"), F.count("*").alias("n_chunks"), F.sum("n").alias("n_tokens"))


@query
def chunk_ids(s, d):
    same = short_hash(F.col("repo_path"), F.col("start_line")) == F.col("id")
    return _chunks(s, d).groupBy("repo_name").agg(F.count("*").alias("n_chunks"), F.count_if(same).alias("n_equal"), F.countDistinct("id").alias("n_ids"))


@query
def first_last_by_id(s, d):
    return table(s, d, "chunks").groupBy("id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).where("first_seq <> last_seq")


def _sized(s, d):
    return _chunks(s, d).where("content is not null").withColumn("n", token_count(F.col("content")))


@query
def pack_prefix(s, d):
    by = ["repo_name", "repo_path"]
    kept = packing.pack_prefix(_sized(s, d).select(*by, "seq", "n"), by, ["seq"], "n", 800)
    return kept.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.max("used").alias("used"))


@query
def pack_skip(s, d):
    kept = packing.pack_skip(_sized(s, d).select("repo_name", "repo_path", "seq", "n"), ["repo_name", "repo_path"], ["seq"], "seq", "n", 600)
    return kept.select("repo_name", "repo_path", F.size("items").alias("n_chunks"), "used")


@query
def citation_coverage(s, d):
    answers = _pairs(s, d).where("size(reference_contexts) > 0").select("id", "repo_name", F.array_join(F.transform("reference_contexts", lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ").alias("answer"))
    cited = citations.extract_citations(answers).join(answers.select(F.col("id").alias("answer_id"), "repo_name"), "answer_id")
    return citations.coverage(citations.verify_citations(cited, table(s, d, "chunks"), ["repo_name"]))


@query
def gold_hits(s, d):
    """Suffix join of gold paths with files: equality on the file name, the suffix as residual condition."""
    gold = _pairs(s, d).where("size(reference_contexts) > 0").select("id", "repo_name", F.explode("reference_contexts").alias("c")).select("id", "repo_name", F.regexp_replace("c", ":.*$", "").alias("path"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    files = current_files(table(s, d, "files")).select("repo_name", "repo_path", base("repo_path").alias("name"))
    slash = lambda c: F.concat(F.lit("/"), c)
    near = (F.col("repo_path") == F.col("path")) | F.endswith("repo_path", slash(F.col("path"))) | F.endswith("path", slash(F.col("repo_path")))
    joined = gold.withColumn("name", base("path")).join(files, ["repo_name", "name"], "left")
    return joined.groupBy("id", "path").agg(F.coalesce(F.max(near), F.lit(False)).alias("hit"))


@query
def keywords(s, d):
    return _pairs(s, d).where("answer is not null").select("id", evaluation.reference_keywords(F.col("answer")).alias("keywords"))


@query
def keyword_recall(s, d):
    rows = _pairs(s, d).where("answer is not null").withColumn("r", evaluation.keyword_recall(evaluation.reference_keywords(F.col("answer")), F.col("question")))
    return rows.groupBy("repo_name").agg(F.count("*").alias("n"), F.round(F.avg("r"), 9).alias("mean_recall"))


@query
def grounding_totals(s, d):
    rows = _pairs(s, d).where("answer is not null")
    found = evaluation.grounding(rows.select("id", _none("question_type").alias("level"), F.col("answer").alias("content")), rows.select("id", F.col("question").alias("text")), ["id"])
    return evaluation.grounding_totals(found).withColumn("grounded", F.round("grounded", 9))


@query
def config_stats(s, d):
    t = evaluation.aggregate_by(table(s, d, "events"), ["event_type"], ["value"])
    return t.withColumn("value_mean", F.round("value_mean", 6)).withColumn("value_std", F.round("value_std", 6))


@query
def config_pivot(s, d):
    t = evaluation.pivot_mean_std(table(s, d, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"], "value")
    return t.select("user_id", *[F.round(c, 6).alias(c) for c in t.columns if c != "user_id"])


@query
def config_deltas(s, d):
    m = table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    return evaluation.config_deltas(m, "event_type", "view", "v").select("event_type", F.round("delta", 6).alias("delta"))


@query
def event_windows(s, d):
    return windows(table(s, d, "events")).withColumn("mean_value", F.round("mean_value", 6))


@query
def json_keys(s, d):
    return table(s, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query
def dataset_summary(s, d):
    return mining.dataset_summary(table(s, d, "qa_pairs"), F.coalesce("language", F.lit("none")), _none("question_type"))


@query
def curated_pairs(s, d):
    return mining.curated(_pairs(s, d)).select("id", "repo_name", "answer_score")


@query
def paths_difference(s, d):
    key = ["repo_name", "repo_path"]
    return symmetric_difference(table(s, d, "files").select(*key).distinct(), table(s, d, "chunks").select(*key).distinct())


@query
def folder_rollup(s, d):
    return summaries.folder_rollup(table(s, d, "chunks"))


@query
def largest_chunks(s, d):
    w = W.partitionBy("chunk_type").orderBy(F.desc("n"), "seq")
    return _sized(s, d).select("chunk_type", "seq", "n").withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@query
def hierarchical_summaries(s, d):
    return summaries.summarize(table(s, d, "chunks"))


@query
def answered_questions(s, d):
    return ask(table(s, d, "chunks"), _questions(s, d))


@query
def index_rows(s, d):
    """The export form of the chunk rows of the index: first of each id, sentinels for nulls."""
    rows = index.with_sentinels(index.chunk_rows(table(s, d, "chunks")))
    return rows.select("repo_name", "id", "seq", "doc_type", "chunk_type", "file_path", "language", "start_line", "end_line", "symbol_name", "summary_level")


@query
def built_index(s, d):
    """Chunks and summaries with hashed vectors, by kind."""
    chunks = table(s, d, "chunks")
    rows = index.build_index(chunks, summaries.summarize(chunks))
    return rows.groupBy("repo_name", "doc_type").agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNotNull()).alias("n_embedded"))


@query
def summary_checks(s, d):
    chunks = table(s, d, "chunks")
    return validation.pass_rates(validation.level_checks(summaries.summarize(chunks), validation.source_texts(chunks)))


@query
def gold_coverage(s, d):
    place = lambda g: F.regexp_extract("c", r"^(.*?)(?::(\d+)(?:-(\d+))?)?$", g)
    refs = _pairs(s, d).where("size(reference_contexts) > 0").select(F.col("id").alias("qid"), "repo_name", F.explode("reference_contexts").alias("c"))
    lo = F.nullif(place(2), F.lit("")).cast("int")
    gold = refs.select("qid", "repo_name", place(1).alias("path"), lo.alias("lo"), F.coalesce(F.nullif(place(3), F.lit("")).cast("int"), lo).alias("hi"))
    return validation.gold_coverage(gold, table(s, d, "chunks"))


@query
def retrieval_modes(s, d):
    """Keyword recall of the texts that each retrieval mode finds for the stated queries."""
    docs, asked = _documents(s, d), _questions(s, d)
    modes = {"hybrid": {}, "semantic": {"use_bm25": False}, "bm25": {"use_semantic": False}}
    found = None
    for name, flags in modes.items():
        hits = hybrid(docs, asked, 8, **flags).select(F.lit(name).alias("mode"), "question_id", "doc_id")
        found = hits if found is None else found.unionByName(hits)
    texts = found.join(docs, "doc_id").groupBy("mode", "question_id").agg(F.array_join(F.collect_list("text"), "\n").alias("corpus"))
    words = asked.select("question_id", evaluation.reference_keywords(F.col("question")).alias("kw"))
    return texts.join(words, "question_id").select("mode", "question_id", F.round(evaluation.keyword_recall(F.col("kw"), F.col("corpus")), 9).alias("recall"))
