"""JSON, JSON-lines and CSV interchange of chunks, summaries, graphs, datasets and results; Parquet stays the inner form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "struct<repo_path:string,abs_path:string,language:string,size_bytes:bigint,raw_content:string>"
CHUNK_JSON = f"id string, file_record {FILE}, content string, chunk_type string, start_line int, end_line int, symbol_name string, token_count int, language string"
SUMMARY_JSON = "id string, level string, path string, content string, source_ids array<string>, token_count int, language string"
PAIR = "struct<id:string,repo_name:string,repo_url:string,language:string,question:string,answer:string,question_type:string,issue_url:string,issue_number:bigint,answer_score:int,reference_contexts:array<string>>"
DATASET_JSON = f"name string, version string, qa_pairs array<{PAIR}>, metadata map<string,string>"
SCORES = "accuracy_mean:double,accuracy_std:double,completeness_mean:double,completeness_std:double,relevance_mean:double,relevance_std:double,clarity_mean:double,clarity_std:double,n_runs:int"
RESULT_JSON = (
    "type string, config string, qa_id string, question string, question_type_expected string, question_type_predicted string, classifier_correct boolean, answer string, "
    f"confidence string, retrieval_recall double, citation_accuracy double, n_citations int, n_citations_verified int, gen_latency_s double, error string, judge struct<{SCORES}>"
)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks exported as one JSON array or as JSON lines, with the nested file record flattened."""
    rows = spark.read.schema(CHUNK_JSON).option("multiLine", "true").json(path)
    return rows.select("id", F.col("file_record.repo_path").alias("repo_path"), "content", "chunk_type", "start_line", "end_line", "symbol_name", "token_count", F.coalesce("language", "file_record.language").alias("language"))


def chunks_for_export(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks in the nested form of the interchange files."""
    f = files.select("repo_name", "repo_path", F.struct("repo_path", "abs_path", "language", "size_bytes", "raw_content").alias("file_record"))
    return chunks.join(f, ["repo_name", "repo_path"]).select("id", "file_record", "content", "chunk_type", "start_line", "end_line", "symbol_name", "token_count", "language")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_JSON).option("multiLine", "true").json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Question pairs of dataset files, one row each."""
    return spark.read.schema(DATASET_JSON).option("multiLine", "true").json(path).select(F.explode("qa_pairs").alias("p")).select("p.*")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, ord, dst) of a graph file: an object of path -> list of paths under 'edges'."""
    rows = spark.read.schema("edges map<string,array<string>>, raw_imports map<string,array<string>>").option("multiLine", "true").json(path)
    return rows.select(F.explode("edges").alias("src", "targets")).select("src", F.posexplode("targets").alias("ord", "dst"))


def graph_for_export(edges: DataFrame) -> DataFrame:
    """One row: edges as a map of path -> list of paths in import order. The interchange form is one object per
    repository; keep the edges table itself for anything larger."""
    per = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("targets"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "targets")))).alias("edges"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Experiment results of JSON-lines files: the header and failed rows are left out."""
    return spark.read.schema(RESULT_JSON).json(path).where("type = 'result' and error is null")


def write_results(results: DataFrame, path: str) -> None:
    results.withColumn("type", F.lit("result")).write.mode("append").json(path)


def write_scores_csv(table: DataFrame, path: str, digits: int = 3) -> None:
    """CSV with a header; doubles with a fixed number of digits."""
    columns = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes]
    table.select(*columns).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
