"""The vector table: a Parquet table partitioned by repository, with upsert, delete and count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.current_rows import first_by


class VectorTable:
    """Rows keyed by (repo_name, id). Writes replace the partitions of the repositories they touch, and no others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        hadoop = self.spark._jsc.hadoopConfiguration()
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return self.spark.read.parquet(self.path) if p.getFileSystem(hadoop).exists(p) else None

    def upsert(self, rows: DataFrame, order: str, dedupe: bool = True) -> None:
        """Insert or replace by id; within the batch the first row of an id wins. Untouched repositories are not rewritten."""
        new = first_by(rows, ["repo_name", "id"], order) if dedupe else rows
        old = self.rows()
        merged = new
        if old is not None:
            touched = new.select("repo_name").distinct()
            kept = old.join(touched, "repo_name", "left_semi").join(new.select("repo_name", "id"), ["repo_name", "id"], "left_anti")
            merged = kept.unionByName(new, allowMissingColumns=True)
        self._replace(merged)

    def delete_repo(self, repo: str) -> None:
        old = self.rows()
        if old is None:
            return
        hadoop = self.spark._jsc.hadoopConfiguration()
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for d in old.where(F.col("repo_name") == repo).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("d")).distinct().collect():
            p = fs_path(d["d"])
            p.getFileSystem(hadoop).delete(p, True)

    def count(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()

    def _replace(self, rows: DataFrame) -> None:
        """Written aside first, as the table itself is being read, then moved in by a partition overwrite."""
        aside = f"{self.path}.{uuid.uuid4().hex}"
        # by repository, where Spark splits a large one and joins small ones
        rows.hint("rebalance", "repo_name").write.partitionBy("repo_name").parquet(aside)
        self.spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_name").parquet(self.path)
        hadoop = self.spark._jsc.hadoopConfiguration()
        p = self.spark._jvm.org.apache.hadoop.fs.Path(aside)
        p.getFileSystem(hadoop).delete(p, True)
