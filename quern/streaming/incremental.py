"""Streaming ingestion: file versions keep arriving, late and twice; the current state is kept per path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.current import current_files
from ..sources.store import VectorTable


def file_versions(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Stream of file versions from a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def keep_current(versions: DataFrame, table: VectorTable, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch's newest versions; an older version that arrives later does not win.

    The batch is reduced to one row per path first; only the repositories it touches are rewritten, and a replayed
    batch gives the same table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        new = current_files(batch)
        old = table.rows()
        if old is not None:
            same = old.drop("id").join(new.select("repo_name").distinct(), "repo_name", "left_semi")
            new = current_files(new.unionByName(same, allowMissingColumns=True))
        keyed = new.withColumn("id", F.sha2(F.concat_ws(":", "repo_name", "repo_path"), 256))
        table.upsert(keyed, "repo_path")

    return versions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts and means per window and type, with a watermark; the same expression serves batches and streams."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")
    )


def run(query: StreamingQuery, after: Callable[[], None] | None = None) -> None:
    query.awaitTermination()
    if after:
        after()
