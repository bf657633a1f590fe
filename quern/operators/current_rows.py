"""Deduplication and set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def first_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key (vector store semantics)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def last_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key (id resolution semantics)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, with the side; counted with repetitions."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def with_ordinal(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the position of each row (from 0) in the total order of the columns, without one task for all rows.

    Rows are partitioned by range, numbered within their partition, and shifted by the sizes of the partitions before.
    The ranges are sampled, so they are kept by a checkpoint before both steps read them. Pass narrow rows.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_base", F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).drop("_size")
    inside = W.partitionBy("_part").orderBy(*order)
    return ranged.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(before), "_part").withColumn(name, F.col("_base") + F.col("_n") - 1).drop("_part", "_n", "_base")
