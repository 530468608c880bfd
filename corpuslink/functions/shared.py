"""Tables between the rounds of iterative operators, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all executors share; below /tmp/checkpoints where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/corpuslink/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read back.

    It cuts the lineage: a lost executor costs the re-reading of a file, not of the jobs before it. The files stay until
    the folder of the application is removed.
    """
    spark, path = df.sparkSession, workspace(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """The rows with their numbers from 1 in an order that should have no ties.

    Ranges of the order are numbered in tasks of their own and then moved by the sizes of the ranges before them, so that the
    rows are never ordered in one task; what is broadcast is one number for each range, as many as there are shuffle partitions.
    The ranges are written to the shared folder once, so that both steps see the same ones.
    """
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_own", own).join(F.broadcast(first), "_range").select(*df.columns, (F.col("_first") + F.col("_own")).alias(name))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of the edges (a, b): the smallest id that can be reached.

    Alternating large-star and small-star rounds over DataFrames (Kiveris et al., 2014). Each round shuffles the edges
    by id; the smallest neighbour is a partial aggregate, so that the hub of a large component isn't gathered into one
    task. Every round is written to the shared folder. No ids or edges come to the driver, only their number and a hash.
    Self edges and repeated edges change nothing; an empty table gives an empty table.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    last = None
    for _ in range(max_rounds):
        e = materialize(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components have not settled")
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
        e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    kept = e.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return kept.union(own).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
