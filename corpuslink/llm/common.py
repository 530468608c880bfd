"""What several operators share: shared tables, null handling, word splitting, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
BATCH = "8m"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def workspace(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all executors share; below /tmp/checkpoints where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/corpuslink/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read back.

    It cuts the lineage: a lost executor costs the re-reading of a file, not of the jobs before it. The files stay until
    the folder of the application is removed. What is sent to Python meanwhile goes in batches of BATCH, since an executor
    holds two or three of them outside of its heap for each task.
    """
    spark, path = df.sparkSession, workspace(df.sparkSession)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    spark.sparkContext._jvm.System.gc()  # what the write shuffled is no longer referred to, and Spark then removes it
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text (runs of anything but the six SPACES) as an array, in order."""
    return F.array_remove(F.split(text, r"[\x09-\x0D\x20]+"), "")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of the edges (a, b): the smallest id that can be reached.

    Alternating large-star and small-star rounds over DataFrames (Kiveris et al., 2014). Each round shuffles the edges
    by id; the smallest neighbour is a partial aggregate, so that the hub of a large component isn't gathered into one
    task. Every round is written to the shared folder. No ids or edges come to the driver, only their number and a sum.
    Self edges and repeated edges change nothing; an empty table gives an empty table.
    """
    e = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )
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
    return (
        both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    kept = e.join(least, "b")
    return (
        kept.select(F.col("m").alias("x"), F.col("a").alias("y"))
        .union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        .where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )
