"""Folders of files in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("pdf", "docx", "pptx", "md", "txt")


def _named(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("file_name", name).withColumn("file_type", F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, file_type and length of the files directly in a folder whose kind can be read, by name. Contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return _named(files).where(F.col("file_type").isin(*KINDS)).orderBy("file_name")


def text_documents(files: DataFrame) -> DataFrame:
    """name, file_type, md5 and text of the .txt and .md files (path, content); bytes that aren't UTF-8 become U+FFFD."""
    f = _named(files).where(F.col("file_type").isin("txt", "md"))
    name = F.regexp_replace("file_name", r"\.[^.]+$", "")
    return f.select("path", name.alias("name"), "file_type", F.md5("content").alias("md5"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    return text_documents(spark.read.format("binaryFile").load(path).select("path", "content"))


def source_bucket(key: str, buckets: int = 64):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, key: str = "source_id", buckets: int = 64) -> None:
    """A table in buckets of its sources. What is written replaces the buckets that it has rows of, and no others.

    One file group per bucket: the rows are dealt by bucket first, so that tasks don't each open all of them.
    """
    dealt = df.withColumn("bucket", source_bucket(key, buckets)).repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str, keys: list | None = None, key: str = "source_id", buckets: int = 64) -> DataFrame:
    """The table; with keys only their buckets are read."""
    df = spark.read.parquet(path)
    if keys is None:
        return df.drop("bucket")
    wanted = spark.createDataFrame([(k,) for k in keys], df.select(key).schema).select(source_bucket(key, buckets).alias("b")).distinct()
    return df.where(F.col("bucket").isin([r.b for r in wanted.collect()]) & F.col(key).isin(keys)).drop("bucket")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
