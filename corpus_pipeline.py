"""The training-text pipeline over documents: quality, near copies, repeated passages, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslink.llm.common import materialize
from corpuslink.llm.mixing import mixture
from corpuslink.llm.packing import pack
from corpuslink.llm.quality import measures, passing
from corpuslink.llm.simhash import near_duplicates
from corpuslink.llm.substrings import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule.

    Repeated rows are judged each; a null, empty or very short text goes; other columns of docs are not handed on.
    """
    return passing(measures(docs, keep=COLUMNS)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Rows of one doc_id are one document, of which the least row by its columns stays, so that a document that came twice
    isn't taken for two that repeat each other. Rows without doc_id are one document for each text, and stay only if no
    copy has a doc_id. Null and empty texts are copies of each other.
    """
    unnamed = F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)  # beyond the ids, so that these stay
    keyed = docs.select(*COLUMNS).withColumn("_key", F.coalesce(F.col("doc_id"), unnamed))
    again = materialize(keyed.groupBy("_key").count().where("count > 1").select("_key"))
    one = keyed.join(again, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*", "_key")
    single = keyed.join(again, "_key", "left_anti").select(*COLUMNS, "_key").union(one)
    gone = materialize(near_duplicates(single, 5, 0.8, key="_key").where("doc_id <> component_id").select(F.col("doc_id").alias("_key")))
    return single.join(gone, "_key", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that occur again; those that consist of nothing else go.

    A null or empty text stays as an empty one. Rows that repeat each other lose all their words: the stage before keeps one
    row of each document.
    """
    left = remove_repeats(docs, 35, keep=("lang", "source"), texts=True).where("n_words = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens whose sources, languages and topics have the target shares, as far as they hold enough.

    Rows of one doc_id stay or go together; a null source or language is the empty one; texts without tokens go by their
    cell as others do.
    """
    return mixture(docs, keep=COLUMNS).where("kept").select(*[F.col(f"k_{c}").alias(c) for c in COLUMNS])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens. A null or empty text is one end token."""
    return pack(docs, 1024)


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: Fingerprints, windows and token ids aren't within reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
