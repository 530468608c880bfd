"""Arriving files and job events as streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.shared import materialize
from ..operators.chunking import semantic_chunks
from ..operators.documents import submit_by_md5
from ..operators.graph import extract_mentions
from ..operators.jobs import event_windows
from ..operators.vectors import embed, hashed_embedding


#: Files of any age are taken; by itself the file source leaves out those a week older than the newest one.
ANY_AGE = "36500d"


def arriving_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as they arrive, whatever their age. Whether a content has been there before is for `submit_batch` to say."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFileAge", ANY_AGE).load(path)
    return _documents(files)


def _documents(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(kind.isin("txt", "md")).select(
        F.sha2("path", 256).alias("source_id"), name.alias("name"), F.md5("content").alias("md5"),
        F.expr("make_valid_utf8(cast(content as string))").alias("text"), F.col("modificationTime").alias("arrived_at"),
    )


def process(docs: DataFrame, embedder: Callable = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, mentions) of documents; the ids follow from the content, so that a replay writes the same rows."""
    chunks = semantic_chunks(docs.select("source_id", "text"), "source_id")
    chunks = chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", "source_id", "chunk_index"), 256))
    return embed(chunks, "content", embedder), extract_mentions(chunks.select("chunk_id", "source_id", "content"))


def submit_batch(docs: DataFrame, known: str, n: int, live: DataFrame | None = None) -> DataFrame:
    """The documents of micro-batch n (source_id, md5, arrived_at, ...) with accepted and existing_id, and their MD5s added to the known ones.

    known: a table of (md5, source_id) in folders of the batch that wrote them and of the first two digits. A batch reads only the
    digits that it has itself, and only what earlier batches wrote; its own folder is replaced. So nothing is forgotten with
    time, a copy is rejected after any number of batches, and a replayed batch decides and writes the same again. Of equal
    contents within a batch the first by (arrived_at, source_id) wins. live: the sources (source_id) that still count; a
    content whose sources are all gone is accepted again.
    """
    spark = docs.sparkSession
    digits = F.substring("md5", 1, 2)
    seen = [r[0] for r in docs.select(digits.alias("d")).distinct().collect()]  # at most 256
    held = spark.createDataFrame([], "md5 string, source_id string")
    if seen:
        try:
            before = spark.read.schema("md5 string, source_id string, batch long, digits string").parquet(known)
            held = before.where((F.col("batch") < n) & F.col("digits").isin(seen)).select("md5", "source_id")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    if live is not None:
        held = held.join(live.select("source_id"), "source_id", "left_semi")
    told = materialize(submit_by_md5(docs.withColumnRenamed("source_id", "doc_id"), held.withColumn("is_deleted", F.lit(False))).withColumnRenamed("doc_id", "source_id"))
    accepted = told.where("accepted").select("md5", "source_id", F.substring("md5", 1, 2).alias("digits"))
    accepted.write.mode("overwrite").partitionBy("digits").parquet(f"{known}/batch={n}")
    return told


def ingest(docs: DataFrame, out: str, checkpoint: str, embedder: Callable | None = hashed_embedding, live: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Submit, chunk, embed and extract a stream of documents (source_id, name, md5, text, arrived_at).

    Each batch replaces its own folders, so that a replay changes nothing. `submitted` has every document with what became of
    it; chunks and mentions are made of the accepted ones only. Without an embedder the stream ends at the submission.
    """

    def batch(arrived: DataFrame, n: int) -> None:
        arrived = materialize(arrived)
        told = submit_batch(arrived, f"{out}/md5s", n, live() if live else None)
        told.write.mode("overwrite").parquet(f"{out}/submitted/batch={n}")
        taken = arrived.join(told.where("accepted").select("source_id"), "source_id", "left_semi")
        taken.write.mode("overwrite").parquet(f"{out}/sources/batch={n}")
        if embedder is not None:
            chunks, mentions = process(taken, embedder)
            chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={n}")
            mentions.write.mode("overwrite").parquet(f"{out}/mentions/batch={n}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, embedder: Callable = hashed_embedding) -> StreamingQuery:
    """`ingest` of the text files that arrive in a folder."""
    return ingest(arriving_documents(spark, path), out, checkpoint, embedder)


def stuck_job_alerts(events: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """job_id, stage and since of jobs that began a stage and sent nothing for so many minutes of event time.

    events: job_id, stage, state, updated_at (timestamp). State per job is its last event; a timer on event time ends it.
    """

    def watch(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            stage, since = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "since": [pd.Timestamp(since)]})
            return
        last = max((r for f in frames for r in zip(f["updated_at"], f["stage"], f["state"])), key=lambda r: r[0])
        if state.exists and pd.Timestamp(state.get[1]) > last[0]:
            return
        if last[2] == "processing":
            state.update((last[1], last[0].isoformat()))
            state.setTimeoutTimestamp(max(int(last[0].timestamp() * 1000) + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return events.withWatermark("updated_at", late).groupBy("job_id").applyInPandasWithState(
        watch, "job_id long, stage string, since timestamp", "stage string, since string", "append", GroupStateTimeout.EventTimeTimeout
    )


__all__ = ["arriving_documents", "process", "submit_batch", "ingest", "ingest_stream", "stuck_job_alerts", "event_windows"]
