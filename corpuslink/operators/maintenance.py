"""Removal, cleaning and requeueing. Tables go in and come out; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import materialize, numbered
from .catalog import STAGES, live, sources_of_kind
from .insights import dedup_in_order, extract_insights, link_chunk_insights
from .vectors import embed, hashed_embedding


def drop_orphan_insights(insights: DataFrame, links: DataFrame) -> DataFrame:
    """Insights that some chunk still links to."""
    return insights.join(links.select("insight_id").distinct(), "insight_id", "left_semi")


def delete_sources(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """sources, jobs, chunks, mentions, links and insights without the sources (source_id) and what depends on them."""
    kept = {name: tables[name].join(gone, "source_id", "left_anti") for name in ("sources", "jobs", "chunks", "mentions")}
    lost = tables["chunks"].join(gone, "source_id", "left_semi").select("chunk_id")
    kept["links"] = tables["links"].join(lost, "chunk_id", "left_anti")
    lost_insights = tables["links"].join(lost, "chunk_id", "left_semi").select("insight_id").distinct()
    orphans = lost_insights.join(kept["links"].select("insight_id"), "insight_id", "left_anti")
    kept["insights"] = tables["insights"].join(orphans, "insight_id", "left_anti")
    return kept


def purge(tables: dict[str, DataFrame], kind: str, execute: bool = False, limit: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The live sources of a kind, and the tables without them and what depends on them; as they were unless execute is set."""
    found = sources_of_kind(tables["sources"], kind, limit)
    return found, delete_sources(tables, found.select("source_id")) if execute else tables


def soft_delete(sources: DataFrame, gone: DataFrame) -> DataFrame:
    marked = gone.select("source_id", F.lit(True).alias("_gone")).distinct()
    return sources.join(marked, "source_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def cleanup_from_stage(tables: dict[str, DataFrame], jobs: DataFrame) -> dict[str, DataFrame]:
    """chunks, mentions and links after jobs (source_id, stage) are to be run again from a stage, all jobs at once.

    Insight links always go; up to chunking the chunks and the graph; at validation and embedding the vectors and the graph;
    at graph extraction the graph.
    """
    index = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    at = jobs.select("source_id", index.alias("_at"))
    n = {s: k + 1 for k, s in enumerate(STAGES)}
    chunks = tables["chunks"].join(at, "source_id", "left")
    links = tables["links"].join(chunks.where("_at is not null").select("chunk_id"), "chunk_id", "left_anti")
    nulled = F.when(F.col("_at") <= n["embedding"], F.lit(None)).otherwise(F.col("embedding"))
    kept = chunks.where(F.col("_at").isNull() | (F.col("_at") > n["chunking"])).withColumn("embedding", nulled).drop("_at")
    mentions = tables["mentions"].join(at.where(F.col("_at") <= n["graph_extraction"]), "source_id", "left_anti")
    return {"chunks": kept, "mentions": mentions, "links": links}


def pending_insight_sources(sources: DataFrame, chunks: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """Live sources with live chunks of which none has an insight yet, newest first."""
    own = live(chunks).select("chunk_id", "source_id")
    linked = own.join(links, "chunk_id", "left_semi").select("source_id")
    return live(sources).join(own, "source_id", "left_semi").join(linked, "source_id", "left_anti").orderBy(F.desc("created_at"), "source_id").limit(limit)


def sources_to_rebuild(sources: DataFrame, chunks: DataFrame, links: DataFrame, force: bool = False) -> DataFrame:
    """Live sources whose insights are to be built: those without links, or all by force."""
    if force:
        return live(sources)
    linked = chunks.join(links, "chunk_id", "left_semi").select("source_id")
    return live(sources).join(linked, "source_id", "left_anti")


def rebuild_insights(
    tables: dict[str, DataFrame], asked: DataFrame, model: Callable[[list[str]], list[str]], embedder: Callable = hashed_embedding, *, force: bool = False, least: float = 0.95
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(links and insights as they are to be, source_id and skipped of the asked sources) after insights are built anew.

    tables: chunks (chunk_id, source_id, chunk_index, content, is_deleted), links (chunk_id, insight_id, topics) and
    insights (insight_id, content, embedding). A source that has links is skipped; by force its links go, then all
    insights without a link, and it is built like the others: the model reads its live chunks in their order, what it says
    is embedded, joins the nearest kept or stored insight from `least` on or is a new one, and is linked. New insights are
    numbered after the last one. Nothing is changed in place: commit both tables as one (`sources.snapshots`).
    """
    chunks, links, insights = tables["chunks"], tables["links"], tables["insights"]
    asked = asked.select("source_id").distinct()
    linked = chunks.join(links.select("chunk_id").distinct(), "chunk_id", "left_semi").select("source_id").distinct()
    has = materialize(asked.join(linked.withColumn("_has", F.lit(True)), "source_id", "left").select("source_id", F.coalesce("_has", F.lit(False)).alias("has")))
    todo, skipped = has, has.select("source_id", F.col("has").alias("skipped"))
    if force:
        skipped = has.select("source_id", F.lit(False).alias("skipped"))
        lost = chunks.join(has.where("has"), "source_id", "left_semi").select("chunk_id")
        if lost.limit(1).count():
            links = materialize(links.join(lost, "chunk_id", "left_anti"))
            insights = drop_orphan_insights(insights, links)
    else:
        todo = has.where("not has")
    insights = materialize(insights)
    said = extract_insights(live(chunks).join(todo, "source_id", "left_semi"), model)
    last = insights.agg(F.coalesce(F.max("insight_id"), F.lit(-1).cast("long"))).first()[0]
    said = numbered(said, "source_id", "seq").withColumn("number", (F.col("place") + last).cast("long"))
    said = materialize(embed(said.select("chunk_id", "number", "insight", "topics"), "insight", embedder))
    store = insights.select(F.col("insight_id").alias("seq"), F.col("embedding").alias("vector"))
    joined = materialize(dedup_in_order(said.select(F.col("number").alias("seq"), F.col("embedding").alias("vector")), least, store))
    of = said.join(joined.select(F.col("seq").alias("number"), F.col("insight_seq").alias("insight_id"), "is_new"), "number")
    kept = insights.select("insight_id", "content", "embedding").unionByName(of.where("is_new").select("insight_id", F.col("insight").alias("content"), "embedding"))
    upserted = link_chunk_insights(links.select("chunk_id", "insight_id", "topics", F.lit(-1).cast("long").alias("seq")).unionByName(of.select("chunk_id", "insight_id", "topics", F.col("number").alias("seq"))))
    return {"links": upserted, "insights": kept}, skipped


def drop_edge_types(edges: DataFrame, types: tuple[str, ...] = ("RELATED_TO", "MENTIONED_IN")) -> DataFrame:
    return edges.where(~F.col("type").isin(*types))


def requeue(jobs: DataFrame, affected: DataFrame, stage: str) -> DataFrame:
    """Completed jobs of the affected sources, pending again from a stage."""
    hit = affected.select("source_id", F.lit(True).alias("_hit")).distinct()
    j = jobs.join(hit, "source_id", "left").withColumn("_go", F.coalesce("_hit", F.lit(False)) & (F.col("status") == "completed"))
    return j.select(
        "job_id", "source_id", F.when(F.col("_go"), "pending").otherwise(F.col("status")).alias("status"),
        F.when(~F.col("_go"), F.col("current_stage")).alias("current_stage"), F.when(F.col("_go"), stage).alias("retry_from"),
    )
