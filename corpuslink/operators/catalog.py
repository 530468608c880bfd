"""Catalogue queries: filters, lists, counts and selections for repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADING, preview
from .documents import PLACEHOLDER

STAGES = ("parsing", "profiling", "chunking", "validation", "embedding", "graph_extraction", "graph_linking", "insight_extraction")


def live(table: DataFrame) -> DataFrame:
    """Rows that aren't softly deleted."""
    return table.where("not is_deleted")


def live_chunks(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks that a search may see: live, with a vector, of a live source whose job is completed."""
    seen = live(sources).where("job_status = 'completed'").select("source_id")
    return live(chunks).where("embedding is not null").join(seen, "source_id", "left_semi")


def in_sources(chunks: DataFrame, scope: DataFrame) -> DataFrame:
    """(query_id, chunk) of the chunks in each query's scope; a query whose scope has no source sees all.

    scope: query_id, source_id (null for a query without restriction).
    """
    some = scope.where("source_id is not null").select("query_id", "source_id").distinct()
    free = scope.select("query_id").distinct().join(some, "query_id", "left_anti")
    return chunks.join(some, "source_id").unionByName(_to_all(chunks, free))


#: Queries that see all rows together, and parts that the rows are dealt to for each such block of queries.
TOGETHER, PARTS = 1_000, 64


def _to_all(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """The chunks with each of the queries: blocks of queries meet parts of the chunks, neither side is broadcast."""
    blocks = max(1, -(-queries.count() // TOGETHER))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_part", every(PARTS))
    rows = chunks.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)).cast("int")).withColumn("_block", every(blocks))
    return rows.join(asking, ["_block", "_part"]).drop("_block", "_part")


def metadata_all(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """(query_id, row) for rows whose metadata has all pairs of the query: relational division. filters: query_id, key, value."""
    wanted = filters.distinct().groupBy("query_id").agg(F.count("*").alias("wanted"))
    pairs = rows.select("source_id", F.explode("metadata").alias("key", "value"))
    met = pairs.join(filters.distinct(), ["key", "value"]).groupBy("query_id", "source_id").agg(F.count("*").alias("met"))
    return met.join(wanted, "query_id").where("met = wanted").select("query_id", "source_id")


def metadata_any(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """(query_id, row) for rows whose metadata has any pair of the query."""
    pairs = rows.select("source_id", F.explode("metadata").alias("key", "value"))
    return pairs.join(filters, ["key", "value"]).select("query_id", "source_id").distinct()


def parse_filter(text: Column) -> Column:
    """`key=value` to a struct; without `=` an error text; blanks around both are dropped."""
    at = F.instr(text, "=")
    return F.struct(
        F.when(at > 0, F.trim(F.substring_index(text, "=", 1))).alias("key"),
        F.when(at > 0, F.trim(F.substring(text, at + 1, F.length(text)))).alias("value"),
        F.when(at == 0, F.concat(F.lit("no '=' in "), text)).alias("error"),
    )


def parse_pair(text: Column) -> Column:
    """`key:value` to a struct; null without a colon or with a blank key or value."""
    at = F.instr(text, ":")
    key, value = F.trim(F.substring_index(text, ":", 1)), F.trim(F.substring(text, at + 1, F.length(text)))
    return F.when((at > 0) & (key != "") & (value != ""), F.struct(key.alias("key"), value.alias("value")))


def jobs_by_status(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first. `failed` and `processing` match with any stage; without a status the last `limit` jobs."""
    if status is None:
        return jobs.orderBy(F.desc("updated_at"), "job_id").limit(limit)
    match = F.col("status").startswith(status + ":") | (F.col("status") == status) if status in ("failed", "processing") else F.col("status") == status
    return jobs.where(match).orderBy(F.desc("updated_at"), "job_id")


def sources_last(sources: DataFrame, n: int | None = None, since: str | None = None) -> DataFrame:
    rows = live(sources)
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    rows = rows.orderBy(F.desc("created_at"), "source_id")
    return rows if n is None else rows.limit(n)


def sources_of_kind(sources: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    rows = live(sources).where(F.col("kind") == kind).orderBy("created_at", "source_id")
    return rows if limit is None else rows.limit(limit)


def job_stats(jobs: DataFrame) -> DataFrame:
    """Jobs by status, with `failed:x` and `processing:x` as failed and processing."""
    return jobs.groupBy(F.substring_index("status", ":", 1).alias("status")).agg(F.count("*").alias("n"))


def list_sources(sources: DataFrame, chunks: DataFrame, links: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of live sources, newest first, with the distinct insights of their live chunks and the number of all."""
    rows = live(sources)
    counts = live(chunks).join(links, "chunk_id").groupBy("source_id").agg(F.countDistinct("insight_id").alias("n_insights"))
    page = rows.orderBy(F.desc("created_at"), "source_id").offset(offset).limit(limit)
    total = rows.agg(F.count("*").alias("total"))
    return page.join(counts, "source_id", "left").crossJoin(F.broadcast(total)).select(
        "source_id", "name", "created_at", F.coalesce("n_insights", F.lit(0)).alias("n_insights"), "total"
    )


def source_summary(sources: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Every live source with its number of insights and whether it has any."""
    counts = live(chunks).join(links, "chunk_id").groupBy("source_id").agg(F.countDistinct("insight_id").alias("n_insights"))
    n = F.coalesce("n_insights", F.lit(0))
    return live(sources).join(counts, "source_id", "left").select("source_id", "kind", n.alias("n_insights"), F.when(n > 0, "yes").otherwise("no").alias("has_insights"))


def source_insights(chunks: DataFrame, links: DataFrame, insights: DataFrame) -> DataFrame:
    """source_id, insight_id, chunk_id, chunk_index and preview of each insight of each live chunk."""
    return live(chunks).join(links, "chunk_id").join(insights.select("insight_id", F.col("content").alias("insight")), "insight_id").select(
        "source_id", "insight_id", "chunk_id", "chunk_index", preview(F.col("insight"), 80).alias("preview")
    )


def heading_only_sources(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per source and completed job, the chunks that are a single heading line."""
    alone = live(chunks).where(F.col("content").rlike(HEADING) & ~F.col("content").contains("\n")).groupBy("source_id").agg(F.count("*").alias("n"))
    done = jobs.where("status = 'completed'").groupBy("source_id", "job_id").agg(F.count("*").alias("times"))
    return alone.join(done, "source_id").select("source_id", "job_id", (F.col("n") * F.col("times")).alias("n_chunks"))


def image_placeholder_sources(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per source and completed job, the chunks with a placeholder: counted once for a source, before its jobs are joined."""
    left = live(chunks).where(F.col("content").contains(PLACEHOLDER)).groupBy("source_id").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return left.join(jobs.where("status = 'completed'").select("source_id", "job_id").distinct(), "source_id").select("source_id", "job_id", "n_chunks")


def insight_details(links: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Per insight, its sorted topics and the sources, live and completed, that it comes from."""
    seen = live(sources).where("job_status = 'completed'").select("source_id")
    rows = links.join(live(chunks).select("chunk_id", "source_id"), "chunk_id").join(seen, "source_id")
    topics = F.sort_array(F.array_distinct(F.flatten(F.collect_set("topics"))))
    return rows.groupBy("insight_id").agg(topics.alias("topics"), F.sort_array(F.collect_set("source_id")).alias("sources"))


def edge_type_counts(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges by relation type, with a zero for the types without any."""
    return types.join(edges.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def artifact_counts(sources: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks, entities and graph chunks that are left of each source; all zero after a clean removal."""
    n_chunks = chunks.groupBy("source_id").agg(F.count("*").alias("n_chunks"))
    graph = mentions.groupBy("source_id").agg(F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("chunk_id").alias("n_graph_chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.select("source_id").join(n_chunks, "source_id", "left").join(graph, "source_id", "left").select(
        "source_id", zero("n_chunks"), zero("n_entities"), zero("n_graph_chunks")
    )
