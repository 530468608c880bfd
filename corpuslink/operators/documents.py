"""Arriving documents: fingerprints, metadata, image references and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
WHOLE_IMAGE = r"!\[[^\]]*\]\([^)]+\)"
PLACEHOLDER = "<!-- image -->"
IMAGE_TYPES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "svg")


def submit(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its MD5 and what becomes of it: accepted, or rejected for a live source with the same bytes.

    Within a batch the first by (arrived_at, doc_id) wins, and the others are rejected for it. docs: doc_id, content,
    arrived_at; sources: source_id, md5, is_deleted.
    """
    return submit_by_md5(docs.withColumn("md5", F.md5(F.col("content").cast("binary"))), sources)


def submit_by_md5(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """`submit` of documents whose MD5 is known (doc_id, md5, arrived_at).

    Copies of one content are not gathered: the first one is a partial minimum for each MD5, and joined back. Null contents
    are copies of each other; rows of one doc_id are one document.
    """
    live = sources.where("not is_deleted").groupBy("md5").agg(F.min("source_id").alias("live_id"))
    first = docs.groupBy(F.col("md5").alias("_md5")).agg(F.min(F.struct("arrived_at", "doc_id"))["doc_id"].alias("winner"))
    d = docs.select("doc_id", "md5").join(first, F.col("md5").eqNullSafe(F.col("_md5"))).join(live, "md5", "left")
    existing = F.coalesce("live_id", F.when(F.col("doc_id") != F.col("winner"), F.col("winner")))
    return d.select("doc_id", "md5", existing.isNull().alias("accepted"), existing.alias("existing_id"))


def merge_metadata(extracted: Column, submitted: Column) -> Column:
    """Both maps; where both have a key, even as null, the submitted value stands."""
    return F.map_from_entries(
        F.concat(
            F.map_entries(F.map_filter(extracted, lambda k, v: ~F.array_contains(F.map_keys(submitted), k))), F.map_entries(submitted)
        )
    )


def image_refs(docs: DataFrame) -> DataFrame:
    """doc_id, pos, target and kind (remote, local or unsupported) of each Markdown image, in order."""
    refs = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(IMAGE), 1)).alias("pos", "target"))
    remote = F.col("target").rlike(r"^(?:https?://|data:)")
    known = F.lower(F.regexp_extract("target", r"\.([A-Za-z0-9]+)$", 1)).isin(*IMAGE_TYPES)
    return refs.withColumn("kind", F.when(remote, "remote").when(known, "local").otherwise("unsupported"))


def inline_image_text(docs: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Each reference with a description (doc_id, pos, description) replaced by it, the others left as they are."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", WHOLE_IMAGE, -1)).alias("pos", "part"))
    marks = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(WHOLE_IMAGE), 0)).alias("pos", "mark"))
    kinds = image_refs(docs).select("doc_id", "pos", "kind")
    filled = (
        parts.join(marks, ["doc_id", "pos"], "left").join(kinds, ["doc_id", "pos"], "left").join(descriptions, ["doc_id", "pos"], "left")
        .withColumn("piece", F.concat("part", F.when((F.col("kind") == "local") & F.col("description").isNotNull(), F.col("description")).otherwise(F.coalesce("mark", F.lit("")))))
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"])
    return filled.groupBy("doc_id").agg(F.array_join(ordered, "").alias("text"))


def fill_image_placeholders(text: Column, descriptions: Column) -> Column:
    """The n-th description that isn't null stands for the n-th placeholder; placeholders beyond them stay."""
    good = F.filter(descriptions, lambda d: d.isNotNull())
    parts = F.split(text, PLACEHOLDER)
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(good, i - 1), F.lit(PLACEHOLDER)), p))), ""
    )


def line_outline(text: Column) -> Column:
    """`_root_`, the first heading as title if there is one, then the lines that aren't blank, numbered from 2."""
    lines = F.split(text, "\n")
    title = F.get(F.filter(lines, lambda x: F.ltrim(x).startswith("#")), F.lit(0))
    titled = F.when(title.isNotNull(), F.array(F.trim(F.ltrim(F.trim(title), F.lit("#"))))).otherwise(F.array().cast("array<string>"))
    body = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x, i: F.concat((i + 2).cast("string"), F.lit(": "), F.trim(x)))
    return F.array_join(F.concat(F.array(F.lit("_root_")), titled, body), "\n")


def with_parents(chunks: DataFrame) -> DataFrame:
    """parent_chunk_id from the local index of the parent (parent_index) within the source."""
    parents = chunks.select("source_id", F.col("chunk_index").alias("parent_index"), F.col("chunk_id").alias("parent_chunk_id"))
    return chunks.join(parents, ["source_id", "parent_index"], "left")


def audit_rows(rows: DataFrame, action: str, resource_type: str, resource_id: str, metadata: dict[str, str]) -> DataFrame:
    """Rows of the append-only audit log; metadata: name of the entry -> column."""
    entries = [x for k, c in metadata.items() for x in (F.lit(k), F.col(c).cast("string"))]
    return rows.select(F.lit(action).alias("action"), F.lit(resource_type).alias("resource_type"), F.col(resource_id).cast("string").alias("resource_id"), F.create_map(*entries).alias("metadata"))
