"""What models answer: parsing with defaults, variants of queries, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, strip_code_fences

# Precedence and weights of the variants of a query.
VARIANTS = ("original", "hyde", "expanded", "step_back", "decomposed")
WEIGHTS = {"original": 1.0, "decomposed": 1.0, "expanded": 0.85, "step_back": 0.75, "hyde": 0.65}
# The fields of a document profile and their defaults.
DEFAULT_PROFILE = {
    "structure_type": "unstructured", "heading_consistency": "none", "content_density": "uniform", "primary_content_type": "prose",
    "avg_section_length": "medium", "has_tables": False, "has_code_blocks": False, "domain": "general",
}
PROFILE = ", ".join(f"{k} {'boolean' if v is False else 'string'}" for k, v in DEFAULT_PROFILE.items())


def _objects(text: Column) -> Column:
    """The objects of a JSON array, or of the first array among an object's values, as texts; none on any error."""
    clean = strip_code_fences(text)
    direct = F.from_json(clean, "array<string>")
    nested = F.get(F.filter(F.transform(F.map_values(F.from_json(clean, "map<string,string>")), lambda v: F.from_json(v, "array<string>")), lambda a: a.isNotNull()), F.lit(0))
    found = F.when(F.startswith(clean, F.lit("[")), direct).otherwise(nested)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.startswith(F.ltrim(x), F.lit("{")))


def parse_entities(text: Column) -> Column:
    """[{name, type, aliases}] of an answer."""
    return F.filter(F.transform(_objects(text), lambda x: F.from_json(x, "name string, type string, aliases array<string>")), lambda e: e["name"].isNotNull())


def parse_relationships(text: Column, least: float = 0.75) -> Column:
    """[{source, target, type, confidence}] with at least the confidence; a missing one counts as 0."""
    rows = F.transform(_objects(text), lambda x: F.from_json(x, "source string, target string, type string, confidence double"))
    return F.filter(rows, lambda r: F.coalesce(r["confidence"], F.lit(0.0)) >= least)


def parse_insights(text: Column) -> Column:
    """[{insight, topics}]: trimmed, blank ones dropped; topics that are no list are none."""
    whole = F.from_json(strip_code_fences(text), "insights array<string>")["insights"]
    rows = F.transform(F.coalesce(whole, F.array().cast("array<string>")), lambda x: F.from_json(x, "insight string, topics string"))
    topics = lambda r: F.filter(F.transform(F.coalesce(F.from_json(r["topics"], "array<string>"), F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(F.filter(rows, lambda r: F.trim(r["insight"]) != ""), lambda r: F.struct(F.trim(r["insight"]).alias("insight"), topics(r).alias("topics")))


def parse_profile(text: Column) -> Column:
    """The eight fields of a document profile, each with its default."""
    p = F.from_json(strip_code_fences(text), PROFILE)
    return F.struct(*(F.coalesce(p[k], F.lit(v)).alias(k) for k, v in DEFAULT_PROFILE.items()))


def parse_metadata(text: Column) -> Column:
    """kind, author, source and domain as a map, without those that are missing; empty on any error."""
    m = F.from_json(strip_code_fences(text), "map<string,string>")
    return F.map_filter(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: k.isin("kind", "author", "source", "domain") & v.isNotNull())


def parse_verdict(text: Column) -> Column:
    """The field pass; true if it is missing or on any error."""
    return F.coalesce(F.get_json_object(strip_code_fences(text), "$.pass").try_cast("boolean"), F.lit(True))


def normalize_variants(variants: DataFrame, insight_mode: bool = False) -> DataFrame:
    """query_id, name, text: of variants equal when normalized the one with the highest precedence; blanks dropped."""
    prio = F.coalesce(F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("name")), F.lit(99))
    v = variants.withColumn("norm", normalize_text(F.col("text"))).where("norm <> ''")
    if insight_mode:
        v = v.where("name <> 'decomposed'")
    w = Window.partitionBy("query_id", "norm").orderBy(prio, "pos")
    return v.withColumn("k", F.row_number().over(w)).where("k = 1").select("query_id", "name", "pos", "text")


def variant_weight(name: Column) -> Column:
    out = F.lit(1.0)
    for k, w in WEIGHTS.items():
        out = F.when(name == k, w).otherwise(out)
    return out


def select_names(candidates: DataFrame, selected: DataFrame, n: int = 5) -> DataFrame:
    """The first n candidates (group_id, rank, name) that were selected; of a group without a selection simply the first n."""
    chosen = selected.select("group_id", "name").distinct().withColumn("hit", F.lit(True))
    known = selected.select("group_id").distinct().withColumn("asked", F.lit(True))
    c = candidates.join(chosen, ["group_id", "name"], "left").join(known, "group_id", "left").where("hit or asked is null")
    w = Window.partitionBy("group_id").orderBy("rank", "name")
    return c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("group_id", "name", F.col("k").alias("place"))
