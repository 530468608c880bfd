"""Expansion of retrieved chunks: entity hops, neighbours, budgets, roll-up of scores and context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize
from ..functions.text import WORDS, TokenCounter, cosine, preview
from .ranking import Posted, first_stage, hybrid_search, insight_first_stage, ranked, rerank
from .vectors import dense_topk_by_ids, dense_topk_by_names, embed, hashed_embedding

KEY = ("query_id", "seed_id", "name", "type")
SECOND = (*KEY, "via_id", "name2", "type2")
#: Gives steps their own questions: (steps, column that names what is asked about) to the steps with text and vector.
Asks = Callable[[DataFrame, str], DataFrame]
#: Gives the links (src, dst, similarity) of the ids (id) asked for.
Links = Callable[[DataFrame], DataFrame]


def _named(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.col("chunk_id"), F.col("canonical_name").alias("name"), F.col("entity_type").alias("type")).distinct()


def seed_entities(seeds: DataFrame, mentions: DataFrame, n: int = 5) -> DataFrame:
    """query_id, seed_id, name, type and place of the first n entities, by name, that each seed mentions."""
    rows = seeds.select("query_id", F.col("id").alias("seed_id")).join(_named(mentions).withColumnRenamed("chunk_id", "seed_id"), "seed_id")
    w = Window.partitionBy("query_id", "seed_id").orderBy("name", "type")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(*KEY, "place")


def sub_queries(steps: DataFrame, queries: DataFrame, column: str = "name", embedder: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """The steps with text and vector of their own question: the query's text and what the column names. Each text is embedded once."""
    asked = steps.join(queries.select("query_id", F.col("text").alias("_t")), "query_id").withColumn("text", F.concat_ws(" ", "_t", column)).drop("_t")
    return asked.join(embed(asked.select("text").distinct(), "text", embedder, name="vector"), "text")


def first_hop(asks: DataFrame, mentions: DataFrame, corpus: DataFrame, n: int = 5, least: float = 0.5) -> DataFrame:
    """The n chunks nearest to the question among those that mention the entity; of those, all but the seed with at least the score.

    asks: query_id, seed_id, name, type and the vector of the question. Cut before filter.
    """
    best = dense_topk_by_names(asks, _named(mentions).withColumnRenamed("chunk_id", "id"), corpus, n, ("name", "type"), KEY)
    return best.where((F.col("score") >= least) & (F.col("id") != F.col("seed_id"))).select(*KEY, "id", "score")


def neighbor_fallback(asks: DataFrame, found: DataFrame, corpus: DataFrame, window: int = 2, n: int = 3, least: float = 0.5) -> DataFrame:
    """For (seed, entity) without a first hop the n nearest chunks within the window around the seed in its source."""
    empty = asks.select(*KEY).join(found.select(*KEY).distinct(), list(KEY), "left_anti")
    place = corpus.select(F.col("id").alias("seed_id"), "source_id", "chunk_index")
    offsets = F.explode(F.array(*[F.lit(k) for k in range(-window, window + 1) if k]))
    around = empty.join(place, "seed_id").withColumn("off", offsets).withColumn("chunk_index", F.col("chunk_index") + F.col("off"))
    near = around.join(corpus.select("source_id", "chunk_index", "id"), ["source_id", "chunk_index"]).select(*KEY, "id")
    best = dense_topk_by_ids(asks.select(*KEY, "vector"), near, corpus, n, KEY, KEY)
    return best.where(F.col("score") >= least).select(*KEY, "id", "score")


def second_entities(hop: DataFrame, mentions: DataFrame, n: int = 5) -> DataFrame:
    """Of the other entities that the chunks of a first hop mention, the first n of each (seed, entity), nearest chunks first."""
    other = _named(mentions).select(F.col("chunk_id").alias("via_id"), F.col("name").alias("name2"), F.col("type").alias("type2"))
    via = hop.select(*KEY, F.col("id").alias("via_id"), "score").join(other, "via_id").where("name2 <> name")
    w = Window.partitionBy(*KEY).orderBy(F.desc(F.round("score", 12)), "via_id", "name2", "type2")
    return via.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(*SECOND, "place")


def second_hop(asks: DataFrame, mentions: DataFrame, corpus: DataFrame, n: int = 5, least: float = 0.5) -> DataFrame:
    """From the second entities (with the vectors of their questions) to the n nearest chunks that mention them, as in the first hop."""
    named = _named(mentions).select(F.col("chunk_id").alias("id"), F.col("name").alias("name2"), F.col("type").alias("type2"))
    best = dense_topk_by_names(asks, named, corpus, n, ("name2", "type2"), SECOND)
    return best.where((F.col("score") >= least) & (F.col("id") != F.col("seed_id"))).select(*SECOND, "id", "score")


def expansion_steps(roots: DataFrame, entities: DataFrame, few: DataFrame) -> DataFrame:
    """One row a model call, in order: for each seed its choice, for each of its entities the question, the choice of second entities
    if there are any, and the question of each of those."""
    seeds = roots.select("query_id", F.col("id").alias("seed_id"), F.col("rank").alias("seed_rank"))
    own = entities.join(seeds, ["query_id", "seed_id"]).select(*KEY, "seed_rank", F.col("place").alias("entity_rank"))
    more = few.select(*KEY, "place").join(own, list(KEY))
    step = lambda df, entity_rank, hop: df.select("query_id", "seed_rank", entity_rank.alias("entity_rank"), hop.alias("hop"), F.lit(1).alias("cost"))
    out = step(seeds, F.lit(0), F.lit(0)).unionByName(step(own, F.col("entity_rank"), F.lit(1)))
    return out.unionByName(step(more.where("place = 1"), F.col("entity_rank"), F.lit(2))).unionByName(step(more, F.col("entity_rank"), F.col("place") + 2))


def within_budget(steps: DataFrame, most: int = 100) -> DataFrame:
    """The steps (query_id, seed_rank, entity_rank, hop, cost) that fit into the budget of their query, in that order."""
    w = Window.partitionBy("query_id").orderBy("seed_rank", "entity_rank", "hop").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= most)


def finalize_roots(roots: DataFrame, first: DataFrame, second: DataFrame, n: int = 5, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), bonus: float = 0.05, scores: DataFrame | None = None) -> DataFrame:
    """query_id, id, score and rank: the root's score with the best of both hops, and a bonus for any second hop.

    scores: query_id, id and score of the related chunks from one reranking of all, in place of those of the hops.
    """
    if scores is not None:
        new = scores.select("query_id", "id", F.col("score").alias("_new"))
        first, second = (h.join(new, ["query_id", "id"], "left").withColumn("score", F.coalesce("_new", "score")) for h in (first, second))
    best1 = first.groupBy("query_id", F.col("seed_id").alias("id")).agg(F.max("score").alias("s1"))
    best2 = second.groupBy("query_id", F.col("seed_id").alias("id")).agg(F.max("score").alias("s2"))
    rows = roots.groupBy("query_id", "id").agg(F.max("score").alias("s0")).join(best1, ["query_id", "id"], "left").join(best2, ["query_id", "id"], "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    score = weights[0] * F.col("s0") + weights[1] * z("s1") + weights[2] * z("s2") + F.when(F.col("s2").isNotNull(), bonus).otherwise(0.0)
    return ranked(rows.select("query_id", "id", score.alias("score")), n)


def _extended(text: Column, more: Column, low: int, high: int, before: bool, count: Callable[[Column], Column]) -> Column:
    """The text with more texts, in order, until it has `low` tokens or the next would take it over `high`."""
    def step(s, x):
        joined = F.concat(x, F.lit("\n\n"), s["t"]) if before else F.concat(s["t"], F.lit("\n\n"), x)
        n = count(joined)
        over = s["stop"] | (s["n"] >= low)
        return F.when(over, F.struct(s["t"].alias("t"), s["n"].alias("n"), F.lit(True).alias("stop"))).when(
            n > high, F.struct(s["t"].alias("t"), s["n"].alias("n"), F.lit(True).alias("stop"))
        ).otherwise(F.struct(joined.alias("t"), n.alias("n"), F.lit(False).alias("stop")))

    start = F.struct(text.alias("t"), count(text).alias("n"), F.lit(False).alias("stop"))
    return F.aggregate(more, start, step, lambda s: s["t"])


def expand_context(centers: DataFrame, corpus: DataFrame, window: int = 2, low: int = 200, high: int = 600, counter: TokenCounter = WORDS) -> DataFrame:
    """id and context: short chunks with their followers, then what precedes them, within the window of their source.

    centers: id; corpus: id, source_id, chunk_index, text. The neighbours are found by equality of (source, index), so that
    nothing is scanned by range; each center is looked up once.
    """
    ids = centers.select("id").distinct()
    c = corpus.select("id", "source_id", "chunk_index", "text")
    mid = c.join(ids, "id", "left_semi")
    offsets = F.explode(F.array(*[F.lit(k) for k in range(-window, window + 1) if k]))
    near = mid.select("id", "source_id", (F.col("chunk_index")).alias("at"), offsets.alias("off")).withColumn("chunk_index", F.col("at") + F.col("off"))
    texts = near.join(c.select("source_id", "chunk_index", F.col("text").alias("near")), ["source_id", "chunk_index"])
    side = lambda cond, key: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(key.alias("k"), F.col("near").alias("x"))))), lambda s: s["x"])
    lists = texts.groupBy("id").agg(side(F.col("off") > 0, F.col("off")).alias("after"), side(F.col("off") < 0, -F.col("off")).alias("before"))
    none = F.array().cast("array<string>")
    rows = mid.select("id", "text").join(lists, "id", "left").select("id", "text", F.coalesce("after", none).alias("after"), F.coalesce("before", none).alias("before"))
    rows = rows.withColumn("text", _extended(F.col("text"), F.col("after"), low, high, False, counter.column))
    return rows.select("id", _extended(F.col("text"), F.col("before"), low, high, True, counter.column).alias("context"))


def apply_context(results: DataFrame, corpus: DataFrame, **limits) -> DataFrame:
    """The results (any rows with an id) with the context of their chunk."""
    return results.join(expand_context(results, corpus, **limits), "id", "left")


def expand_insights(seeds: DataFrame, links: DataFrame | Links, insights: DataFrame, posted: DataFrame | Posted, asks: Asks, *, seeds_each: int = 5, n: int = 10, groups: int = 3, each: int = 5, details: DataFrame | None = None) -> DataFrame:
    """query_id, seed_id, group_no, sub_query, rank, id and score: group 0 is the n most similar linked insights of each seed, groups 1 to 3
    what a hybrid search finds for the questions on the first three of those.

    An insight comes once for a seed, where it occurs first, and never as its own. seeds: query_id, id and rank, at most
    seeds_each a query. links: all of them, or a function that gives those of the ids asked for. sub_query is the question of a group, null for group 0. details: insight_id and what is to go with each
    found insight, such as topics and sources (`catalog.insight_details`).
    """
    w = Window.partitionBy("query_id", "seed_id").orderBy(F.desc(F.round("similarity", 12)), "id")
    own = seeds.select("query_id", F.col("id").alias("seed_id"), F.col("rank").alias("seed_rank"))
    links = links(own.select(F.col("seed_id").alias("id"))) if callable(links) else links
    near = own.join(links.select(F.col("src").alias("seed_id"), F.col("dst").alias("id"), "similarity"), "seed_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    near = materialize(near)  # read by the questions, by both searches and by the result
    step = F.col("query_id") * (groups * seeds_each) + (F.col("seed_rank") - 1) * groups + F.col("rank") - 1
    about = near.where(F.col("rank") <= groups).join(insights.select("id", F.col("text").alias("content")), "id", "left").withColumn("step", step)
    asked = asks(about.select("step", "query_id", "seed_id", F.col("rank").alias("group_no"), F.col("id").alias("about"), "content"), "content")
    found = hybrid_search(asked.select(F.col("step").alias("query_id"), "text", "vector"), insights, posted, each, 0.0).withColumnRenamed("query_id", "step")
    questions = asked.select("step", F.col("text").alias("sub_query"))
    hits = found.join(about.select("step", "query_id", "seed_id", F.col("rank").alias("group_no")), "step").join(questions, "step")
    rows = near.select("query_id", "seed_id", F.lit(0).alias("group_no"), F.lit(None).cast("string").alias("sub_query"), "rank", "id", F.col("similarity").alias("score")).unionByName(hits.drop("step"))
    out = unseen(rows.where("id <> seed_id"))
    return out if details is None else out.join(details.withColumnRenamed("insight_id", "id"), "id", "left")


def unseen(groups: DataFrame) -> DataFrame:
    """Of (query_id, seed_id, group_no, rank, id) each id once per seed, where it occurs first."""
    w = Window.partitionBy("query_id", "seed_id", "id").orderBy("group_no", "rank")
    return groups.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def retrieve(
    queries: DataFrame, variants: DataFrame, corpus: DataFrame, posted: DataFrame | Posted, mentions: DataFrame, *, asks: Asks | None = None,
    scorer: Callable[[Column, Column], Column] = cosine, seeds: int = 10, n: int = 5, least: float = 0.5, budget: int = 100,
) -> dict[str, DataFrame]:
    """Every stage of the chunk branch, each written once as the next ones read it several times: fused first stage, reranked roots, entities, both hops within the budget of model calls,
    final ranks after one reranking of all related chunks, and the contexts of roots and related chunks.

    queries: query_id, text, vector; variants as for first_stage; asks gives the questions of the hops, by default sub_queries.
    What all stages read, the corpus and the names that its chunks mention, is written once, too, and among the stages.
    """
    asks = asks or (lambda steps, column: sub_queries(steps, queries, column))
    corpus, mentions = materialize(corpus), materialize(mentions.select("chunk_id", "canonical_name", "entity_type").distinct())
    fused = materialize(first_stage(variants, corpus, posted))
    roots = materialize(rerank(fused, queries, corpus, scorer, seeds))
    entities = materialize(seed_entities(roots, mentions))
    questions = materialize(asks(entities.select(*KEY), "name"))
    hop = materialize(first_hop(questions, mentions, corpus, least=least))
    hop = materialize(hop.unionByName(neighbor_fallback(questions, hop, corpus, least=least)))
    few = materialize(second_entities(hop, mentions))
    steps = materialize(within_budget(expansion_steps(roots, entities, few), budget))
    places = roots.select("query_id", F.col("id").alias("seed_id"), F.col("rank").alias("seed_rank")).join(entities.withColumnRenamed("place", "entity_rank"), ["query_id", "seed_id"])
    granted = materialize(places.join(steps, ["query_id", "seed_rank", "entity_rank"]).select(*KEY, "hop"))
    hop = hop.join(granted.where("hop = 1").drop("hop"), list(KEY), "left_semi")
    few = few.withColumn("hop", F.col("place") + 2).join(granted, [*KEY, "hop"], "left_semi").drop("hop")
    second = materialize(second_hop(materialize(asks(few.select(*SECOND), "name2")), mentions, corpus, least=least))
    related = hop.select("query_id", "id").unionByName(second.select("query_id", "id"))
    final = materialize(finalize_roots(roots, hop, second, n, scores=rerank(related, queries, corpus, scorer, None)))
    level = lambda df, name: df.select("query_id", "seed_id", F.lit(name).alias("level"), "id")
    shown = final.select("query_id", F.col("id").alias("seed_id"))
    every = level(final.withColumn("seed_id", F.col("id")), "root").unionByName(
        level(hop, "first").unionByName(level(second, "second")).distinct().join(shown, ["query_id", "seed_id"], "left_semi"))
    return {
        "corpus": corpus, "mentions": mentions, "fused": fused, "roots": roots, "entities": entities, "steps": steps, "first_hop": hop,
        "second_hop": second, "final": final, "contexts": apply_context(every, corpus),
    }


def retrieve_insights(
    queries: DataFrame, variants: DataFrame, insights: DataFrame, posted: DataFrame | Posted, links: DataFrame | Links, *, asks: Asks | None = None,
    scorer: Callable[[Column, Column], Column] = cosine, seeds: int = 5, n: int = 5, details: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every stage of the insight branch; fused and seeds are written once. The reranking only selects the seeds, which keep their order and score."""
    asks = asks or (lambda steps, column: sub_queries(steps, queries, column))
    fused = materialize(insight_first_stage(variants, insights, posted))
    chosen = rerank(fused, queries, insights, scorer, seeds).select("query_id", "id")
    final = materialize(ranked(fused.drop("rank").join(chosen, ["query_id", "id"], "left_semi"), min(n, seeds)))
    return {"fused": fused, "final": final, "related": expand_insights(final, links, insights, posted, asks, seeds_each=min(n, seeds), details=details)}


def retrieve_trace(stages: dict[str, DataFrame], corpus: DataFrame, n: int = 5) -> DataFrame:
    """query_id, stage, place, id and preview of the n best chunks of every stage that has scores."""
    best = None
    for name, df in stages.items():
        if {"id", "score"} <= set(df.columns):
            one = df.groupBy("query_id", "id").agg(F.max("score").alias("score")).select("query_id", F.lit(name).alias("stage"), "id", "score")
            best = one if best is None else best.unionByName(one)
    top = ranked(best, n, ("query_id", "stage")).withColumnRenamed("rank", "place").drop("score")
    return top.join(corpus.select("id", preview(F.col("text")).alias("preview")), "id")
