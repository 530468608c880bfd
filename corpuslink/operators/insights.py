"""Insights: extraction, de-duplication in order, links to chunks and to each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import map_model
from ..functions.shared import connected_components, materialize
from .cells import COLUMNS, Best, Cells, unit
from .responses import parse_insights
from .vectors import dense_pair_count, dense_pairs, nearest

#: Pairs that one task settles in order, rounds after which `leaders` raises, the first prefix, and pairs of a prefix at most.
SETTLED, ROUNDS, FIRST, PAIRS = 500_000, 60, 8_000, 50_000_000
#: Insights of either side that a task of `nearest_apart` holds, and rows of one step of it.
QUERY_BLOCK, CORPUS_BLOCK, STEP_ROWS = 16_000, 64_000, 1_000


def extract_insights(chunks: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """source_id, chunk_id, seq, insight and topics from a model's answers on the first 4000 characters of each chunk."""
    asked = chunks.select("source_id", "chunk_id", "chunk_index", F.substring("content", 1, 4000).alias("prompt"))
    answers = map_model(asked, "prompt", model).select("source_id", "chunk_id", "chunk_index", F.posexplode(parse_insights(F.col("answer"))).alias("pos", "i"))
    # In the order of sources, chunks and places: a number that needs no shuffle of everything into one task.
    seq = F.concat_ws("-", F.lpad(F.col("source_id").cast("string"), 20, "0"), F.lpad(F.col("chunk_index").cast("string"), 10, "0"), F.lpad(F.col("pos").cast("string"), 6, "0"))
    return answers.select("source_id", "chunk_id", seq.alias("seq"), "i.insight", "i.topics")


def match_existing(new: DataFrame, store: DataFrame, least: float = 0.95) -> DataFrame:
    """seq and existing_id of new insights (seq, vector) whose nearest stored one (id, vector) has at least the cosine."""
    found = nearest(new.select(F.col("seq").alias("query_id"), "vector"), store)
    return found.where(F.col("score") >= least).select(F.col("query_id").alias("seq"), F.col("id").alias("existing_id"), "score")


def _settle(f: pd.DataFrame) -> pd.DataFrame:
    """Greedy in order: whoever has no leader before it among its neighbours leads."""
    leads: dict[int, bool] = {}
    f = f.sort_values("later", kind="stable")
    for a, b in zip(f["earlier"].tolist(), f["later"].tolist()):
        leads.setdefault(a, True)  # all that is earlier than it has been seen
        leads[b] = leads.get(b, True) and not leads[a]
    return pd.DataFrame({"seq": list(leads), "leader": list(leads.values())}).astype({"seq": np.int64, "leader": bool})


def leaders(pairs: DataFrame) -> DataFrame:
    """(seq, leader) of all that the pairs (earlier, later) name: the lexicographically first maximal independent set of their graph.

    Components of at most SETTLED pairs are settled in order within a task, several small ones in one, so that a chain takes
    no more rounds than a star. A component with more settles its first SETTLED pairs in the order of `later`, hands on
    what these decide, and what is left open falls into components again. Every step is written to the shared folder, and
    more than ROUNDS of them raise.
    """
    left, done = materialize(pairs.select("earlier", "later")), None
    for _ in range(ROUNDS):
        n = left.count()
        if n <= SETTLED:
            parts = left.withColumn("part", F.lit(0).cast("long"))
        else:
            parts = left.join(connected_components(left.toDF("a", "b")).toDF("earlier", "part"), "earlier")
            # A crowded component is cut at the percentile of `later` below which about SETTLED of its pairs lie.
            hundredths = F.percentile_approx("later", [x / 100 for x in range(1, 100)], 1000)
            cut = parts.groupBy("part").agg(hundredths.alias("at"), F.count("*").alias("n")).where(F.col("n") > SETTLED)
            nth = F.greatest(F.lit(1), F.floor(F.lit(100.0 * SETTLED) / F.col("n"))).cast("int")
            cut = cut.select("part", F.element_at("at", nth).alias("until"))
            few = F.pmod(F.xxhash64("part"), F.lit(max(1, 2 * n // SETTLED)))
            parts = materialize(parts.join(cut, "part", "left").withColumn("part", F.when(F.col("until").isNull(), -1 - few).otherwise(F.col("part"))))
        now = parts if n <= SETTLED else parts.where("until is null or later <= until").drop("until")
        settled = materialize(now.groupBy("part").applyInPandas(_settle, "seq long, leader boolean"))
        done = settled if done is None else done.unionByName(settled)
        if n <= SETTLED:
            return done
        # What is settled leaves the graph: followers with all their pairs, leaders with those that they lead.
        rest = parts.where("later > until").select("earlier", "later")
        ends = lambda df: df.select(F.col("earlier").alias("seq")).union(df.select(F.col("later").alias("seq"))).distinct()
        led = materialize(rest.join(settled.where("leader").toDF("earlier", "leader"), "earlier").select(F.col("later").alias("seq")).distinct())
        gone = settled.select("seq").union(led)
        open_ = materialize(rest.join(gone.toDF("earlier"), "earlier", "left_anti").join(gone.toDF("later"), "later", "left_anti"))
        free = ends(rest).join(gone, "seq", "left_anti").join(ends(open_), "seq", "left_anti")
        done = materialize(done.unionByName(led.withColumn("leader", F.lit(False))).unionByName(free.withColumn("leader", F.lit(True))))
        left = open_
    raise RuntimeError(f"leaders have not settled in {ROUNDS} rounds")


def _as_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("query_id"), "vector")


def dedup_in_order(new: DataFrame, least: float = 0.95, store: DataFrame | None = None) -> DataFrame:
    """seq, insight_seq and is_new: each new insight (seq, vector), in order, joins the nearest earlier kept one from `least` on, else is kept.

    With a store (seq below all new ones, vector) its rows are kept from the start and count as earlier; they are compared once.

    Equal vectors are compared once. The first FIRST vectors find their pairs (`dense_pairs`) and settle who leads
    (`leaders`); all later ones that are near a leader are followers and leave; then twice as many of those left, and so on:
    the rounds grow with the logarithm of the rows. So a family of near copies meets its first leaders and not all of
    itself. Where a prefix would still have more than PAIRS pairs, by count, it is halved. At the end each vector is compared
    with the leaders only, of which those before a row's own place count. Null, zero and broken vectors are near nothing.
    """
    usable = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    first = lambda df: materialize(df.where(usable).groupBy("vector").agg(F.min("seq").cast("long").alias("id")))
    classes = first(new)
    left, stored = classes, None
    if store is not None:
        kept = first(store)
        stored = materialize(dense_pairs(_as_queries(classes), Cells(kept), least, best=True))
        left = left.join(kept.select("vector"), "vector", "left_anti")
        left = materialize(left.join(stored.select(F.col("query_id").alias("id")), "id", "left_anti").select("vector", "id"))
    found, size = [], FIRST
    while n := left.count():
        part, until = left, None
        if n > size:
            until = left.agg(F.percentile_approx("id", size / n, 10_000)).first()[0]
            part = materialize(left.where(F.col("id") <= until))
        near = Cells(part)
        if n > FIRST and size > 1 and dense_pair_count(_as_queries(part), near, least) > PAIRS:
            size = max(1, min(size, n) // 2)
            continue
        pairs = dense_pairs(_as_queries(part), near, least, earlier=True)
        state = leaders(pairs.select(F.col("id").alias("earlier"), F.col("query_id").alias("later")))
        led = state.where("not leader").select(F.col("seq").alias("id"))
        now = materialize(part.join(led, "id", "left_anti").select("vector", "id"))
        found.append(now)
        if until is None:
            break
        left = left.where(F.col("id") > until)
        left = materialize(left.join(dense_pairs(_as_queries(left), now, least, best=True).select(F.col("query_id").alias("id")), "id", "left_anti").select("vector", "id"))
        size *= 2
    own = materialize(reduce(DataFrame.unionByName, found)) if found else classes.limit(0)
    to = dense_pairs(_as_queries(classes), own, least)
    if stored is not None:
        to = to.unionByName(stored)
    # Leaders are near none of each other, so that few of them are near one vector.
    near = F.collect_list(F.struct(F.round("score", 12).alias("score"), (-F.col("id")).alias("less"))).alias("near")
    to = to.groupBy(F.col("query_id").alias("id")).agg(near)
    named = classes.join(own.select("id", F.lit(True).alias("leads")), "id", "left").join(to, "id", "left")
    rows = new.select("seq", "vector").join(named, "vector", "left")
    leads = F.col("id").isNull() | (F.coalesce("leads", F.lit(False)) & (F.col("seq") == F.col("id")))
    before = F.array_max(F.filter("near", lambda x: -x["less"] < F.col("seq")))
    return rows.select("seq", F.when(leads, F.col("seq")).otherwise(-before["less"]).alias("insight_seq"), leads.alias("is_new"))


def link_chunk_insights(links: DataFrame) -> DataFrame:
    """One row per (chunk_id, insight_id) with the topics of its last seq."""
    return links.groupBy("chunk_id", "insight_id").agg(F.max_by("topics", "seq").alias("topics"))


def contains_edges(links: DataFrame) -> DataFrame:
    return links.select("chunk_id", "insight_id", "topics").distinct()


def extraction_stats(upserted: DataFrame) -> DataFrame:
    """Per source the chunks processed and the insights new and reused. upserted: source_id, chunk_id, is_new."""
    return upserted.groupBy("source_id").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_reused"))


def nearest_apart(asking: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """a, b and s of the k rows of the corpus nearest to each asking one, without itself and those that share a source with it.

    Both: id, vector, sources. Asking rows may have a `floor`: what is below it is left out (null for none). Blocks of both sides meet in
    tasks, step by step; of a step, what `Best` leaves of it is kept, and pairs with a common source are taken out source by source.
    """
    floor = F.coalesce("floor", F.lit(-2.0)) if "floor" in asking.columns else F.lit(-2.0)
    rows = asking.where("vector is not null").select("id", "vector", "sources", floor.alias("floor"))
    held = corpus.where("vector is not null").select(F.col("id").alias("id2"), F.col("vector").alias("vector2"), F.col("sources").alias("sources2"))
    na, nb = max(1, -(-rows.count() // QUERY_BLOCK)), max(1, -(-held.count() // CORPUS_BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("qa", F.pmod(F.xxhash64("id"), F.lit(na)).cast("int")).withColumn("qb", every(nb))
    right = held.withColumn("cb", F.pmod(F.xxhash64("id2"), F.lit(nb)).cast("int")).withColumn("ca", every(na))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})
        b = b.sort_values("id2")
        ia, ib, floor = a["id"].to_numpy(np.int64), b["id2"].to_numpy(np.int64), a["floor"].to_numpy(np.float64)
        names = {x: i for i, x in enumerate(sorted({x for col in (a["sources"], b["sources2"]) for xs in col for x in xs}))}
        of = [(np.repeat(np.arange(len(col)), [len(xs) for xs in col]), np.array([names[x] for xs in col for x in xs], np.int64)) for col in (a["sources"], b["sources2"])]

        def held(k: int, lo: int, hi: int) -> dict:
            """source -> rows of side k between lo and hi, counted from lo."""
            row, name = (x[np.searchsorted(of[k][0], lo) : np.searchsorted(of[k][0], hi)] for x in of[k])
            order = np.argsort(name, kind="stable")
            cut = np.flatnonzero(np.diff(name[order])) + 1
            return {int(name[o[0]]): row[o] - lo for o in np.split(order, cut) if len(o)}

        def apart(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
            mine, theirs = held(0, i[0], i[-1] + 1), held(1, j[0], j[-1] + 1)
            for name in mine.keys() & theirs.keys():
                s[np.ix_(mine[name], theirs[name])] = -np.inf
            same = np.searchsorted(ib[j], ia[i])
            hit = np.flatnonzero(ib[j][np.minimum(same, len(j) - 1)] == ia[i])
            s[hit, same[hit]] = -np.inf

        best = Best(unit(a["vector"]), unit(b["vector2"]), ib, k, floor)
        for c in range(0, len(b), COLUMNS):
            for r in range(0, len(a), STEP_ROWS):
                best.add(np.arange(r, min(r + STEP_ROWS, len(a))), np.arange(c, min(c + COLUMNS, len(b))), apart)
        i, j, s = best.rows()
        s = np.round(s, 12)
        ok = s >= floor[i]
        return pd.DataFrame({"a": ia[i[ok]], "b": ib[j[ok]], "s": s[ok]})

    return _first(left.groupBy("qa", "qb").cogroup(right.groupBy("ca", "cb")).applyInPandas(block, "a long, b long, s double"), k)


def _first(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def extend_nearest(near: DataFrame, stored: DataFrame, new: DataFrame, k: int = 10) -> DataFrame:
    """The lists (a, b, s) of `nearest_apart` over the stored and the new insights together, from those of the stored ones.

    The new ones ask all. A stored one is asked about the new ones only, and takes in those that reach the k-th score of its
    list, so that the stored ones aren't compared with each other again. ids of new ones are new; a stored insight whose
    sources have changed is to be taken out of the lists and the store, and given as a new one.
    """
    kth = near.groupBy(F.col("a").alias("id")).agg(F.when(F.count("*") >= k, F.min("s")).alias("floor"))
    entering = nearest_apart(stored.join(kth, "id", "left"), new, k)
    own = nearest_apart(new, stored.select("id", "vector", "sources").unionByName(new.select("id", "vector", "sources")), k)
    return _first(near.unionByName(entering), k).unionByName(own)


def mutual(near: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """src, dst and similarity of those that are in each other's list; the lists of the others may be given apart."""
    back = (near if back is None else back).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return near.join(back, ["a", "b"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("s").alias("similarity"))


def mutual_links(insights: DataFrame, k: int = 10, of: DataFrame | None = None) -> DataFrame:
    """src, dst and similarity, both ways, of insights (id, vector, sources) that are among each other's k nearest without a common source.

    of: the ids (id) whose links are asked for. Then only they and those in their lists are compared with all insights.
    """
    rows = insights.select("id", "vector", "sources")
    if of is None:
        return mutual(materialize(nearest_apart(rows, rows, k)))
    near = materialize(nearest_apart(rows.join(of.select("id").distinct(), "id", "left_semi"), rows, k))
    return mutual(near, nearest_apart(rows.join(near.select(F.col("b").alias("id")).distinct(), "id", "left_semi"), rows, k))


def related(links: DataFrame, insights: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar linked insights of each insight."""
    w = Window.partitionBy("src").orderBy(F.desc(F.round("similarity", 12)), "dst")
    return links.join(insights.select(F.col("id").alias("src")), "src", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
