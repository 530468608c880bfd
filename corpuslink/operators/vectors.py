"""Exact nearest neighbours, embeddings and their upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize
from ..functions.text import cosine
from .cells import PART, Best, Block, Cells, finite

PAIRS = "query_id long, id long, score double"


def _scored(asks: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": asks.astype(np.int64), "id": ids.astype(np.int64), "score": score.astype(np.float64)})


def dense_topk(queries: DataFrame, corpus: DataFrame | Cells, n: int, *, others: bool = False) -> DataFrame:
    """query_id, id, score and rank of the n rows nearest by cosine to each query; exact. With others, never the query's own id.

    The corpus (id, vector) is dealt to cells (`Cells`; one that exists can be given). Each query visits the cells that may
    hold its nearest first, until these hold n vectors; the n-th best of them is a floor, and then only cells that may hold
    better than this are visited. A task keeps the best n of each query. Ties go to the smallest id. Null vectors neither
    ask nor are found; zero vectors have cosine 0 with all.
    """
    cells = corpus if isinstance(corpus, Cells) else Cells(corpus)

    def best(t: Block) -> pd.DataFrame:
        top = Best(t.x, t.y, t.ids, n, t.floor, int(others))
        for i, j in t.steps():
            top.add(i, j, own=t.asks if others else None)
        i, j, score = top.rows()
        return _scored(t.asks[i], t.ids[j], score)

    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("vector is not null")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    q = cells.bounds.first(q, n + others)
    near = materialize(top(cells.meet(q, cells.bounds.seen, best, PAIRS, True)))
    if len(cells.bounds.cell) <= 1:
        return near
    floor = near.where(F.col("rank") == n).select("query_id", F.col("score").alias("floor"))
    asking = q.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
    return top(near.drop("rank").unionByName(cells.meet(asking, cells.bounds.better, best, PAIRS, True)))


def dense_pairs(queries: DataFrame, corpus: DataFrame | Cells, least: float, *, earlier: bool = False, best: bool = False) -> DataFrame:
    """All (query_id, id, score) with at least the cosine; with earlier, only those of smaller id than the query's.

    Exact: a query visits the cells that may hold a vector within the angle (`Bounds.within`), and these only. Cosines in single
    precision, with a bound on their error, say which pairs are computed in double. With best, each
    cell tells a query at most its nearest row, so that a query among many near rows doesn't name them all.
    """
    cells = corpus if isinstance(corpus, Cells) else Cells(corpus)

    def enough(t: Block) -> pd.DataFrame:
        out = [_scored(t.asks[:0], t.ids[:0], np.zeros(0))]
        x, y, low = finite(t.x), finite(t.y), np.float32(least - (t.x.shape[1] + 8) * 1.2e-7 - 1e-11)
        for i, j in t.steps():
            at = np.flatnonzero(x[i] @ y[j].T >= low)
            a, b = i[at // len(j)], j[at % len(j)]
            if earlier:
                a, b = (k[t.asks[a] > t.ids[b]] for k in (a, b))
            if not len(a):
                continue
            s = np.concatenate([np.einsum("ij,ij->i", t.x[a[k : k + PART]], t.y[b[k : k + PART]]) for k in range(0, len(a), PART)])
            a, b, s = (k[s >= least] for k in (a, b, s))
            if best:
                order = np.lexsort((t.ids[b], -np.round(s, 12), a))
                order = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
                a, b, s = a[order], b[order], s[order]
            out.append(_scored(t.asks[a], t.ids[b], s))
        return pd.concat(out)

    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("vector is not null")
    return cells.meet(q, cells.bounds.within(float(np.arccos(np.clip(least, -1.0, 1.0)))), enough, PAIRS, best)


def dense_pair_count(queries: DataFrame, corpus: DataFrame | Cells, least: float) -> int:
    """How many pairs `dense_pairs` would give, without making them."""
    cells = corpus if isinstance(corpus, Cells) else Cells(corpus)
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where("vector is not null")
    count = lambda t: pd.DataFrame({"k": [sum(int((t.x[i] @ t.y[j].T >= least).sum()) for i, j in t.steps())]})
    return cells.meet(q, cells.bounds.within(float(np.arccos(np.clip(least, -1.0, 1.0)))), count, "k long").agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]


def dense_topk_by_ids(queries: DataFrame, candidates: DataFrame, corpus: DataFrame, n: int, keys: tuple[str, ...] = ("query_id",), on: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The nearest n of each query's own candidates (keys, id): an equi-join on `on`, then exact scores."""
    rows = candidates.join(queries.withColumnRenamed("vector", "_q"), list(on)).join(corpus.select("id", F.col("vector").alias("_c")), "id")
    return _nearest_of(rows, n, keys)


def _nearest_of(rows: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    scored = rows.where("_q is not null and _c is not null").withColumn("score", cosine(F.col("_q"), F.col("_c"))).drop("_q", "_c")
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 12)), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def dense_topk_by_names(queries: DataFrame, held: DataFrame, corpus: DataFrame, n: int, names: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """The nearest n of each query (keys, names, vector) among the rows that hold its names (held: id, names).

    A row of the corpus takes part once, with all names that are asked for, and meets the queries after it has its vector, so
    that what is shuffled doesn't grow with queries times rows.
    """
    asked = materialize(queries.select(*dict.fromkeys((*keys, *names)), F.col("vector").alias("_q")).where("_q is not null"))
    some = held.join(asked.select(*names).distinct(), list(names), "left_semi").groupBy("id").agg(F.collect_set(F.struct(*names)).alias("_n"))
    rows = some.join(corpus.select("id", F.col("vector").alias("_c")), "id").select("id", "_c", F.explode("_n").alias("_n"))
    return _nearest_of(rows.select("id", "_c", *[F.col(f"_n.{c}").alias(c) for c in names]).join(asked, list(names)), n, keys)


def nearest(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    return dense_topk(queries, corpus, 1).drop("rank")


def hashed_embedding(texts: list[str], dims: int = 64) -> np.ndarray:
    """The default embedder: signed counts of hashed words, scaled to length 1. Needs no model and no network."""
    from zlib import crc32

    out = np.zeros((len(texts), dims), np.float32)
    for k, text in enumerate(texts):
        for word in text.lower().split():
            h = crc32(word.encode("utf-8", "replace"))
            out[k, h % dims] += 1.0 if h >> 31 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray] = hashed_embedding, batch: int = 32, name: str = "embedding") -> DataFrame:
    """The rows with a vector of their text, `batch` texts at a call. A call of the wrong length gives nulls; null texts too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = [None] * len(frame)
            some = [k for k, t in enumerate(frame[text]) if t is not None]
            for k in range(0, len(some), batch):
                part = some[k : k + batch]
                vectors = embedder([frame[text].iat[i] for i in part])
                if len(vectors) == len(part):
                    for i, v in zip(part, vectors):
                        out[i] = np.asarray(v, np.float32)
            yield frame.assign(**{name: out})

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    kept = [f for f in rows.schema.fields if f.name != name]
    return rows.select(*[f.name for f in kept]).mapInPandas(run, StructType([*kept, StructField(name, ArrayType(FloatType()))]))


def backfill_embeddings(table: DataFrame, key: str, text: str, embedder: Callable = hashed_embedding) -> DataFrame:
    """The table with vectors where there were none; those that have one are not touched."""
    missing = embed(table.where("embedding is null").select(key, text), text, embedder).select(key, F.col("embedding").alias("_new"))
    return table.join(missing, key, "left").withColumn("embedding", F.coalesce("embedding", "_new")).drop("_new")
