"""Full-text postings, rank fusion, hybrid search and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize
from ..functions.text import ANALYZERS, cosine
from .postings import Index, exact_sum
from .vectors import dense_topk, dense_topk_by_ids

COVER_WEIGHT = 0.1


def postings(docs: DataFrame, analyzer: str = "simple", only: DataFrame | None = None) -> DataFrame:
    """term, id, positions (ascending) and tf of (id, text); of the terms (term) in `only`, if that is given."""
    terms = docs.select("id", F.posexplode(ANALYZERS[analyzer](F.col("text"))).alias("pos", "term"))
    if only is not None:
        terms = terms.join(only, "term", "left_semi")
    return terms.groupBy("term", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.count("*").alias("tf"))


class Asked:
    """A corpus (id, text) whose postings are counted for the asked terms only, at each search; all else never leaves the task that reads it."""

    def __init__(self, docs: DataFrame, analyzer: str = "simple"):
        self.docs, self.analyzer = docs, analyzer

    def posted(self, asked: DataFrame) -> DataFrame:
        """term, id, positions and tf of the asked terms (term), as `postings` has them of all; written once, as a search reads them twice."""
        terms = materialize(asked.select("term").distinct())
        return materialize(postings(self.docs, self.analyzer, terms))


#: What stands for the postings of a corpus where the terms are known.
Posted = Index | Asked


def query_terms(queries: DataFrame, analyzer: str = "simple") -> DataFrame:
    """query_id, term and role `required` of each distinct term of (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(ANALYZERS[analyzer](F.col("text")))).alias("term")).withColumn("role", F.lit("required"))


def sparse_match(terms: DataFrame, posted: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """(query_id, id) where all required terms occur, one of the `any` terms if there are some, and no negated one.

    terms: query_id, term, role (required, any, negated). phrases: query_id, phrase (its number), offset, term, role; a phrase
    counts as one term of its role, met where its terms stand side by side.
    """
    units, met = terms.select("query_id", "role"), terms.join(posted.select("term", "id"), "term").select("query_id", "id", "role")
    if phrases is not None:
        named = phrases.select("query_id", "phrase", "role").distinct()
        units = units.unionByName(named.select("query_id", "role"))
        met = met.unionByName(phrase_match(phrases.drop("role"), posted).join(named, ["query_id", "phrase"]).select("query_id", "id", "role"))
    count = lambda role: F.count_if(F.col("role") == role)
    need = units.groupBy("query_id").agg(count("required").alias("n_req"), count("any").alias("n_any"))
    met = met.groupBy("query_id", "id").agg(count("required").alias("req"), count("any").alias("any_"), count("negated").alias("neg"))
    return met.join(need, "query_id").where("req = n_req and (n_any = 0 or any_ > 0) and neg = 0 and req + any_ > 0").select("query_id", "id")


def phrase_match(phrases: DataFrame, posted: DataFrame) -> DataFrame:
    """(query_id, phrase, id) where the phrase's terms (query_id, phrase, offset, term) stand side by side in their order."""
    size = phrases.groupBy("query_id", "phrase").agg(F.count("*").alias("k"))
    starts = phrases.join(posted, "term").select("query_id", "phrase", "id", "offset", F.explode("positions").alias("pos"))
    runs = starts.groupBy("query_id", "phrase", "id", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
    return runs.join(size, ["query_id", "phrase"]).where("n = k").select("query_id", "phrase", "id").distinct()


def cover_density(places: list[tuple[int, int]], terms: int, weight: float = COVER_WEIGHT) -> float:
    """Sum of weight / (1 + other words inside) over the minimal covers of all terms; places: (position, term) in order."""
    last: dict[int, int] = {}
    score, ended = 0.0, -1
    for pos, term in places:
        last[term] = pos
        if len(last) == terms:
            start = min(last.values())
            if start > ended:  # no shorter cover begins at or after it
                score += weight / (1 + pos - start + 1 - terms)
                ended = start
    return score


def sparse_topk(terms: DataFrame, posted: DataFrame, n: int, weight: float = COVER_WEIGHT, *, within: DataFrame | None = None) -> DataFrame:
    """query_id, id, score and rank of the n best matches by cover density of the required terms; ties by id.

    within: the (query_id, id) that may be found; None for all.
    """
    required = terms.where("role = 'required'")
    numbered = required.withColumn("t", F.row_number().over(Window.partitionBy("query_id").orderBy("term")))
    sizes = required.groupBy("query_id").agg(F.count("*").alias("k"))
    matched = sparse_match(terms, posted)
    if within is not None:
        matched = matched.join(within, ["query_id", "id"], "left_semi")
    rows = (
        numbered.join(posted, "term").join(matched, ["query_id", "id"], "left_semi").select("query_id", "id", "t", F.explode("positions").alias("pos"))
        .groupBy("query_id", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("places")).join(sizes, "query_id")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores = [cover_density([(p["pos"], p["t"]) for p in ps], k, weight) for ps, k in zip(f["places"], f["k"])]
            yield pd.DataFrame({"query_id": f["query_id"], "id": f["id"], "score": scores})

    return ranked(rows.mapInPandas(run, "query_id long, id long, score double"), n)


def bm25_topk(terms: DataFrame, posted: DataFrame | Index, n: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score and rank of the n best rows that have any of the terms, by BM25.

    An index knows its frequencies and lengths, and leaves out blocks that can't hold one of the best; from postings alone
    both are counted over all of them.
    """
    if isinstance(posted, Index):
        return posted.bm25_topk(terms, n)
    length = posted.groupBy("id").agg(F.sum("tf").alias("len"))
    corpus = length.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    rows = terms.select("query_id", "term").distinct().join(df, "term").join(posted.select("term", "id", "tf"), "term").join(length, "id").crossJoin(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return ranked(rows.groupBy("query_id", "id").agg(exact_sum(one).alias("score")), n)


def ranked(rows: DataFrame, n: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rows with their rank by score, ties by id; the first n."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "id")
    out = rows.withColumn("rank", F.row_number().over(w))
    return out if n is None else out.where(F.col("rank") <= n)


def rrf(lists: DataFrame, k: int = 60, floor: float = 0.0) -> DataFrame:
    """query_id, id, score: sum of weight / (k + rank) over the lists (query_id, list, id, score, weight) that hold the id."""
    r = ranked(lists, by=("query_id", "list"))
    return r.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score")).where(F.col("score") >= floor)


def rrf_max(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, id, score and the list of the best single rank."""
    r = ranked(lists, by=("query_id", "list"))
    best = F.struct((1.0 / (k + F.col("rank"))).alias("s"), F.col("list").alias("l"))
    first = F.min_by(best, F.struct("rank", "list"))
    return r.groupBy("query_id", "id").agg(first.alias("b")).select("query_id", "id", F.col("b.s").alias("score"), F.col("b.l").alias("list"))


def hybrid_scores(dense: DataFrame, sparse: DataFrame, limit: int, least: float) -> DataFrame:
    """The union of both lists with the dense score, or the sparse one where that is missing or 0; the best `limit` from least on."""
    d, s = dense.select("query_id", "id", F.col("score").alias("ds")), sparse.select("query_id", "id", F.col("score").alias("ss"))
    score = F.coalesce(F.nullif("ds", F.lit(0.0)), F.nullif("ss", F.lit(0.0)), F.lit(0.0))
    both = d.join(s, ["query_id", "id"], "full").select("query_id", "id", score.alias("score"))
    return ranked(both.where(F.col("score") >= least), limit)


def hybrid_search(
    queries: DataFrame, corpus: DataFrame, posted: DataFrame | Posted, limit: int = 10, least: float = 0.7, analyzer: str = "simple", scope: DataFrame | None = None
) -> DataFrame:
    """Hybrid search of a table of queries (query_id, text, vector) over (id, vector) and the postings or the index of the same rows.

    scope: query_id, source_id. A query that is in it sees only the rows of its sources (corpus then has a source_id), none
    if that is null; the others see all. Both lists are taken from what a query sees. apply_context adds the contexts.
    """
    top = max(3 * limit, 20)
    if isinstance(posted, Posted):
        posted = posted.posted(query_terms(queries, analyzer))
    free = queries if scope is None else queries.join(scope, "query_id", "left_anti")
    dense, sparse = dense_topk(free, corpus, top), sparse_topk(query_terms(free, analyzer), posted, top)
    if scope is not None:
        own = queries.join(scope, "query_id", "left_semi")
        within = corpus.select("id", "source_id").join(scope.select("query_id", "source_id").distinct(), "source_id").select("query_id", "id")
        dense = dense.unionByName(dense_topk_by_ids(own.select("query_id", "vector"), within, corpus, top))
        sparse = sparse.unionByName(sparse_topk(query_terms(own, analyzer), posted, top, within=within))
    return hybrid_scores(dense, sparse, limit, least)


def first_stage(variants: DataFrame, corpus: DataFrame, posted: DataFrame | Posted, each: int = 20, fused: int = 50, k: int = 60) -> DataFrame:
    """Weighted fusion over all variants of a query: dense and sparse lists of each, the hyde variant dense only.

    variants: variant_id, query_id, name, weight, text, vector. Variants are rows, so that all are one search.
    """
    v = variants.withColumnRenamed("query_id", "_query").withColumnRenamed("variant_id", "query_id")
    if isinstance(posted, Posted):
        posted = posted.posted(query_terms(v.where("name <> 'hyde'")))
    dense = dense_topk(v, corpus, each).withColumn("kind", F.lit("dense"))
    sparse = sparse_topk(query_terms(v.where("name <> 'hyde'")), posted, each).withColumn("kind", F.lit("sparse"))
    lists = dense.unionByName(sparse).drop("rank").join(v.select("query_id", "_query", "name", "weight"), "query_id")
    named = lists.select(F.col("_query").alias("query_id"), F.concat_ws("/", "name", F.col("query_id").cast("string"), "kind").alias("list"), "id", "score", "weight")
    return ranked(rrf(named, k), fused)


def insight_first_stage(variants: DataFrame, corpus: DataFrame, posted: DataFrame | Posted, limit: int = 50, k: int = 60) -> DataFrame:
    """The best single rank over the hybrid lists of all variants."""
    v = variants.withColumnRenamed("query_id", "_query").withColumnRenamed("variant_id", "query_id")
    found = hybrid_search(v, corpus, posted, limit, 0.0).drop("rank").join(v.select("query_id", "_query", "name"), "query_id")
    return ranked(rrf_max(found.select(F.col("_query").alias("query_id"), F.col("name").alias("list"), "id", "score"), k), limit)


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: Callable[[Column, Column], Column] = cosine, n: int | None = 10, column: str = "vector") -> DataFrame:
    """Candidates (query_id, id) with the scorer's score of the two columns in place of theirs; the best n."""
    rows = candidates.select("query_id", "id").distinct().join(queries.select("query_id", F.col(column).alias("_q")), "query_id").join(corpus.select("id", F.col(column).alias("_c")), "id")
    return ranked(rows.select("query_id", "id", scorer(F.col("_q"), F.col("_c")).alias("score")), n)
