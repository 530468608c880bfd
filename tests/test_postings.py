"""The stored index against postings that are counted anew."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslink.operators import postings as P
from corpuslink.operators import ranking as N
from corpuslink.operators.postings import Index


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(i * 7, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 60)))) for i in range(300)]
    # Few rows that are about one rare thing: the blocks without them can't reach the floor.
    rows += [(5000 + i, "rare rare rare thing thing") for i in range(6)] + [(6000, None), (6001, ""), (6002, "..."), (6003, "rare " + "w0 " * 300)]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    before, P.BLOCK = P.BLOCK, 10
    yield Index.build(docs, f"file://{tmp_path_factory.mktemp('index')}/one")
    P.BLOCK = before


TERMS = [(0, "w0"), (0, "w3"), (0, "w0"), (1, "rare"), (1, "thing"), (2, "none"), (3, "w50"), (3, "none"), (4, "w1")]


def terms_of(spark):
    return spark.createDataFrame(TERMS, "query_id long, term string").withColumn("role", F.lit("required"))


@pytest.mark.parametrize("named", [10_000, 2])
def test_same_rows_as_from_all_postings(spark, docs, index, monkeypatch, named):
    monkeypatch.setattr(P, "NAMED", named)
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.score, 9))
    got = sorted(map(key, N.bm25_topk(terms_of(spark), index, 5).collect()))
    assert got == sorted(map(key, N.bm25_topk(terms_of(spark), N.postings(docs), 5).collect()))
    assert {q for q, *_ in got} == {0, 1, 3, 4}
    scored, there = index.visited
    assert scored < there


def test_blocks_below_the_floor_are_not_read(spark, index):
    rare = spark.createDataFrame([(0, "rare"), (0, "w0")], "query_id long, term string")
    assert index.bm25_topk(rare, 3).count() == 3
    scored, there = index.visited
    assert there >= 30 and scored < there / 3


def test_postings_of_the_asked_terms_only(spark, docs, index):
    asked = terms_of(spark)
    got = sorted((r.term, r.id, tuple(r.positions), r.tf) for r in index.posted(asked).collect())
    want = N.postings(docs).join(asked.select("term").distinct(), "term", "left_semi")
    assert got == sorted((r.term, r.id, tuple(r.positions), r.tf) for r in want.collect())
    plan = index.posted(asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan.split("PushedFilters: [")[1].split("\n")[0]


def test_hybrid_search_over_the_index(spark, docs, index):
    queries = spark.createDataFrame([(0, "w0 w3", [1.0, 0.0]), (1, "thing", [0.0, 1.0])], "query_id long, text string, vector array<double>")
    corpus = docs.withColumn("vector", F.array(F.sin("id"), F.cos("id")))
    rows = lambda posted: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in N.hybrid_search(queries, corpus, posted, 5, 0.1).collect())
    assert rows(index) == rows(N.postings(docs)) != []


def test_no_documents(spark, docs, tmp_path):
    index = Index.build(docs.where("id > 9999"), f"file://{tmp_path}/none")
    assert index.bm25_topk(terms_of(spark), 3).count() == 0 and index.posted(terms_of(spark)).count() == 0


def test_postings_of_the_asked_terms(spark):
    """All postings were shuffled for a search that asks a few terms."""
    from corpuslink.operators import ranking as N

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "d")], "id long, text string")
    key = lambda df: sorted((r.term, r.id, tuple(r.positions), r.tf) for r in df.collect())
    got = key(N.Asked(docs).posted(spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "term string")))
    assert got == key(N.postings(docs).where("term in ('a', 'b')")) == [("a", 1, (0, 2), 2), ("b", 1, (1,), 1), ("b", 2, (0,), 1)]


def test_named_candidates_take_part_once(spark):
    from corpuslink.operators import vectors as V

    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, None)], "id long, vector array<double>")
    held = spark.createDataFrame([(i, n) for i in (0, 1, 2, 3, 9) for n in "xy"] + [(5, "z"), (4, "y")], "id long, name string")
    asks = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [0.0, 1.0]), (2, "y", [1.0, 0.0]), (3, "w", [1.0, 0.0]), (4, "y", None)], "query_id long, name string, vector array<double>")
    got = V.dense_topk_by_names(asks, held, corpus, 2, ("name",), ("query_id",))
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == [(0, 1, 3), (0, 2, 2), (1, 1, 0), (1, 2, 1), (2, 1, 4), (2, 2, 3)]


def test_equal_parts_tie_in_any_order(spark):
    """F8: sums of doubles depend on their order, so that copies of a text differed in the last digits."""
    from functools import reduce

    from pyspark.sql import functions as F

    from corpuslink.operators.postings import exact_sum

    parts = [0.1, 1e-9, 7.3, 0.7, 3.14159, 1 / 3]
    rows = [(k, float(x)) for k in range(6) for x in parts[k:] + parts[:k]]
    sums = {r.s for r in spark.createDataFrame(rows, "k long, x double").groupBy("k").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert len({reduce(float.__add__, parts[k:] + parts[:k]) for k in range(6)}) > 1 and len(sums) == 1


def test_matches_count_only_the_terms_they_ask_for(spark, small, monkeypatch):
    """postings of all terms were counted for a query of three."""
    from corpuslink.operators import ranking as N
    from corpuslink.plans import search_queries as S
    from corpuslink.plans.tables import Tables

    counted = []
    real = N.sparse_match
    monkeypatch.setattr(N, "sparse_match", lambda terms, posted, phrases=None: counted.append(posted) or real(terms, posted, phrases))
    assert S.v08_phrases_with_terms(Tables(spark, small)).count() > 0
    assert {r.term for r in counted[0].select("term").distinct().collect()} == {"of", "the", "that"}
