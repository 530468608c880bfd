"""Searches over cells of vectors against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslink.operators import cells
from corpuslink.operators.cells import Cells
from corpuslink.operators.vectors import dense_pair_count, dense_pairs, dense_topk


def clustered(n=300, centres=15, noise=0.15, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, 24))
    x = at[rng.integers(0, centres, n)] + rng.normal(size=(n, 24)) * noise
    x[5] = 0
    x[[7, 9]] = x[8]
    return x.astype(np.float32)


def cosines(x):
    u = x.astype(np.float64)
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)
    return u @ u.T


@pytest.fixture(scope="module")
def x():
    return clustered()


@pytest.fixture(scope="module")
def corpus(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(9999, None, 1.0)], "id long, vector array<float>, score double").repartition(3)


@pytest.fixture(params=[(1024, 2_000, 8_000), (10, 7, 11)])
def blocks(request, monkeypatch):
    cell, query, held = request.param
    monkeypatch.setattr(cells, "CELL", cell)
    monkeypatch.setattr(cells, "QUERY_BLOCK", query)
    monkeypatch.setattr(cells, "CORPUS_BLOCK", held)
    monkeypatch.setattr(cells, "STEP", 50 * held)
    return cell


@pytest.mark.parametrize("least", [0.95, -0.2])
def test_all_pairs_from_a_threshold(corpus, x, blocks, least):
    c = Cells(corpus)
    q = corpus.selectExpr("id as query_id", "vector", "score as id")
    got = sorted((r.query_id, r.id) for r in dense_pairs(q, c, least, earlier=True).collect())
    i, j = np.nonzero(cosines(x) >= least)
    assert got == sorted((a, b) for a, b in zip(i.tolist(), j.tolist()) if a > b)
    assert dense_pair_count(q, c, least) == len(i)


def test_clustered_vectors_meet_few_others(corpus, x, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 10)
    c = Cells(corpus)
    q = corpus.selectExpr("id as query_id", "vector")
    assert dense_pairs(q, c, 0.95).count() >= len(x)
    assert 0 < c.compared < 0.1 * len(x) ** 2
    c.compared = 0
    assert dense_topk(q, c, 5).count() == 5 * len(x)
    assert 0 < c.compared < 0.2 * len(x) ** 2  # both visits


@pytest.mark.parametrize("n, others", [(1, False), (40, True), (1000, True)])
def test_nearest_against_all(corpus, x, blocks, n, others):
    s = np.round(cosines(x), 12)
    if others:
        np.fill_diagonal(s, -9)
    asked = corpus.where("id < 40 or id > 9000").selectExpr("id as query_id", "vector")
    got: dict = {}
    for r in dense_topk(asked, corpus, n, others=others).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert sorted(got) == list(range(40))
    for i in range(40):
        order = np.lexsort((np.arange(len(x)), -s[i]))[: min(n, len(x) - others)]
        assert [got[i][k + 1] for k in range(len(got[i]))] == order.tolist()


def test_best_of_each_cell(corpus, x, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 10)
    c = Cells(corpus)
    got: dict = {}
    for r in dense_pairs(corpus.selectExpr("id as query_id", "vector"), c, 0.8, best=True).collect():
        got[r.query_id] = max(got.get(r.query_id, (-9, 0)), (round(r.score, 12), -r.id))
    s = np.round(cosines(x), 12)
    assert got == {i: (s[i].max(), -int(s[i].argmax())) for i in range(len(x)) if i != 5}


def test_empty_sides(corpus):
    none = corpus.limit(0)
    asked = corpus.selectExpr("id as query_id", "vector")
    assert dense_topk(asked, none, 3).count() == 0
    assert dense_pairs(asked, none, 0.5).count() == 0
    assert dense_topk(asked.limit(0), corpus, 3).count() == 0


def test_lists_that_grow_by_batches(spark, monkeypatch):
    """Ties, lists shorter than k, null vectors and insights without another source; blocks of a few rows."""
    from corpuslink.operators import insights as I

    monkeypatch.setattr(I, "QUERY_BLOCK", 9)
    monkeypatch.setattr(I, "CORPUS_BLOCK", 13)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(50, 3)), 1)
    x[20:24] = x[3]
    rows = [(i, None if i == 17 else v.tolist(), [f"s{k}" for k in {int(i) % 4, int(rng.integers(6))}]) for i, v in enumerate(x)]
    rows[30] = (30, rows[30][1], [f"s{k}" for k in range(6)])
    df = spark.createDataFrame(rows, "id long, vector array<double>, sources array<string>").repartition(3)
    key = lambda near: sorted((r.a, r.b, r.s) for r in near.collect())
    want = key(I.nearest_apart(df, df, 4))
    part = lambda n: df.where(f"id % 3 = {n}")
    near = I.extend_nearest(I.nearest_apart(part(2), part(2), 4), part(2), part(0), 4)
    assert key(I.extend_nearest(near, part(2).unionByName(part(0)), part(1), 4)) == want
    s = np.round(cosines(x), 12)
    for i, v, own in rows:
        others = [] if v is None else [(-s[i, j], j) for j, w, theirs in rows if j != i and w is not None and not set(own) & set(theirs)]
        assert sorted(b for a, b, _ in want if a == i) == sorted(j for _, j in sorted(others)[:4])


def test_a_query_goes_once_to_cells_that_fit_one_task(corpus, x, monkeypatch):
    """it was sent to each of its cells, in one frame for all of them, and each cell answered for itself."""
    monkeypatch.setattr(cells, "CELL", 10)
    c = Cells(corpus)
    assert len(c.bounds.cell) > 20 and set(c._units(len(x))) == {0}
    assert [len(f) for f in cells._sliced(iter([c.rows.toPandas()]), cells.SLICE // 100)] == [100, 100, 100]
    one = c.meet(corpus.selectExpr("id as query_id", "vector").where("vector is not null"), c.bounds.within(np.pi), lambda t: pd.DataFrame({"k": [len(t.asks)]}), "k long")
    assert [r.k for r in one.collect()] == [len(x)]


@pytest.mark.parametrize("spare", [0, 1])
def test_first_look_in_single_precision_loses_nothing(spare):
    rng = np.random.default_rng(5)
    y = cells.unit(pd.Series(list(rng.normal(size=(700, 8)))))
    y[[3, 9, 600]] = y[50]
    y[4] = y[50] + 1e-9
    y[8] = np.nan
    ids = np.arange(700)
    best = cells.Best(y, y, ids, 5, np.full(700, -2.0), spare)
    for lo in range(0, 700, 90):
        best.add(ids, ids[lo : lo + 90], own=ids if spare else None)
    s = np.round(y @ y.T, 12)
    s[:, 8] = s[8] = -np.inf
    if spare:
        np.fill_diagonal(s, -np.inf)
    i, j, _ = best.rows()
    for k in set(range(700)) - {8}:
        assert j[i == k].tolist() == np.lexsort((ids, -s[k]))[:5].tolist()
    assert 8 not in i and 8 not in j


def test_related_asks_for_no_more_links_than_it_shows(spark, small, monkeypatch):
    """all pairs from the threshold on were made, for the first three of each row."""
    from corpuslink.operators import vectors as V
    from corpuslink.plans import pipeline_queries as P
    from corpuslink.plans.tables import Tables

    monkeypatch.setattr(V, "dense_pairs", lambda *a, **k: pytest.fail("all pairs"))
    got = P.i07_related(Tables(spark, small)).collect()
    assert got and max(r["rank"] for r in got) <= 3 and min(r.similarity for r in got) >= 0.3


def test_mutual_links_of_some(spark):
    """the links of a few seeds are those of all, without the lists of all."""
    from corpuslink.operators import insights as I

    x = clustered(120, 6, 0.5, 4)
    df = spark.createDataFrame([(i, v.tolist(), [f"s{i % 3}"]) for i, v in enumerate(x)], "id long, vector array<float>, sources array<string>")
    rows = lambda d: sorted((r.src, r.dst, round(r.similarity, 9)) for r in d.collect())
    want = [r for r in rows(I.mutual_links(df, 4)) if r[0] in (3, 40, 77)]
    assert want and rows(I.mutual_links(df, 4, df.where("id in (3, 40, 77)").select("id"))) == want


def test_more_entities_than_five_thousand_ask(spark):
    """those beyond the 5,000 most mentioned asked nothing."""
    from corpuslink.operators.graph import semantic_edges

    angle = np.append(np.linspace(0, 1.5, 5000), [3.0, 3.01, 3.5])
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    mentions = spark.createDataFrame([(i, i, i) for i in range(5000)], "chunk_id long, source_id long, entity long")
    edges = semantic_edges(spark.createDataFrame(rows, "entity long, vector array<double>"), mentions, 0.5, 1)
    assert {(r.a, r.b) for r in edges.where("a >= 5000").collect()} == {(5000, 5001), (5001, 5002)}


def test_chunks_of_a_source_are_counted_before_its_jobs_are_joined(spark):
    """each chunk met each job of its source."""
    from corpuslink.operators.catalog import image_placeholder_sources

    chunks = spark.createDataFrame([(i % 4, 1, "a <!-- image -->", False) for i in range(8)] + [(9, 2, "a", False)], "chunk_id long, source_id long, content string, is_deleted boolean")
    jobs = spark.createDataFrame([(1, 10, "completed"), (1, 10, "completed"), (1, 11, "completed"), (1, 12, "failed"), (2, 13, "completed")], "source_id long, job_id long, status string")
    out = image_placeholder_sources(chunks, jobs)
    assert sorted(map(tuple, out.select("source_id", "job_id", "n_chunks").collect())) == [(1, 10, 4), (1, 11, 4)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("count(distinct chunk_id")


@pytest.mark.parametrize("name", ["d05_heading_only_sources", "d06_image_placeholder_sources"])
def test_jobs_of_all_sources_are_read(spark, small, tmp_path, name):
    """F4 of the fourth review: jobs of sources from 10 on were left out, which the given labels don't reach."""
    from corpuslink.plans import registry
    from helpers import TABLES, rows_of, rows_of_sql

    for t in TABLES:
        if t != "embeddings":
            (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    spark.read.parquet(f"{small}/embeddings.parquet").withColumn("label", (F.col("label") * 7).cast("int")).coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    got = rows_of(registry.queries()[name](spark, str(tmp_path)))
    assert got == rows_of_sql(registry.oracle_sql()[name], str(tmp_path))
    assert max(r[got[0].index("source_id")] for r in got[1]) >= 10


def test_a_store_is_compared_once(spark, monkeypatch):
    """new insights were compared with all stored ones twice, each pair in double precision."""
    import numpy as np

    from corpuslink.operators import insights as I

    rng, made = np.random.default_rng(4), []
    store = rng.standard_normal((60, 8))
    new = np.vstack([store[:10] + 0.01, rng.standard_normal((30, 8)), store[20:22]])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)

    class Counted(I.Cells):
        def __init__(self, corpus):
            super().__init__(corpus)
            made.append(self)

    monkeypatch.setattr(I, "Cells", Counted)
    frame = lambda x, n: spark.createDataFrame([(n + k, [float(v) for v in row]) for k, row in enumerate(x)], "seq long, vector array<double>")
    got = {r.seq: r.insight_seq for r in I.dedup_in_order(frame(new, 100), 0.9, frame(store, 0)).collect()}
    assert made[0].compared == len(new) * len(store)
    kept, want = dict(enumerate(store)), {}
    for k, row in enumerate(new, 100):
        near = [(-round(float(unit(row[None])[0] @ unit(v[None])[0]), 12), n) for n, v in kept.items()]
        score, n = min(near)
        want[k] = n if -score >= 0.9 else k
        if want[k] == k:
            kept[k] = row
    assert got == want
