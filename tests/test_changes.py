"""Tables that change as one, insights built anew, and documents submitted batch by batch."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslink.operators import maintenance as M
from corpuslink.operators.vectors import hashed_embedding
from corpuslink.sources.snapshots import Conflict, Snapshots
from corpuslink.streaming import ingest as S


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_commit_changes_all_tables_or_none(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    assert store.version() == 0 and store.read() == {}
    two = lambda n: {"a": spark.range(n), "b": spark.range(n, 2 * n)}
    assert store.commit(two(3)) == 1
    old = store.read()
    broken = spark.range(9).select(F.when(F.col("id") > 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": spark.range(7), "b": broken})
    assert store.version() == 1 and [rows(store.read()[k]) for k in "ab"] == [[(0,), (1,), (2,)], [(3,), (4,), (5,)]]
    assert store.commit({"b": spark.range(1)}, base=1) == 2
    assert rows(store.read()["b"]) == [(0,)] and rows(store.read()["a"]) == [(0,), (1,), (2,)]
    assert rows(old["b"]) == [(3,), (4,), (5,)] == rows(store.read(1)["b"])  # who has begun to read goes on
    with pytest.raises(Conflict):
        store.commit({"a": spark.range(1)}, base=1)


def test_of_two_writers_of_a_version_one_raises(spark, tmp_path, monkeypatch):
    store, other = Snapshots(spark, f"file://{tmp_path}"), Snapshots(spark, f"file://{tmp_path}")
    store.commit({"a": spark.range(1)})
    seen = other._named()
    store.commit({"a": spark.range(2)})
    first = [seen]
    named = other._named
    monkeypatch.setattr(other, "_named", lambda version=None: first.pop() if first else named(version))
    with pytest.raises(Conflict):
        other.commit({"a": spark.range(3)})
    assert rows(store.read()["a"]) == [(0,), (1,)]


#: Stands for a model; a lambda, so that tasks need not import this file.
said = lambda texts: [json.dumps({"insights": [{"insight": x, "topics": [x[0]]} for x in t.split(";") if x]}) for t in texts]


def rebuilt_by_hand(chunks, links, insights, asked, force, least=0.95):
    linked = {c[1] for c in chunks if any(k == c[0] for k, _, _ in links)}
    skipped = {s: s in linked and not force for s in asked}
    links, insights = list(links), dict(insights)
    if force and linked & set(asked):
        gone = {c[0] for c in chunks if c[1] in asked}
        links = [x for x in links if x[0] not in gone]
        insights = {i: v for i, v in insights.items() if any(i == k for _, k, _ in links)}
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
    kept = {(c, i): t for c, i, t in links}
    vectors = {i: unit(hashed_embedding([x])[0]) for i, x in insights.items()}
    number = max(insights, default=-1)
    for chunk, source, _, text, deleted in sorted(chunks, key=lambda c: (c[1], c[2])):
        if source not in asked or skipped[source] or deleted:
            continue
        for x in [x for x in text.split(";") if x]:
            number += 1
            v = unit(hashed_embedding([x])[0])
            best = max(((round(float(v @ w), 12), -i) for i, w in vectors.items() if v @ w >= least), default=None)
            at = -best[1] if best else number
            if not best:
                vectors[at], insights[at] = v, x
            kept[chunk, at] = [x[0]]
    return sorted((c, i, tuple(t)) for (c, i), t in kept.items()), insights, skipped


CHUNKS = [(10, 1, 0, "red fox runs;blue sky above", False), (11, 1, 1, "red fox runs;", False), (12, 1, 2, "never read;", True), (20, 2, 0, "old news here;blue sky above", False), (30, 3, 0, "quite new words;red fox runs", False), (31, 3, 1, "", False)]
LINKS = [(10, 5, ["x"]), (20, 6, ["y"]), (20, 7, ["z"])]
INSIGHTS = {5: "stale insight", 6: "old news here", 7: "blue sky above", 8: "without a link"}


@pytest.mark.parametrize("force, asked", [(False, [1, 3]), (True, [1, 3]), (True, [3]), (False, [2]), (True, [1, 2, 3])])
def test_insights_are_built_anew(spark, force, asked):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, source_id long, chunk_index int, content string, is_deleted boolean").repartition(3)
    links = spark.createDataFrame(LINKS, "chunk_id long, insight_id long, topics array<string>")
    insights = spark.createDataFrame([(i, x, hashed_embedding([x])[0].tolist()) for i, x in INSIGHTS.items()], "insight_id long, content string, embedding array<float>")
    tables, skipped = M.rebuild_insights({"chunks": chunks, "links": links, "insights": insights}, spark.createDataFrame([(s,) for s in asked], "source_id long"), said, force=force)
    want_links, want_insights, want_skipped = rebuilt_by_hand(CHUNKS, LINKS, INSIGHTS, asked, force)
    assert sorted((r.chunk_id, r.insight_id, tuple(r.topics)) for r in tables["links"].collect()) == want_links
    assert {r.insight_id: r.content for r in tables["insights"].collect()} == want_insights
    assert {r.source_id: r.skipped for r in skipped.collect()} == want_skipped


def test_a_failing_rebuild_leaves_the_old_version(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, source_id long, chunk_index int, content string, is_deleted boolean")
    store = Snapshots(spark, f"file://{tmp_path}")
    store.commit({"links": spark.createDataFrame(LINKS, "chunk_id long, insight_id long, topics array<string>"), "insights": spark.createDataFrame([(i, x, hashed_embedding([x])[0].tolist()) for i, x in INSIGHTS.items()], "insight_id long, content string, embedding array<float>")})
    asked = spark.createDataFrame([(1,)], "source_id long")
    built, _ = M.rebuild_insights({"chunks": chunks, **store.read()}, asked, said, force=True)
    broken = built["insights"].withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"links": built["links"], "insights": broken}, base=1)
    assert sorted((r.chunk_id, r.insight_id) for r in store.read()["links"].collect()) == [(c, i) for c, i, _ in LINKS]
    assert store.commit(built, base=1) == 2


def test_old_and_late_files_are_kept_and_copies_rejected(spark, tmp_path):
    where, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    os.mkdir(where)

    def arrives(name, text, age=0):
        path = f"{where}/{name}.txt"
        with open(path, "w") as f:
            f.write(text)
        if age:
            os.utime(path, (os.path.getmtime(path) - age,) * 2)

    def run():
        S.ingest_stream(spark, where, out, progress).awaitTermination()
        told = spark.read.parquet(f"{out}/submitted")
        names = {r.source_id: r.name for r in spark.read.parquet(f"{out}/sources").collect()}
        return sorted((r.accepted, names.get(r.source_id if r.accepted else r.existing_id)) for r in told.collect())

    arrives("a", "One Sentence. Another One.")
    arrives("b", "Other words.")
    assert run() == [(True, "a"), (True, "b")]
    arrives("c", "A day old by its time.", age=86_400)
    arrives("d", "Months old by its time.", age=100 * 86_400)
    arrives("e", "Other words.")
    assert run() == [(False, "b"), (True, "a"), (True, "b"), (True, "c"), (True, "d")]
    arrives("f", "One Sentence. Another One.", age=3600)
    arrives("g", "New in the third batch.")
    arrives("h", "New in the third batch.")
    got = run()
    assert got.count((True, "a")) == 1 and (False, "a") in got and sum(ok for ok, _ in got) == 5
    chunks, mentions = S.process(spark.read.parquet(f"{out}/sources"))
    key = lambda df: sorted((r.chunk_id, r.content) for r in df.collect())
    assert key(spark.read.parquet(f"{out}/chunks")) == key(chunks)
    assert spark.read.parquet(f"{out}/mentions").count() == mentions.count() > 0


def test_a_batch_that_is_replayed_decides_the_same(spark, tmp_path):
    known = f"file://{tmp_path}/md5s"
    made = lambda *r: spark.createDataFrame(r, "source_id string, md5 string, arrived_at long")
    decided = lambda df: sorted((r.source_id, r.accepted, r.existing_id) for r in df.collect())
    first = made(("s1", "aa1", 1), ("s2", "aa1", 2), ("s3", "bb1", 1))
    second = made(("s4", "aa1", 0), ("s5", "cc1", 0))
    once = decided(S.submit_batch(first, known, 0)), decided(S.submit_batch(second, known, 1))
    assert once == ([("s1", True, None), ("s2", False, "s1"), ("s3", True, None)], [("s4", False, "s1"), ("s5", True, None)])
    assert (decided(S.submit_batch(first, known, 0)), decided(S.submit_batch(second, known, 1))) == once
    live = spark.createDataFrame([("s3",), ("s5",)], "source_id string")
    assert decided(S.submit_batch(made(("s6", "aa1", 0), ("s7", "bb1", 0)), known, 2, live)) == [("s6", True, None), ("s7", False, "s3")]
    assert decided(S.submit_batch(first.limit(0), known, 3)) == []
