"""Chunks of whole documents against a plain composition, text by text."""

import re

from pyspark.sql import functions as F

from corpuslink.functions.text import WORDS, TokenCounter
from corpuslink.operators import chunking as K
from corpuslink.operators import expansion as E
from corpuslink.plans import registry, text_queries
from corpuslink.plans.tables import Tables


def _count(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def _semantic(text, most):
    out, total = [], 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+|\n{2,}", text)):
        if not s:
            continue
        n = _count(s)
        if not out or total + n > most:
            out.append([])
            total = 0
        out[-1].append(s)
        total += n
    return [" ".join(x) for x in out]


def _cut(text, strategy, most):
    return _semantic(text, most) if strategy == "semantic" else K.markdown_pieces(text) if strategy == "markdown_header" else K.recursive_pieces(text, 4 * most)


def _levels(text, strategy):
    rows = []
    for parent in _cut(text, strategy, 2000):
        at = len(rows)
        rows.append((at, None, strategy, None, parent))
        for child in _cut(parent, strategy, 400):
            rows.append((len(rows), at, "hierarchical", strategy, child))
    return rows


def _docs(spark, small):
    t = Tables(spark, small)
    docs = text_queries._headed(t).withColumn("p", F.expr(text_queries._PROFILE))
    return docs.select("doc_id", "text", "p.avg_section_length", K.select_strategy(F.col("p")).alias("strategy")).collect()


def _rows(df):
    return sorted((r.doc_id, r.chunk_index, r.parent_index, r.strategy, r.base_strategy, r.content) for r in df.collect())


def test_chunk_documents(spark, small):
    want = []
    for d in _docs(spark, small):
        flat = [(i, None, d.strategy, None, c) for i, c in enumerate(_cut(d.text, d.strategy, 400))]
        want += [(d.doc_id, *r) for r in (_levels(d.text, d.strategy) if d.avg_section_length == "long" else flat)]
    got = _rows(registry.queries()["t06_chunk_documents"](spark, small))
    assert got == sorted(want) and {r[3] for r in got} == {"semantic", "recursive", "markdown_header", "hierarchical"}


def test_hierarchy_of_all_strategies(spark, small):
    want = sorted((d.doc_id, *r) for d in _docs(spark, small) for r in _levels(d.text, d.strategy))
    assert _rows(registry.queries()["t07_chunk_hierarchical"](spark, small)) == want


def test_profiles_of_the_three_structures(spark):
    names = ("structure_type", "heading_consistency", "primary_content_type", "content_density")
    rows = [
        ("well-structured", "consistent", "transcript", "uniform", "markdown_header"), ("well-structured", "none", "prose", "uniform", "semantic"),
        ("loosely-structured", "consistent", "prose", "uniform", "semantic"), ("unstructured", "none", "qa_pairs", "uniform", "semantic"),
        ("unstructured", "none", "prose", "uniform", "recursive"), ("unstructured", "none", "prose", "variable", "semantic"),
    ]
    df = spark.createDataFrame(rows, [*names, "want"])
    assert [r.got for r in df.select(K.select_strategy(F.struct(*names)).alias("got")).collect()] == [r[-1] for r in rows]


def test_markdown_pieces():
    assert K.markdown_pieces("") == []
    assert K.markdown_pieces("#### low\n# A\n```\n# no heading\n```\ntext  \n## B") == ["#### low\n\n# A\n```\n# no heading\n```\ntext", "## B"]
    long = K.markdown_pieces("# T\n" + "word " * 900)
    assert len(long) > 1 and long[0].startswith("# T\n\nword") and all(len(x.removeprefix("# T\n\n")) <= 1600 for x in long)
    assert K.markdown_pieces("#tag\nbody") == ["#tag\nbody"]


def test_texts_without_chunks(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "One.")], "doc_id long, text string")
    for f in (K.semantic_chunks, K.recursive_chunks, K.markdown_chunks):
        assert [(r.doc_id, r.content) for r in f(docs).collect()] == [(4, "One.")]


def test_another_token_counter(spark):
    """Characters as tokens: the same counter for columns and for what is cut in Python."""
    letters = TokenCounter(F.length, len)
    text = "# One\n" + "aa bb. " * 20 + "\n# Two\nshort."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = K.semantic_chunks(docs, max_tokens=30, counter=letters).collect()
    assert all(r.token_count == len(r.content) <= 30 + r.content.count(". ") for r in rows) and len(rows) > 3  # sentences are counted, not the spaces between
    wide = "abcdefghijklmnop " * 12
    assert len(K.markdown_pieces(wide, 25, len)) > len(K.markdown_pieces(wide, 25)) == 1
    marked = K.markdown_chunks(docs, counter=letters).collect()
    assert [r.token_count for r in marked] == [len(r.content) for r in marked]
    corpus = spark.createDataFrame([(k, 0, k, "x" * 40) for k in range(4)], "id long, source_id long, chunk_index int, text string")
    context = lambda **kw: E.expand_context(corpus.where("id = 1"), corpus, low=70, high=90, **kw).first().context
    assert context(counter=letters) == "x" * 40 + "\n\n" + "x" * 40 and len(context()) == 40 * 4 + 6
    assert WORDS.plain("ab, c1_d!") == spark.range(1).select(WORDS.column(F.lit("ab, c1_d!"))).first()[0] == 4


def test_best_rows_within_a_budget(spark):
    rows = spark.createDataFrame([(k % 2, k, "w " * k) for k in range(20)], "key long, rank int, text string")
    got = sorted((r.key, r["rank"]) for r in K.best_rows(rows, "key", 5, ("rank",), "text", 12).collect())
    assert got == [(0, 0), (0, 2), (0, 4), (0, 6), (1, 1), (1, 3), (1, 5)]
    plan = K.best_rows(rows, "key", 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # tasks cut before the shuffle


def test_an_answer_names_all_results(spark, small):
    """it named the first twenty of a source."""
    from corpuslink.plans import text_queries as T
    from corpuslink.plans.tables import Tables

    t = Tables(spark, small)
    n = {r.source: r["count"] for r in t.documents.groupBy("source").count().collect()}
    assert {r.source: r.prompt.count('"doc_id"') for r in T.t12_answer_context(t).collect()} == n


def test_pieces_leave_in_frames():
    """all pieces of a batch of texts were one frame."""
    from corpuslink.operators.chunking import _framed

    rows = [(k, "x" * 40) for k in range(10)]
    frames = list(_framed(iter(rows), ["k", "content"], 100))
    assert [len(f) for f in frames] == [3, 3, 3, 1] and [tuple(r) for f in frames for r in f.to_numpy().tolist()] == rows
    assert list(_framed(iter([]), ["k", "content"])) == []


def test_chunks_beyond_the_first_of_a_source_leave_early(spark, small):
    """whole communities were ordered in one task, and names were shuffled with the mentions."""
    from corpuslink.operators import graph as G
    from corpuslink.plans import graph_queries as Q
    from corpuslink.plans.tables import Tables

    scored = spark.createDataFrame([(1, c, c % 2, 10.0 - c) for c in range(20)] + [(1, 50, 7, 0.5)], "community long, chunk_id long, source_id long, score double")
    picked = G.pick_chunks(scored)
    assert [r.chunk_id for r in picked.orderBy("rank").collect()] == [0, 1, 50, 2, 3]
    assert picked._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2
    plan = Q.mentions_of(Tables(spark, small))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "p_name" in line and ("Aggregate" in line or "Project" in line)]
