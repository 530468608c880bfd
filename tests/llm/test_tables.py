"""Sharding, quality rules, URL rules, mixing and vectors."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuslink.llm import mixing, quality, sharding, urls, vectors

# -- sharding


def test_least_capacity_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes, k = [rng.randint(1, 20) for _ in range(rng.randint(1, 12))], rng.randint(1, 5)

        def fits(c):
            used, room = 1, c
            for s in sizes:
                if s > c:
                    return False
                if s > room:
                    used, room = used + 1, c
                room -= s
            return used <= k

        assert sharding.least_capacity(sizes, k) == next(c for c in range(1, 400) if fits(c))


def test_a_hot_unit_stands_alone():
    alone, starts = sharding.plan_shards([(0, 10), (1, 1000), (2, 10), (3, 10)], 4)
    assert alone == [1] and len(starts) == 2


def test_shards(spark, messy):
    rows = sharding.shard(messy, 8).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in messy.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_shards_are_near_equal(spark, small):
    rows = sharding.shard(spark.read.parquet(f"{small}/documents.parquet"), 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in rows]
    assert len(sizes) == 8 and max(sizes) < 1.35 * sum(sizes) / 8


def test_no_shards(no_docs):
    assert sharding.shard(no_docs).count() == 0


# -- quality


def counts(text):
    t = text or ""
    for s in "\t\n\x0b\x0c\r":
        t = t.replace(s, " ") if s != "\n" else t
    w = t.replace("\n", " ").split(" ")
    w = [x for x in w if x]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if n[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, messy):
    extra = [(900, "a b c d e a b c d e", *[None] * 10), (901, "x y\nx y\n \nx y \n# $ é%", *[None] * 10), (902, "a a a a a a a", *[None] * 10), (903, "🙂 é\u2003ü 1 2 3 4 5 6 7 8 9", *[None] * 10)]
    docs = messy.union(spark.createDataFrame(extra, messy.schema))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    want = Counter()
    for r in docs.collect():
        c = counts(r.text)
        want[(r.doc_id, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want


def test_verdict(spark):
    good = "The story of the house is that it was built in the year of the flood and stood for all of us to see."
    bad = " ".join(f"word{i}%%% the" for i in range(20))
    loud = " ".join(["THE HOUSE WAS BUILT IN THE YEAR OF FIRE", "AND WATER FOR ALL OF US TO SEE AGAIN NOW"])
    rows = [(1, good), (2, bad), (3, loud), (4, None), (5, "short text")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_quality_is_its_sql(spark, small):
    from helpers import rows_of, rows_of_sql

    from corpuslink.llm import queries

    assert rows_of(queries.QUERIES["op9_quality_rules"](spark, small)) == rows_of_sql(queries.ORACLE_SQL["op9_quality_rules"], small)


def test_quality_keeps_good_labels(spark, small):
    got = quality.quality_rules(spark.read.parquet(f"{small}/documents.parquet")).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    rows = [r for r in got.collect() if not r.base_failed]
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.99 * sum(r.quality == 1 for r in rows)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in rows)


def test_no_quality(no_docs):
    assert quality.quality_rules(no_docs).count() == 0


# -- URLs

URLS = [
    ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12?x#y", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://x.org", "x.org", "", None, "allow"), ("http://x.org/?a", "x.org", "/", "org/", "allow"), ("ftp://b.com/de/x", "b.com", "/de/x", "com/de/", "block"), ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
    ("http://xcom/de/", "xcom", "/de/", None, "allow"), (None, "", "", None, "allow"), ("no url", "", "", None, "allow"), ("://?q", "", "", None, "allow"), ("http://a://b/c", "a:", "//b/c", None, "allow"), ("http://É.ORG/p", "É.org", "/p", "org/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "h", "x")], "page_id long, url string, host string, hit string")
    labels = spark.createDataFrame([(0, 1, None), (1, None, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = Counter(map(tuple, urls.filter_urls(pages, labels).collect()))
    want = Counter((i, *rest) for i, (_, *rest) in enumerate(URLS))
    want[(0, *URLS[0][1:])] += 1
    assert got == want
    assert urls.filter_urls(pages.where("false"), labels).count() == 0
    assert urls.filter_urls(pages, labels.where("false")).count() == len(URLS) + 1


def test_rules_are_mined_and_matched(spark):
    rows = [(i, f"http://{'casino' if i % 4 == 0 else 'news'}.example.net/{'win' if i % 4 == 0 else 'a'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, 1 if i % 4 == 0 and i % 20 else 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, labels, min_support=0.05, min_confidence=0.6).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i in range(200)}


def test_rules_against_all_token_sets(spark):
    """Mined rules against counts of all token sets of a small table, noise among them."""
    from itertools import combinations

    rng = random.Random(12)
    rows = [(f"http://h{rng.randrange(3)}.net/{'win' if rng.random() < 0.3 else 'a'}/{rng.choice('xyz')}{rng.randrange(5)}",) for _ in range(400)]
    rows = [(u, rng.random() < (0.9 if "win" in u else 0.2)) for (u,) in rows]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r.antecedent): r.confidence for r in urls.mine_rules(df, 0.002, 0.6).collect()}
    baskets = [(set(r.t), r.bad) for r in df.select(urls.tokens_of(df.url).alias("t"), "bad").collect()]
    sets = {c for t, _ in baskets for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}
    base, every = sum(b for _, b in baskets) / len(baskets), {}
    for c in sets:
        n = sum(t.issuperset(c) for t, _ in baskets)
        bad = sum(b for t, b in baskets if t.issuperset(c))
        p = bad / n
        low = (p + 9 / (2 * n) - 3 * (p * (1 - p) / n + 9 / (4 * n * n)) ** 0.5) / (1 + 9 / n)
        if bad >= 20 and p >= 0.6 and low > base:
            every[c] = p
    want = {c: p for c, p in every.items() if not any(len(d) < len(c) and set(d) < set(c) and q >= p - 1e-12 for d, q in every.items())}
    assert got == pytest.approx(want) and any("p:win" in c for c in got)


def test_few_rows_are_no_evidence(spark):
    rows = [(i, f"http://a{i}.net/{'z' if i < 15 else 'y'}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i < 15)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {r.verdict for r in got} == {"allow"}


@pytest.mark.parametrize("most", [0, 2000])
def test_rules_match_with_or_without_a_literal_index(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST", most)
    test_rules_are_mined_and_matched(spark)


# -- mixing


def test_rake_meets_the_targets():
    cells = {("a", "x"): 0.5, ("a", "y"): 0.1, ("b", "x"): 0.1, ("b", "y"): 0.3}
    w = mixing.rake(cells, [{"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6}], 100)
    for d, target in enumerate(({"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6})):
        for v, share in target.items():
            assert sum(x for c, x in w.items() if c[d] == v) == pytest.approx(share)
    assert w["a", "x"] * w["b", "y"] / (w["a", "y"] * w["b", "x"]) == pytest.approx(15)


def test_mixture(spark, messy, small):
    rows = mixing.mixture(messy).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in messy.collect())
    assert all(0 <= r.probability <= 1 for r in rows)
    assert mixing.mixture(messy.where("false")).count() == 0
    assert all(r.kept for r in mixing.mixture(messy.where("text is null")).collect())
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    got = mixing.mixture(docs).collect()
    kept = Counter()
    for r in got:
        kept[r.source] += r.n_tokens * r.probability
    present = Counter()
    for r in got:
        present[r.source] += r.n_tokens
    raised = {s: (n / sum(present.values())) ** 0.8 for s, n in present.items()}
    for s, n in kept.items():
        assert n / sum(kept.values()) == pytest.approx(raised[s] / sum(raised.values()), rel=0.02)


def test_a_rare_cell_costs_the_others_nothing(spark):
    rows = [(i, "w " * (100 + i % 7), "en", "big") for i in range(3000)] + [(9000 + i, "w " * 100, "de", "mid") for i in range(600)]
    schema = "doc_id long, text string, lang string, source string"
    for extra in ([], [(9999, "one", "fr", "tiny")]):
        got = mixing.mixture(spark.createDataFrame(rows + extra, schema)).collect()
        total = sum(r.n_tokens for r in got)
        assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(total / 2, rel=1e-6)
        assert sum(r.n_tokens for r in got if r.kept) == pytest.approx(total / 2, rel=0.05)
        assert {r.source for r in got if r.short} == {r[3] for r in extra} and all(r.kept for r in got if r.short)


def test_scale_meets_the_budget():
    rng = random.Random(4)
    for _ in range(100):
        share = [rng.random() ** 3 + 1e-9 for _ in range(rng.randint(1, 30))]
        w = [rng.random() for _ in share]
        share, w = [x / sum(share) for x in share], [x / sum(w) for x in w]
        budget = rng.random()
        c = mixing.scale_for(budget, lambda c: (sum(s for s, x in zip(share, w) if x * c >= s), sum(x for s, x in zip(share, w) if x * c < s)))
        assert sum(min(s, c * x) for s, x in zip(share, w)) == pytest.approx(budget, rel=1e-6)


def test_mixture_is_its_sql(spark, small):
    from helpers import rows_of, rows_of_sql

    from corpuslink.llm import queries

    assert rows_of(queries.QUERIES["op7_source_mixing"](spark, small)) == rows_of_sql(queries.ORACLE_SQL["op7_source_mixing"], small)


def test_mixture_beyond_the_named(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    keys = lambda d: {r.doc_id: (r.probability, r.source) for r in d.collect()}
    one = keys(mixing.mixture(docs, sweeps=2))
    monkeypatch.setattr(mixing, "NAMED", 2)
    two = keys(mixing.mixture(docs, sweeps=2))
    assert one.keys() == two.keys() and all(two[k] == (pytest.approx(p), s) for k, (p, s) in one.items())


# -- vectors


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    near = base[rng.integers(0, 30, 150)] + rng.normal(size=(150, 16)) * 0.12
    x = np.r_[base, near, base[:20], base[:10] * 3].astype(np.float32)
    rows = [(i, [float(z) for z in v], 1, "e") for i, v in enumerate(x)]
    odd = [(1000, None, 1, "e"), (1001, [0.0] * 16, 1, "e"), (1002, [float("nan")] * 16, 1, "e"), (1003, [1.0, None] + [0.0] * 14, 1, "e"), (1004, [float("inf")] + [1.0] * 15, 1, "e"), (1005, [1.0], 1, "e")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, e string")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    n = link.sum(1)
    assert sum(got[i].n_links for i in range(len(u))) >= 0.9 * n.sum()
    assert all(got[i].n_links <= n[i] for i in range(len(u)))
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(u)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1006))
    assert got[300].component_id == got[0].component_id
    assert vectors.near_vectors(df.where("false")).count() == 0
    assert vectors.near_vectors(df.where("vec_id = 1000")).count() == 1


def test_recall_on_the_table(spark, small):
    path = small.replace("sf0.001", "sf0.01") + "/embeddings.parquet"
    df = spark.read.parquet(path).union(spark.read.parquet(path).selectExpr("vec_id + 1000", "transform(embedding, (x, i) -> cast(x + 0.03 * sin(i + vec_id) as float))", "label"))
    p = df.toPandas()
    x = np.stack(p.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.9).sum()) - len(x)
    got = sum(r.n_links for r in vectors.near_vectors(df).collect())
    assert want > 100 and 0.9 * want <= got <= want


def test_null_ids_and_recall_one(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    x[40:] = x[:20] + rng.normal(size=(20, 8)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] + [0.0] * 7), (None, x[3].tolist()), (None, None), (0, x[0].tolist()), (77, [1e300] * 8), (78, [1e-300] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df, 0.9, 1.0).collect()
    assert len(got) == len(rows)
    assert sorted((r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None)[1:] != [] and not any(r.kept for r in got if r.vec_id is None)
    all_ = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if v and not (i is None and v[1] == 0)]
    u = np.array([v / np.linalg.norm(v) for _, v in all_])
    n = (u @ u.T >= 0.9).sum(1) - 1
    assert sorted((str(r.vec_id), r.n_links) for r in got) == sorted([(str(i), int(k)) for (i, _), k in zip(all_, n)] + [("None", 0)] * 2)


def test_crowded_groups_are_split(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1, 8)) + rng.normal(size=(120, 8)) * 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist()))
    for m, p in ((10, 20), (8000, 32000)):
        monkeypatch.setattr(vectors, "MEMBERS", m)
        monkeypatch.setattr(vectors, "PROBES", p)
        assert {r.vec_id: r.n_links for r in vectors.near_vectors(df, 0.9, 1.0).collect()} == want


def test_multi_sequence_visits_the_nearest():
    rng = np.random.default_rng(1)
    x, books = rng.normal(size=(20, 8)), (rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    got = vectors.multi_sequence(x, books, 9)
    for v, cells in zip(x, got):
        d = {i * 5 + j: ((v[:4] - a) ** 2).sum() + ((v[4:] - b) ** 2).sum() for i, a in enumerate(books[0]) for j, b in enumerate(books[1])}
        assert cells.tolist() == sorted(d, key=d.get)[:9]


def test_vectors_without_ids_and_of_other_lengths(spark):
    """Rows without an id are compared and counted, also where they only bridge others; each length is a table of its own."""
    turned = [[math.cos(t), math.sin(t), 0.0, 0.0] for t in (0.0, 0.4, 0.8, 1.2)]  # neighbours at cosine 0.921, others below 0.7
    rows = [(7, turned[0]), (None, turned[1]), (3, turned[2]), (None, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.05])]
    rows += [(20, [1.0, 0.0]), (21, [1.0, 0.1]), (22, [1.0, 0.0]), (None, [0.0, 1.0]), (30, [2.0]), (31, [5.0]), (32, [-1.0]), (40, [1.0, 0.0, None]), (41, None)]
    got = sorted((tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    want = [(7, 1, 3, False), (None, 2, 3, False), (3, 1, 3, True), (None, 1, None, False), (None, 1, None, False)]
    want += [(20, 2, 20, True), (21, 2, 20, False), (22, 2, 20, False), (None, 0, None, False), (30, 1, 30, True), (31, 1, 30, False), (32, 0, 32, True), (40, 0, 40, True), (41, 0, 41, True)]
    assert got == sorted(want, key=str)
