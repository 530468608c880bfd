import random

import numpy as np
import pytest

from corpuslink.llm import simhash as S

xxhash = pytest.importorskip("xxhash")


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def by_hand(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    c = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            c[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * c[k] > len(sh))


def components(values, budget):
    v = np.array(values, np.uint64)
    parent = list(range(len(v)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= budget)):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(v))]


def test_trie_finds_each_pair():
    rng = np.random.default_rng(2)
    for budget in (0, 1, 2, 3):
        base = rng.integers(0, 1 << 16, 60)
        near = base[rng.integers(0, 60, 200)] ^ (1 << rng.integers(0, 16, 200)) ^ (1 << rng.integers(0, 16, 200))
        v = np.unique(np.r_[base, near]).astype(np.uint64)
        got = {(min(a, b), max(a, b)): int(f) for i, j, far in S.trie_pairs(v, [(0, len(v), 0, len(v), 0)], 16, budget) for a, b, f in zip(i.tolist(), j.tolist(), far)}
        far = np.bitwise_count(v[:, None] ^ v[None, :])
        assert got == {(i, j): int(far[i, j]) for i in range(len(v)) for j in range(i + 1, len(v)) if far[i, j] <= budget}


def test_trie_pairs_equal_values():
    rng = np.random.default_rng(3)
    two = [[5, 5, 5], [5, 5, 7, 7], rng.integers(0, 8, 40), np.r_[np.full(500, 9), rng.integers(0, 16, 30)]]
    for values, bits in zip(two, (3, 3, 3, 4)):
        v = np.sort(np.array(values, np.uint64))
        for budget in (0, 1, 2):
            got = [(min(a, b), max(a, b), f) for i, j, far in S.trie_pairs(v, [(0, len(v), 0, len(v), 0)], bits, budget) for a, b, f in zip(i.tolist(), j.tolist(), far.tolist())]
            far = np.bitwise_count(v[:, None] ^ v[None, :])
            i, j = np.nonzero(np.triu(far <= budget, 1))
            assert sorted(got) == sorted(zip(i.tolist(), j.tolist(), far[i, j].tolist()))
            some, more = set(), []
            for a, b, f in S.trie_pairs(v, [(0, len(v), 0, len(v), 0)], bits, budget, more):
                some |= set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), f.tolist()))
            left = set(got) - some
            assert some <= set(got) and {k for i, j, _ in left for k in (i, j)} <= set(np.concatenate([*more, np.empty(0, int)]).tolist())
            assert {k for i, j, _ in got for k in (i, j)} == {k for i, j, _ in some for k in (i, j)}
        half = len(v) // 2  # two ranges, as where a crowded trie is split
        got = sorted((a, b) for i, j, _ in S.trie_pairs(v, [(0, half, half, len(v), 1)], bits, 2) for a, b in zip(i.tolist(), j.tolist()))
        assert got == [(a, b) for a in range(half) for b in range(half, len(v)) if int(v[a] ^ v[b]).bit_count() <= 1]


def test_trie_pairs_between_labels():
    rng = np.random.default_rng(4)
    v = np.sort(rng.integers(0, 16, 120).astype(np.uint64))
    labels = rng.integers(0, 3, 120)
    order = np.lexsort((labels, v))
    labels = labels[order]
    got = sorted((min(a, b), max(a, b)) for i, j, _ in S.trie_pairs(v, [(0, 120, 0, 120, 0)], 4, 1, labels=labels) for a, b in zip(i.tolist(), j.tolist()))
    assert got == [(a, b) for a in range(120) for b in range(a + 1, 120) if int(v[a] ^ v[b]).bit_count() <= 1 and labels[a] != labels[b]]


def brute_force(rows, least=0.8):
    """The smallest id of each group that links of at least this similarity form."""
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {b" ".join(w)}
    own = {s: k for k, s in enumerate({s for x in sets.values() for s in x})}
    ids = sorted(sets)
    m = np.zeros((len(ids), len(own)), np.float32)
    for r, i in enumerate(ids):
        m[r, [own[s] for s in sets[i]]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    like = both >= least * (n[:, None] + n[None, :] - both)
    out = np.arange(len(ids))
    while (new := np.where(like, out, len(ids)).min(axis=1)).tolist() != out.tolist():
        out = new
    return {i: ids[c] for i, c in zip(ids, out.tolist())}


def test_near_duplicates_in_a_family(spark):
    """Copies of one text that differ in a few words: most of their table values are equal, and many pairs are too far apart."""
    rng = random.Random(5)
    base = words(rng, 200).split()
    rows = []
    for i in range(300):
        w = base[:]
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(4)}"
        rows.append((i, " ".join(w)))
    want = brute_force(rows)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_components_against_brute_force(spark, messy):
    got = S.simhash_components(messy).collect()
    docs = messy.collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), format(by_hand(r.text), "016x")) for r in docs)
    known = [(r.doc_id, by_hand(r.text)) for r in docs if r.doc_id is not None]
    known.sort()
    want = {known[k][0]: known[c][0] for k, c in enumerate(components([f for _, f in known], 2))}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want


@pytest.mark.parametrize("hot", [8, 10_000])
def test_hot_tries_are_split(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "HOT_LEVELS", 5)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    values = [v & (2**64 - 1) for v in values]
    fps = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)], "id long, fp long")
    edges = [(r.a, r.b) for r in S.hamming_edges(fps, 2).collect()]
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in edges)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(values))] == components(values, 2)


def test_near_duplicates(spark, messy):
    got = {r.doc_id: r.component_id for r in S.near_duplicates(messy).collect()}
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in messy.collect() if r.doc_id is not None}
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({b" ".join(w)} if w else set()) for i, w in docs.items()}
    like = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    want = {}
    for i in sorted(sets):
        want[i] = next((want[j] for j in sorted(want) if like(sets[i], sets[j])), i)
    assert {i: got.get(i, i) for i in sets} == want


def test_empty(no_docs):
    assert S.simhash_components(no_docs).count() == 0
    assert S.near_duplicates(no_docs).count() == 0


def test_bands_keep_the_recall():
    assert S.bands_for(0.8, 0.999) == 7
    rng = np.random.default_rng(6)
    met = apart = kept = 0
    for _ in range(1500):  # sets of similarity 0.8 exactly
        h = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        one, two = h[:162], h[18:]
        met += bool((S.minima(one, 7) == S.minima(two, 7)).any())
        f, g = S.fingerprint(one, 5), S.fingerprint(two, 5)
        far = np.bitwise_count(f ^ g)
        kept += int(np.bitwise_count((f[0] ^ g[0]) >> np.uint64(1))) <= S.most_differing(63, 0.8, 4.5) and int(far[1:].sum()) <= S.most_differing(256, 0.8, 3.7)
        apart += bool((S.minima(one, 7) == S.minima(rng.integers(0, 1 << 63, 162).astype(np.uint64), 7)).any())
    assert met >= 1494 and kept >= 1497 and apart == 0


@pytest.mark.parametrize("hot,family", [(20_000, 32), (30, 4)])
def test_recall_on_the_table(spark, small, monkeypatch, hot, family):
    """All links of brute force at the setting of the pipeline, with crowded tries split and families linked first or not."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "FAMILY", family)
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    want = brute_force([(r.doc_id, r.text or "") for r in docs.collect()])
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}
    together = [i for i in want if want[i] != i]
    assert sum(got.get(i, i) == want[i] for i in together) >= 0.99 * len(together) > 50
    assert all(want[i] != i for i, c in got.items() if c != i)


def test_repeated_ids_are_one_document(spark):
    rng = random.Random(8)
    a, b = words(rng, 60), words(rng, 60)
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (3, b + " end"), (None, a), (4, None), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()} == {2: 2, 3: 2, 4: 4, 5: 4}


@pytest.mark.parametrize("cell", [4 << 20, 20_000])
def test_template_of_texts_that_are_not_alike(spark, monkeypatch, cell):
    """All pairs are candidates and fail, but for texts that were taken from another one; small cells find the same."""
    monkeypatch.setattr(S, "CELL_BYTES", cell)
    rng = random.Random(12)
    base = words(rng, 200).split()
    rows = []
    for i in range(200):
        w = base[:]
        for k in range(5):  # five words of its own, a shingle apart: 25 of 196 shingles
            w[20 + 30 * k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
        if i % 20 == 0:
            w[190] = f"end{i}"
            rows.append((1000 + i, " ".join(w)))
    want = brute_force(rows)
    assert sum(want[i] != i for i in want) == 10
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_bound_on_common_shingles(spark):
    """Two sets of ten with the same fingerprint are a pair as long as both can share 16/9 of their mean at 0.8."""
    for core, n in ((10, 1), (9, 1), (8, 0)):
        rows = [(1, 5, k, 0, 0, 0, 0, 10, core if k else 10, k) for k in (0, 1)]
        tries = spark.createDataFrame(rows, "trie long, value long, id long, s0 long, s1 long, s2 long, s3 long, n long, core long, label long")
        assert [(r.a, r.b) for r in S.trie_join(tries, 63, 22, (100, 0.8), None).collect()] == [(0, 1)] * n


def test_maps_never_drop_a_pair_that_is_alike():
    """The bound is at least what two sets share: on few and on many more elements than bits, and on equal and empty sets."""
    rng = np.random.default_rng(5)
    sets = [np.empty(0, np.uint64)]
    for n in (1, 30, 150, 1000, 5000, 40_000):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        sets += [np.unique(np.r_[base[rng.random(n) < keep], rng.integers(0, 1 << 63, int(n * own), np.uint64)]) for keep in (1, 0.9, 0.6) for own in (0, 0.1, 0.5)]
    maps = np.frombuffer(b"".join(map(S.shingle_map, sets)), np.uint64).reshape(len(sets), -1)
    sizes = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets))
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    bound = S.most_shared(maps, sizes, i, j)
    assert (bound >= shared).all()
    small = np.maximum(sizes[i], sizes[j]) < 250
    assert (bound - shared)[small].max() <= 12


def test_family_with_losses_of_their_own(spark):
    """Texts that each lack other passages of one text: nearly all pairs lie a little below the similarity."""
    rng = random.Random(17)
    base = words(rng, 150).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 150):
        text = base[:]
        for at in sorted(rng.sample(range(150), 4), reverse=True):
            text[at] = rng.choice("abcd")
        rows.append((k, " ".join(text)))
    want = brute_force(rows)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got.get(k, k) for k in want} == want
