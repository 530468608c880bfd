import hashlib
import random
from collections import Counter

import pytest

from corpuslink.llm import substrings as S


def by_hand(rows, w):
    n = Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, x in split:
        n.update(tuple(x[k : k + w]) for k in range(len(x) - w + 1))
    out = Counter()
    for i, x in split:
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if n[tuple(x[k : k + w])] > 1:
                gone[k : k + w] = [True] * w
        kept = b" ".join(a for a, g in zip(x, gone) if not g)
        out[(i, len(x), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_against_brute_force(spark, messy):
    got = Counter(map(tuple, S.remove_repeats(messy).collect()))
    assert got == by_hand([(r.doc_id, r.text) for r in messy.collect()], 35)


@pytest.mark.parametrize("window,seed", [(1, 1), (2, 2), (5, 3), (6, 4)])
def test_small_windows(spark, monkeypatch, window, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc" if i % 2 else "defgh") for _ in range(rng.randint(0, 40)))) for i in range(30)]
    got = Counter(map(tuple, S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()))
    assert got == by_hand(rows, window)


def test_slices_and_chunks_overlap():
    rolling, hashes = S.Rolling(4), S.WordHashes()
    words = [str(i % 7).encode() for i in range(50)]
    h = rolling.of(hashes.of(words), 0)
    assert len(h) == 47 and len(set(h.tolist())) == 7
    assert (rolling.of(hashes.of(words[10:30]), 0) == h[10:27]).all()


def test_texts_are_kept_as_they_are(spark):
    rng = random.Random(5)
    passage = " ".join(str(rng.random()) for _ in range(60))
    docs = spark.createDataFrame([(1, "own text\nline two", "en"), (2, "a " + passage + " b", "de"), (3, passage, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept_text, r.lang, r.n_removed) for r in S.remove_repeats(docs, keep=("lang",), texts=True).collect()}
    assert got == {1: ("own text\nline two", "en", 0), 2: ("a b", "de", 60), 3: ("", None, 60)}


def test_empty(no_docs):
    assert S.remove_repeats(no_docs).count() == 0


def test_hits_of_a_bucket_are_one_row_for_each_part(spark):
    """A row for each of four ranges of the hash made four times as many."""
    import numpy as np

    from corpuslink.llm import substrings as S

    h = np.random.default_rng(2).integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    rows = []
    for key in (1, 2):
        batch = S._send((h,), np.ones(400, bool), np.full(400, key, np.int64), np.arange(400), (5,), 2)
        rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
    out = S._meet(spark.createDataFrame([(int(p), bytes(b)) for p, b in rows], "part int, blob binary"), (5,), 2).collect()
    assert len(out) == 4
    assert sum(int(np.frombuffer(r.blob[:8], np.int64)[0]) for r in out) == 800
