"""Operators 11, 12 and 13."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpuslink.llm import spelling, tokens
from corpuslink.llm.periodic import _may_repeat, _shortest_match, digest, periodic_runs, planted, runs_of
from corpuslink.llm.spelling import near_words, one_edit, spelling_variants, vocabulary
from corpuslink.llm.tokens import Splitter, token_counts


# Spelling variants.


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def variants_by_hand(rows):
    n = counted(rows)
    near = {w: [x for x in n if distance_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    long = "x" * 70 + "y" * 8
    words = ["signal", "signals", "signale", "segnal", "Größe", "größer", "Ähnlich", "ähnlich", "listen", "silent", "enlist", "tinsel", "aaaaaa", "aaaaab", "aaaaabb", long, long + "z", long[1:] + "w", "œuvres", "dot1dot", "÷×÷×÷×"]
    weights = [100, 40, 8, 7, 5, 30, 20, 90, 9, 9, 9, 9, 300, 40, 6, 60, 8, 9, 5, 5, 9]
    rows = [(k, " ".join(rng.choices(words, weights, k=60))) for k in range(40)]
    return rows + [(None, "signal listen " * 5), (None, None), (7, ""), (40, "signal-signals_signalé"), rows[0]]


@pytest.mark.parametrize("cell", [1 << 20, 200])
def test_variants_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "ASKED", cell)
    rows = made_texts(3)
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, n long, word string").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(docs).collect()}
    want = variants_by_hand(rows)
    assert got == want
    assert any(v[0] is not None and v[1] != v[0] for v in want.values())  # a chain of forms


def test_variants_on_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(docs).collect()}
    assert got == variants_by_hand(rows)


@pytest.mark.parametrize("cell", [1 << 20, 120])
def test_near_words_loses_none(spark, monkeypatch, cell):
    """Few letters, so that many words share a point, lie on both sides of each split, and crowd a cell that can't be split."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "ASKED", 2 * cell)
    monkeypatch.setattr(spelling, "LEAF", 2)
    monkeypatch.setattr(spelling, "STEP", 64)
    monkeypatch.setattr(spelling, "LONG", 9)
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcéÿ", [5, 3, 1, 1, 1], k=rng.randint(6, 11))) for _ in range(250)})
    n = {w: rng.randint(1, 9) for w in words}
    got = {r["word"]: (r["n_near"], r["form_n"], r["form"]) for r in near_words(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)).collect()}
    want = {}
    for w in words:
        near = [x for x in words if distance_one(w, x)]
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            want[w] = (len(near), n[best], best)
    assert got == want


def test_one_edit():
    rows = lambda *w: spelling.letters_of(list(w))
    assert one_edit(rows("abc", "abc", "abc"), rows("abd", "abc", "acb")).tolist() == [True, False, False]
    assert one_edit(rows("abcd", "abcd", "abcd", "aabb"), rows("abc", "bcd", "acb", "abb")).tolist() == [True, True, False, True]


def test_no_variants(no_docs):
    out = spelling_variants(no_docs)
    assert set(out.columns) == {"word", "form", "root", "n", "n_near", "form_n"} and out.count() == 0


def test_vocabulary_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ROOM", 2)
    rows = made_texts(4)
    got = {r["word"]: r["n"] for r in vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == counted(rows)


# Token counts.

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = ["word", "Straße", "ÜBER", "İx", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "²", "½", "12", "'s", "'LL", "'", "’s", "漢字", "é", "ﬁ", "🙂", "Ⅷ", "ǅ", "_", "...", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "​", "ſ", "Σς"]


def whole(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_pre_tokens_are_the_tokenizers(tokenizer):
    s, rng = Splitter(PATH), random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 20)))
        pieces, special = s.split(text)
        assert special + sum(map(s.pieces, pieces)) == whole(tokenizer, text), text


def test_all_plain_characters_part_alike(tokenizer):
    s = Splitter(PATH)
    for c in map(chr, range(ord(tokens.PLAIN))):
        for text in (f"a{c}b", f"1{c}1", f"!{c}!", f"'{c}x", f"{c}{c}"):
            pieces = s.split(text)[0]
            own = [bytes(s.byte[x] for x in p).decode() for p, _ in s.parts.pre_tokenize_str(s.normalizer.normalize_str(text))]
            assert pieces == own, text


@pytest.mark.parametrize("head", [0, 3, 1 << 16])
def test_counts_of_texts(spark, tokenizer, monkeypatch, head):
    monkeypatch.setattr(tokens, "HEAD", head)
    monkeypatch.setattr(tokens, "ROOM", 5)
    rng = random.Random(head)
    rows = [(k, "".join(rng.choice(POOL) for _ in range(rng.randint(0, 30)))) for k in range(40)]
    rows += [(3, rows[3][1]), (3, "other"), (None, "ein Wort"), (50, None), (51, ""), (52, "ab" * 20_000), (53, "wort " * 2049), (54, "wort " * 2048)]
    docs = spark.createDataFrame([(d, t, 0, "p", 1) for d, t in rows], "doc_id long, text string, row long, piece string, n_tokens long").repartition(3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(map(tuple, token_counts(docs, 2048).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=key)
    want = [(d, len((t or "").encode()), whole(tokenizer, t or "")) for d, t in rows]
    assert got == sorted(((*w, w[2] > 2048) for w in want), key=key)
    assert (53, 10245, 2049, True) in got and (54, 10240, 2048, False) in got


def test_no_counts(no_docs):
    assert token_counts(no_docs).count() == 0


def test_counts_on_the_table(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()}
    assert got == {r["doc_id"]: whole(tokenizer, r["text"] or "") for r in docs.collect()}


# Periodic runs.


def runs_by_hand(w, least_words=24, least_periods=3):
    n, out = len(w), set()
    for q in range(1, n // least_periods + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least_words, least_periods * q):
                part = w[start : start + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.add((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    few, out = rng.choice([1, 2, 2, 3, 5, 30]), []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.5:
            out += [rng.randrange(few) for _ in range(rng.randint(0, 40))]
        else:
            p = [rng.randrange(few) for _ in range(rng.randint(1, 40))]
            out += [p[i % len(p)] for i in range(rng.randint(1, 160))]
    return out


def test_runs_against_brute_force():
    rng, seen = random.Random(5), 0
    for _ in range(800):
        w = periodic_words(rng)
        want = runs_by_hand(w)
        ids = np.array(w, np.int64)
        assert runs_of(ids) == want, w
        assert not want or _may_repeat(ids, _shortest_match(24, 3))
        assert runs_of(ids, 12, 4) == runs_by_hand(w, 12, 4), w
        seen += len(want)
    assert seen > 300


def test_shortest_match():
    assert _shortest_match(24, 3) == 16
    assert not _may_repeat(np.arange(100), 16) and _may_repeat(np.arange(100) % 50, 16) and not _may_repeat(np.zeros(3, np.int64), 16)


def digest_by_hand(words):
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(runs), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2], sha(lines.encode()), sha(kept)


def test_documents(spark, messy):
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in messy.collect() if len(r["text"] or "") < 20_000]
    rows += [(k, "  ".join(f"w{x}" for x in periodic_words(rng))) for k in range(100, 180)]
    rows += [(5, "a\xa0b\x85 " * 30), (5, "a b " * 40 + "c d e " * 40 + "x")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start long, period long").repartition(3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for plant in (False, True):
        got = sorted(map(tuple, periodic_runs(docs, plant=plant).collect()), key=key)
        words = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
        want = []
        for d, w in words:
            h = zlib.crc32(str(d).encode())
            if plant and d is not None and h % 10 == 0 and w:
                a = h // 10 % len(w)
                p = 1 + (len(w) - a) // (3 + h // 10 % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            want.append((d, *digest_by_hand(w)))
        assert got == sorted(want, key=key)
    assert sum(r[1] > 0 for r in got) > 20


def test_one_word_for_ever_is_quick():
    n = 200_000
    assert runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert digest([b"x"] * n)[:5] == (1, 0, n, 1, 1000 * n)
    assert planted([], 20) == [] and planted([b"x"], None) == [b"x"]


def test_no_runs(no_docs):
    assert periodic_runs(no_docs).count() == 0
