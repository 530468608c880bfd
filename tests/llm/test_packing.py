import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuslink.llm.packing import Encoder, best_two_fit, cut, pack

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LOADED = None


def whole(encoder, text):
    """By a tokenizer as it is loaded."""
    from tokenizers import Tokenizer

    global LOADED
    LOADED = LOADED or Tokenizer.from_file(PATH)
    return np.array(LOADED.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_the_tokenizers():
    e, rng = Encoder(PATH), random.Random(3)
    pool = ["word", " ", "  ", "\n", "\t", "é", "Ü", "ß", "²", "½", "ª", "\x1c", "\x1f", "\x85", "\xa0", "œ", "漢", "🙂", "́", "'ll", "'", "12", "_", "<|endoftext|>", "...", "Ⅷ"]
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert e.encode(text) == whole(e, text), text


def test_long_texts_are_cut_where_strings_part():
    from corpuslink.llm import packing

    e = Encoder(PATH)
    text = " ".join(f"word{i}  x\n y" for i in range(400))
    before, packing.SLICE = packing.SLICE, 97
    try:
        assert e.encode(text) == whole(e, text)
    finally:
        packing.SLICE = before


def test_cut():
    assert cut(1024, 1024) == [(0, 1024)]
    assert cut(1025, 1024) == [(0, 1), (1, 1024)]
    assert cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_plan_packs_all_and_nearly_fills():
    rng = random.Random(5)
    for capacity in (1, 7, 100, 1024):
        counts = Counter(rng.randint(1, capacity) for _ in range(3000))
        plan = best_two_fit(dict(counts), capacity)
        packed = Counter()
        for lengths, times in plan:
            assert sum(lengths) <= capacity and times > 0
            packed.update({k: n * times for k, n in Counter(lengths).items()})
        assert packed == counts
        assert sum(t for _, t in plan) <= 1.02 * sum(k * n for k, n in counts.items()) / capacity + 2


def test_smallest_gives_way_to_two():
    plan = best_two_fit({60: 1, 30: 1, 22: 1, 17: 1}, 100)
    assert plan[0] == ([60, 22, 17], 1)


def by_hand(lengths, capacity):
    """Best-two-fit on a list of pieces, one bin at a time."""
    left, bins = sorted(lengths), []
    while left:
        bin_, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            left.remove(max(fits))
            bin_.append(max(fits))
            gap -= max(fits)
        if gap and len(bin_) > 1:
            room = gap + bin_[-1]
            pairs = [(a + b, a, b) for k, a in enumerate(left) for b in left[k + 1 :] if a + b <= room]
            best = max((t for t, _, _ in pairs), default=0)
            if best > bin_[-1]:
                left.append(bin_.pop())
                _, a, b = next(p for p in pairs if p[0] == best)
                bin_ += [a, b]
                left.remove(a)
                left.remove(b)
                left.sort()
        bins.append(sum(bin_))
    return sorted(bins)


def test_plan_against_single_bins():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        plan = best_two_fit(dict(Counter(lengths)), 40)
        bins, want = sorted(sum(x) for x, n in plan for _ in range(n)), by_hand(lengths, 40)
        assert len(bins) == len(want) and sum(bins) == sum(want)


def test_workers_without_the_package_on_their_path(tmp_path):
    """The functions then travel with their code."""
    import os
    import subprocess
    import sys

    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from corpuslink.llm import packing, simhash
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
docs = spark.createDataFrame([(k, "some words of text " * k) for k in range(9)], "doc_id long, text string")
print("ROWS", packing.pack(docs).count(), simhash.simhash_components(docs).count())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    there = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != root)
    said = subprocess.run([sys.executable, "-c", code, root, str(tmp_path)], env=os.environ | {"PYTHONPATH": there}, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "ROWS 9 9" in said.stdout, said.stderr[-2000:]


def test_pieces(spark, messy):
    e = Encoder(PATH)
    rows = pack(messy, 64, path=PATH).collect()
    want = Counter()
    for r in messy.collect():
        ids = whole(e, r.text or "") + b"\x02\0\0\0"
        for k, (start, n) in enumerate(cut(len(ids) // 4, 64)):
            want[(r.doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= sum(r.length for r in rows) / 64 * 1.02 + 2


def test_empty(no_docs):
    assert pack(no_docs, path=PATH).count() == 0
