"""Operator 13: periodic runs of words, by sparse diagonals that are followed online."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def _shortest_match(least_words: int, least_periods: int) -> int:
    """The fewest words in a row that agree with those a period before them, over all runs that are long enough."""
    return min(max(least_words - q, (least_periods - 1) * q) for q in range(1, least_words + 1))


def _paired(names: np.ndarray, gap: int) -> np.ndarray:
    """Names of twice the blocks: two places have one name exactly if both their halves do."""
    pair = names[:-gap] * (int(names.max(initial=0)) + 1) + names[gap:]
    return np.unique(pair, return_inverse=True)[1].reshape(-1)


def _may_repeat(ids: np.ndarray, width: int) -> bool:
    """False only if no block of `width` words stands twice: equal blocks have equal sums, whatever the weights."""
    n = len(ids)
    if n <= width:
        return False
    weights = np.random.default_rng(7).integers(1, 1 << 62, int(ids.max()) + 1, dtype=np.uint64)
    # Powers of an odd number say where in the text a word stands; the block's own start is then taken out again.
    powers = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(weights[ids] * powers, out=sums[1:])
    blocks = (sums[width:] - sums[:-width]) * powers[::-1][: n - width + 1]
    return len(np.unique(blocks)) < len(blocks)


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; least_periods is 3 or more.

    The words are read in order. The earlier occurrence of what begins at a word adds one to the match length of its lag's
    diagonal, and a diagonal that isn't met again ends: it is a run if it was long enough. Most earlier occurrences of a
    frequent word can't belong to a run, and these are never looked at: on a run's diagonal whole blocks of words agree, of
    any width up to the match length. Each scale takes the lags above half its width up to its width, and at each word
    the latest earlier occurrence of the block that begins there, so that one diagonal a scale is active. This loses none:
    inside a run of smallest period q a block of q words or more has its latest occurrence q before (one in between would,
    by the theorem of Fine and Wilf, give the run a smaller period), so that all of the run lies on one diagonal up to both
    its ends, and a diagonal so followed has its lag as smallest period. Blocks are named exactly, by pairs of names of half the width.
    """
    found: list[tuple[int, int, int]] = []
    names, width, low, n = ids.astype(np.int64), 1, 0, len(ids)
    first = 1 << (_shortest_match(least_words, least_periods).bit_length() - 1)
    while low * least_periods < n:
        if width >= first:
            last: dict[int, int] = {}
            active = matched = 0
            for i, name in enumerate([*names.tolist(), -1]):  # the last one ends what is still active
                lag = i - last.get(name, i)
                last[name] = i
                if lag == active:
                    matched += 1
                    continue
                if low < active <= width and matched + width - 1 + active >= max(least_words, least_periods * active):
                    found.append((i - matched - active, matched + width - 1 + active, active))
                active, matched = lag, 1
            if len(last) > len(names):  # no block stands twice, and no wider one can
                break
            low = width
        if len(names) <= width:
            break
        names, width = _paired(names, width), 2 * width
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail in one of ten documents, chosen by a checksum of the id; a null id changes nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(words: list[bytes]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of one text's words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    runs = runs_of(ids) if _may_repeat(ids, _shortest_match(LEAST_WORDS, LEAST_PERIODS)) else []
    kept = words
    best: tuple = (None,) * 4
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            drop[start + q] += 1
            drop[start + length] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
        top = runs[0]
        for r in runs[1:]:  # by start and period already, so only a greater ratio takes over; compared without division
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = (*top, 1000 * top[1] // top[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """One row per document: its periodic runs, the one of greatest length over period, and digests of runs and of the kept words.

    A run is a stretch of consecutive words with smallest period q, at least LEAST_WORDS words and LEAST_PERIODS periods
    long, that no neighbouring word extends. Words that a run covers after its first q are dropped. Every whole text is
    read, in the task that reads its row: no shuffle. The work is a sort of the words for each doubling of the period up
    to a third of the text, and for most texts one look for a repeated block of words.

    Words part at the six ASCII white spaces. With `plant`, one text of ten gets a periodic tail first (`planted`). A null
    or blank text has no words and no runs: four nulls, and the digests of empty strings. Repeated rows are judged each,
    null keys stay, an empty table gives no rows; only key and text are read, so other columns can't clash; a key that is
    no number becomes null. Of equal ratios the smallest start, then the smallest period wins.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (raw.as_py() or b"").split()  # bytes part at the six ASCII white spaces
                rows.append(digest(planted(words, doc) if plant else words))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)
