"""Operator 11: spelling variants of frequent words, by k-d trees over letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Least letters and occurrences of a word, and how often a form occurs at least for each occurrence of its variant.
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: One in so many (document, word) pairs loses a letter.
TYPO = 199
#: Distinct words that a task gathers before it hands their counts on.
ROOM = 300_000
#: Bytes of the words that a cell of the shared trees holds, and of the words that ask it, in one task; what is more goes to tasks of its own.
CELL, ASKED = 1 << 20, 4 << 20
#: Words (about so many) from which the shared trees are laid out, and cells that they have at most: the driver holds no more, and only the sizes of tasks depend on it.
SAMPLE, CELLS = 1 << 15, 1 << 12
#: Lengths from which on all lengths share one tree.
LONG = 64
#: Words in a leaf of a task's own tree, and numbers that one step of it compares.
LEAF, STEP = 32, 1 << 24
#: Dimensions of a letter count: a to z, then the letters from U+00C0 on. Words have one byte a letter in Latin-1.
LETTERS = 26 + 64
_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[97:123] = np.arange(26)
_DIMENSION[192:256] = 26 + np.arange(64)
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def letters_of(words: list[str]) -> np.ndarray:
    """One row of letters for each of some words of equal length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """How often each row has each letter."""
    flat = np.arange(len(letters))[:, None] * LETTERS + _DIMENSION[letters]
    out = np.bincount(flat.ravel(), minlength=len(letters) * LETTERS).reshape(-1, LETTERS)
    return out.astype(np.int8 if letters.shape[1] < 128 else np.int64)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """word and n of every word of at least so many letters and occurrences; a task counts what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(_RUN.findall((raw.as_py() or b"").lower()))  # bytes lower A to Z only
                start = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for word, times in found.items():
                    if len(word) < least_letters:
                        continue
                    if start is not None and (h := zlib.crc32(word, start)) % typo == 0:
                        plain = word.decode("utf-8")
                        k = h % len(plain)
                        word = (plain[:k] + plain[k + 1 :]).encode("utf-8")
                    if len(word) - word.count(b"\xc3") >= least_letters:
                        seen[word] += times
                if len(seen) > ROOM:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Tree:
    """The shared tree of the words of one class of lengths: splits of letter counts, down to cells.

    The splits are medians of a sample, so that cells are of like size; every word lies in exactly one cell, sampled or not.
    """

    def __init__(self, counts: np.ndarray, cells: int, first: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # dimension, least count on the right, left child, right child; cells have dimension -1
        self.first, self.cells = first, 0
        self.root = self._grow(counts.astype(np.int64), cells)

    def _grow(self, counts: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, self.first + self.cells, 0, 0))
        if cells > 1 and len(counts) > 1:
            d = int(counts.var(axis=0).argmax())
            values = counts[:, d]
            cut = max(int(np.median(values)), int(values.min()) + 1)
            right = values >= cut
            if right.any() and not right.all():
                share = min(max(round(cells * right.mean()), 1), cells - 1)
                a = self._grow(counts[~right], cells - share)
                b = self._grow(counts[right], share)
                self.nodes[at] = (d, cut, a, b)
                return at
        self.cells += 1
        return at

    def own(self, counts: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(counts), np.int64)
        stack = [(self.root, np.arange(len(counts)))]
        while stack:
            node, rows = stack.pop()
            d, cut, a, b = self.nodes[node]
            if d < 0:
                out[rows] = cut
            elif len(rows):
                right = counts[rows, d] >= cut
                stack += [(a, rows[~right]), (b, rows[right])]
        return out

    def near(self, counts: np.ndarray, more: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) of all cells that may hold a word that is one edit from a row: boxes are pruned by what leads out of them.

        Such a word has at most one letter less of some kind, and at most `more` letters more of another.
        """
        stack = [(self.root, np.arange(len(counts)), {})]
        while stack:
            node, rows, box = stack.pop()
            if not len(rows):
                continue
            d, cut, a, b = self.nodes[node]
            if d < 0:
                yield cut, rows
                continue
            low, high = box.get(d, (0, None))
            for child, bounds in ((a, (low, cut - 1)), (b, (cut, high))):
                inside = {**box, d: bounds}
                over, under = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for k, (lo, hi) in inside.items():
                    value = counts[rows, k].astype(np.int64)
                    under += np.maximum(lo - value, 0)
                    if hi is not None:
                        over += np.maximum(value - hi, 0)
                stack.append((child, rows[(over <= 1) & (under <= more)], inside))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of letters a is exactly one edit from that of b, which is as long or one shorter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = b.shape[1]
    front, back = a[:, :n] != b, (a[:, 1:] != b)[:, ::-1]
    alike = lambda differs: np.where(differs.any(axis=1), differs.argmax(axis=1), n)
    return alike(front) + alike(back) >= n


def range_pairs(asking: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of letters that are one edit apart; held words are as long as the asking ones or one shorter.

    A k-d tree over the letter counts of the held words is built and searched at once: at each node the bounding box of
    its words prunes the words that ask, at a leaf counts are compared, and then the order of the letters.
    """
    a, h = counts_of(asking), counts_of(held)
    used = np.flatnonzero(h.any(axis=0) | a.any(axis=0))
    a, h = a[:, used], h[:, used]
    extra = asking.shape[1] - held.shape[1]  # letters that an asking word has more of
    stack = [(np.arange(len(asking)), np.arange(len(held)))]
    while stack:
        rows, words = stack.pop()
        low, high = h[words].min(axis=0), h[words].max(axis=0)
        kept = []
        for part in np.array_split(rows, max(1, len(rows) * len(used) // STEP)):
            over, under = np.maximum(a[part] - high, 0).sum(axis=1), np.maximum(low - a[part], 0).sum(axis=1)
            kept.append(part[(over <= 1) & (under <= 1 - extra)])
        rows = np.concatenate(kept)
        if not len(rows):
            continue
        spread = high - low
        if len(words) > LEAF and spread.any():
            d = int(h[words].var(axis=0).argmax())
            values = h[words, d]
            right = values >= max(int(np.median(values)), int(values.min()) + 1)
            if right.any() and not right.all():
                stack += [(rows, words[~right]), (rows, words[right])]
                continue
        for part in np.array_split(rows, max(1, len(rows) * len(words) * len(used) // STEP)):
            # One letter more and `extra` less one the other way: the sums of both differ by `extra`.
            i, j = np.nonzero(np.maximum(a[part][:, None, :] - h[words][None, :, :], 0).sum(axis=2) == 1)
            step = max(1, STEP // asking.shape[1])
            for k in range(0, len(i), step):
                p, w = part[i[k : k + step]], words[j[k : k + step]]
                ok = one_edit(asking[p], held[w])
                yield p[ok], w[ok]


def _by_length(words: np.ndarray) -> dict[int, np.ndarray]:
    out = defaultdict(list)
    for k, w in enumerate(words):
        out[len(w)].append(k)
    return {n: np.array(k) for n, k in out.items()}


def _search(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, form_n and form of what the asking words find among the held ones of their task, for both sides.

    Words of one length could find each other twice: what counts is the pair found from the earlier cell, and in one cell
    that of the greater word.
    """
    near: list[tuple[np.ndarray, np.ndarray]] = []
    by_length = _by_length(held["word"].to_numpy())
    at = {n: letters_of(held["word"].to_numpy()[k].tolist()) for n, k in by_length.items()}
    for n, k in _by_length(asking["word"].to_numpy()).items():
        letters = letters_of(asking["word"].to_numpy()[k].tolist())
        for m in (n, n - 1):
            if m not in by_length:
                continue
            for i, j in range_pairs(letters, at[m]):
                i, j = k[i], by_length[m][j]
                if n == m:
                    x, y = asking["cell"].to_numpy()[i], held["cell"].to_numpy()[j]
                    ok = (x < y) | ((x == y) & (asking["word"].to_numpy()[i] > held["word"].to_numpy()[j]))
                    i, j = i[ok], j[ok]
                near.append((i, j))
    if not near:
        return pd.DataFrame({"word": [], "n_near": [], "form_n": [], "form": []}).astype({"word": object, "n_near": int, "form_n": int, "form": object})
    i, j = (np.concatenate(x) for x in zip(*near))
    sides = []
    for one, k, other, m in ((asking, i, held, j), (held, j, asking, i)):
        both = pd.DataFrame({"word": one["word"].to_numpy()[k], "form_n": other["n"].to_numpy()[m], "form": other["word"].to_numpy()[m]})
        sides.append(both)
    both = pd.concat(sides).sort_values(["word", "form_n", "form"], ascending=[True, False, True], kind="stable")
    best = both.drop_duplicates("word")
    return best.assign(n_near=both.groupby("word").size().reindex(best["word"]).to_numpy())[["word", "n_near", "form_n", "form"]]


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n and form of each word (word, n; distinct, of letters only) that has others exactly one edit away.

    One edit changes the letter counts by at most one letter more and one less. The words of each length have a shared
    k-d tree over their letter counts; a word lies in one of its cells and asks all cells of its own length and of the next
    shorter one that it may reach by one edit. Cells of one length are asked by words of cells before them only, and in a
    cell the greater word asks, so that each pair is looked at once and told to both. What is a task are the words of a
    cell and those that ask it; where either are more than CELL or ASKED bytes, they are dealt to several tasks by hash.
    Only sums and the best form of each word leave a task. Two words are compared in the order of their letters before
    they count. No candidate is dropped.
    """
    size = F.least(F.length("word"), F.lit(LONG)).alias("size")
    sizes = words.groupBy(size).agg(F.sum(F.octet_length("word") + 16).alias("bytes"), F.count("*").alias("k")).collect()
    per_size = {r["size"]: r["bytes"] for r in sizes}
    # About SAMPLE words, by their hash; long ones only shape trees and are left out.
    share = min(1.0, SAMPLE / max(1, sum(r["k"] for r in sizes)))
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = [r[0] for r in words.where(chosen & (F.octet_length("word") <= 4 * LONG)).select("word").collect()]
    by_size = defaultdict(list)
    for w in sample:
        by_size[min(len(w), LONG)].append(w)
    trees, first, share = {}, 0, max(1.0, sum(per_size.values()) / CELL / (CELLS // 2))
    for n in sorted(per_size):
        known = by_size[n]
        counts = np.concatenate([counts_of(letters_of(known_of)).astype(np.int64) for known_of in _equal_lengths(known)]) if known else np.zeros((0, LETTERS), np.int64)
        trees[n] = Tree(counts, max(1, round(per_size[n] / CELL / share)), first)
        first += trees[n].cells

    def routes(word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(cell, rows, own cells of the rows) for each cell that rows ask, and (cell, rows, None) for those that they lie in."""
        for n, k in _by_length(word).items():
            counts = counts_of(letters_of(word[k].tolist()))
            own = trees[min(n, LONG)].own(counts)
            for cell in np.unique(own):
                yield int(cell), k[own == cell], None
            for m in {min(n, LONG), min(n - 1, LONG)} & trees.keys():
                for cell, rows in trees[m].near(counts, int(m == min(n, LONG))):
                    if m == min(n, LONG) and n < LONG:
                        rows = rows[own[rows] <= cell]  # pairs of one length are asked for from the cells before
                    if len(rows):
                        yield cell, k[rows], own[rows]

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            word, weight = f["word"].to_numpy(), f["weight"].to_numpy()
            rows = [(cell, own is None, int(weight[k].sum())) for cell, k, own in routes(word)]
            yield pd.DataFrame(rows, columns=["cell", "held", "bytes"])

    weighed = words.select("word", (F.octet_length("word") + 16).cast("long").alias("weight")).mapInPandas(weigh, "cell long, held boolean, bytes long")
    blocks = {}
    for r in weighed.groupBy("cell", "held").agg(F.sum("bytes").alias("bytes")).collect():  # at most two rows for each of CELLS
        blocks[r["cell"], r["held"]] = -(-r["bytes"] // (CELL if r["held"] else ASKED))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            word, n, salt, out = f["word"].to_numpy(), f["n"].to_numpy(), f["salt"].to_numpy(), []
            for cell, k, own in routes(word):
                h, a = blocks.get((cell, True), 1), blocks.get((cell, False), 1)
                for other in range(a if own is None else h):
                    mine = salt[k] % (h if own is None else a)
                    task = (cell << 40) + ((mine << 20) + other if own is None else (other << 20) + mine)
                    out.append(pd.DataFrame({"task": task, "held": own is None, "cell": cell if own is None else own, "word": word[k], "n": n[k]}))
            if out:
                yield pd.concat(out)

    dealt = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 20)).alias("salt")).mapInPandas(deal, "task long, held boolean, cell long, word string, n long")

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        return _search(f[f["held"]], f[~f["held"]])

    found = dealt.groupBy("task").applyInPandas(meet, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("form_n"), "b.form")


def _equal_lengths(words: list[str]) -> list[list[str]]:
    out = defaultdict(list)
    for w in words:
        out[len(w)].append(w)
    return list(out.values())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of the way from form to form.

    Each round doubles the steps that a row has gone, so that a chain of n words takes log n rounds; a chain has few, as each
    form occurs at least FORM_RATIO times as often as the word before.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        gone = materialize(state.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        state = gone.select("word", "root")
        if not gone.where("moved").limit(1).count():
            return state


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word of all texts.

    Words are runs of Latin letters (a to z after lowering A to Z, and U+00C0 to U+00FF as they are) of every whole text; one
    (document, word) pair in TYPO loses a letter by a checksum, so that variants are there to be found. A word's form is
    the near word (one letter inserted, deleted or replaced) that occurs most often, ties to the smaller in code-point order,
    if it occurs at least `ratio` times as often as the word. Its root is where the way from form to form ends, itself
    without a form.

    Null texts have no words; in rows with a null key no word loses a letter. Repeated rows count each. A word is as long
    as its run. An empty table gives no rows. Only key and text are read, so other columns can't clash; a key that is no number
    counts as null.
    """
    words = materialize(vocabulary(docs, key, text))
    near = near_words(words)
    is_form = F.col("form_n") >= ratio * F.col("n")
    found = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
        )
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
