"""Operator 2: SimHash fingerprints and their binary-trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

SEED = 42
#: Byte b -> eight byte lanes with its bits, the highest first: 255 bytes can be summed before a lane runs over.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
#: Shingles that are hashed at once.
SLICE = 1 << 16
#: Rows of a trie beyond which its node pairs some levels down become tries of their own.
HOT = 20_000
HOT_LEVELS = 10
#: Rows of tries that one group of tasks joins.
GROUP = 50_000
#: Node pairs that are held at once.
FRONT = 50_000
#: Minima that name a band, and classes of a trie beyond which each is first compared with the first of them.
MINIMA = 2
FAMILY = 32
#: Words of further SimHash bits that a class carries, and shingles from which on these are telling enough to drop a pair.
SKETCH = ("s0", "s1", "s2", "s3")
TELLING = 32
#: Bits of the map of a class's shingles, and pairs whose maps are compared at once.
MAP_BITS = 4096
MAP_PAIRS = 20_000
#: Bytes of shingle hashes and pairs of a cell in which pairs are verified.
CELL_BYTES = 4 << 20
CELL_PAIRS = 100_000
#: Spanning forests that are handed on in each round where pairs are verified later; None hands on all pairs that are left.
ROUNDS = (3, None)


# -- fingerprints ------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of the space-joined shingles of lower-cased words, repeats included; the whole sequence if it is shorter."""
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    out = np.empty(len(words) - size + 1, np.uint64)
    for k in range(0, len(out), SLICE):  # the digests of a very long text are never held at once
        part = words[k : k + SLICE + size - 1]
        shingles = map(b" ".join, zip(*(part[j:] for j in range(size))))
        out[k : k + SLICE] = np.frombuffer(b"".join(map(partial(xxh64_digest, seed=SEED), shingles)), ">u8")
    return out


def _mixed(h: np.ndarray, lane: int | np.ndarray) -> np.ndarray:
    """Further 64-bit hashes of the same values."""
    z = h + np.asarray(lane, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64-bit words whose bits are set in over half of the hashes; zero without any. The first lane is the hashes' own."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(h) else 0):
        bytes_ = (_mixed(h, lane) if lane else h).astype(">u8").view(np.uint8).reshape(-1, 8)
        set_ = np.zeros(64, np.int64)
        for k in range(0, len(h), 255 * 64):
            part = SPREAD[bytes_[k : k + 255 * 64]]
            sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
            set_ += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * set_ > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (8 bytes) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(raw.as_py(), size)).astype(">u8").tobytes() for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(run, "doc_id long, fp binary")


# -- the self-join of one set of tries ---------------------------------------------------------------------------


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [low, high), one range after the other."""
    n = np.maximum(high - low, 0)
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def trie_pairs(
    values: np.ndarray, roots: list[tuple[int, int, int, int, int]], bits: int, budget: int, brief: list[np.ndarray] | None = None, labels: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j, differing bits) whose values differ in at most `budget` bits.

    values: `bits`-bit numbers, sorted within each range of roots, whose (low, high) is a binary trie in preorder. roots:
    (low, high, low2, high2, errors so far); equal ranges are a self-join. Node pairs are walked together level by level,
    adding up the bits in which they differ; a pair beyond the budget is dropped with all below it. Below the last level
    lie rows of equal values; their ranges are halved until single rows are left, so that these are paired too. If brief
    is a list, each row of such ranges is only paired with the first of the other range (of its own: the first and the
    next), and the rows that have further partners are appended to the list. With labels, pairs of rows of one label are
    left out, and so are node pairs that hold no others.
    """
    if not roots:
        return
    # ones[level][i]: rows before i with a one at the level; where a node's range splits follows in constant time.
    ones = np.zeros((bits, len(values) + 1), np.int32)
    for level in range(bits):
        np.cumsum((values >> np.uint64(bits - 1 - level)) & np.uint64(1), out=ones[level, 1:])
    if labels is not None:  # ends[i]: where the run of rows with the label of i ends
        cuts = np.flatnonzero(np.diff(labels)) + 1
        ends = np.append(cuts, len(labels))[np.searchsorted(cuts, np.arange(len(labels)), side="right")]
    stack = [(0, np.array(roots, np.int64))]
    while stack:
        level, front = stack.pop()
        if len(front) > FRONT:
            stack += [(level, part) for part in np.array_split(front, -(-len(front) // FRONT))]
            continue
        a, b, c, d, e = front.T
        if labels is not None:
            front = front[~((ends[a] >= b) & (ends[c] >= d) & (labels[a] == labels[c]))]
            a, b, c, d, e = front.T
        single = (b - a == 1) & (d - c == 1) & (a != c)  # two leaves: what is left is compared at once
        if single.any():
            i, j = a[single], c[single]
            mask = np.uint64((1 << max(bits - level, 0)) - 1)
            far = e[single] + np.bitwise_count((values[i] ^ values[j]) & mask).astype(np.int64)
            near = far <= budget
            if near.any():
                yield i[near], j[near], far[near]
        a, b, c, d, e = front[~single].T
        if not len(a):
            continue
        if level >= bits and brief is not None:
            self_ = a == c
            u, v, x, y = (z[~self_] for z in (a, b, c, d))
            i = [np.repeat(a[self_], (b - a - 1)[self_]), _spans(a[self_] + 1, b[self_] - 1), np.repeat(u, y - x), _spans(u + 1, v)]
            j = [_spans(a[self_] + 1, b[self_]), _spans(a[self_] + 2, b[self_]), _spans(x, y), np.repeat(x, v - u - 1)]
            far = [np.repeat(e[self_], (b - a - 1)[self_]), np.repeat(e[self_], (b - a - 2)[self_]), np.repeat(e[~self_], y - x), np.repeat(e[~self_], v - u - 1)]
            yield np.concatenate(i), np.concatenate(j), np.concatenate(far)
            more = np.where(self_, b - a > 3, (b - a > 1) & (d - c > 1))
            brief.append(np.unique(np.r_[_spans(a[more], b[more]), _spans(c[more], d[more])]))
            continue
        if level < bits:
            o, more = ones[level], 1
            m, n = b - (o[b] - o[a]), d - (o[d] - o[c])
        else:
            m, n, more = (a + b) // 2, (c + d) // 2, 0
        self_ = (a == c) & (b == d)
        open_ = e + more <= budget
        pairs = [
            np.stack((a, m, c, n, e), 1),
            np.stack((m, b, n, d, e), 1),
            np.stack((a, m, n, d, e + more), 1)[open_],
            np.stack((m, b, c, n, e + more), 1)[open_ & ~self_],
        ]
        front = np.concatenate(pairs)
        front = front[(front[:, 1] > front[:, 0]) & (front[:, 3] > front[:, 2])]
        front = front[~((front[:, 0] == front[:, 2]) & (front[:, 1] - front[:, 0] == 1) & (front[:, 3] - front[:, 2] == 1))]
        if len(front):
            stack.append((level + 1, front))


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j, weight), in their order, form a spanning forest."""
    nodes, flat = np.unique(pairs[:, :2], return_inverse=True)
    ij, parent, out = flat.reshape(-1, 2), list(range(len(nodes))), []
    rows = np.arange(len(pairs))
    while len(rows):
        now, rows = rows[:20_000], rows[20_000:]
        for r, (x, y) in zip(now.tolist(), ij[now].tolist()):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append(r)
        label = np.array(parent, np.int64)
        while (label[label] != label).any():
            label = label[label]
        rows = rows[label[ij[rows, 0]] != label[ij[rows, 1]]]  # those that would close a circle go unseen
    chosen = np.zeros(len(pairs), bool)
    chosen[out] = True
    return chosen


class Forest:
    """Minimum spanning forests of weighted pairs that come in parts: the first of all, the next of what it leaves, ..."""

    def __init__(self, layers: int = 1):
        self.layers, self.kept = layers, np.empty((0, 3), np.int64)
        self.cut: list[np.ndarray] = []  # nodes of the pairs left out
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> None:
        self.held.append(np.stack((i, j, weight), 1))
        self.n += len(i)
        if self.n > 1_000_000:
            self.edges()

    def edges(self) -> np.ndarray:
        """Rows (i, j, weight): at most `layers` times the nodes, connecting what all pairs connect by the closest."""
        pairs = np.concatenate([self.kept, *self.held])
        self.held, self.n = [], 0
        pairs = pairs[np.argsort(pairs[:, 2], kind="stable")]
        out = []
        for _ in range(self.layers):
            chosen = _spanning(pairs)
            out.append(pairs[chosen])
            pairs = pairs[~chosen]
            if not len(pairs):
                break
        if len(pairs):
            self.cut = [np.unique(np.concatenate([*self.cut, pairs[:, :2].ravel()]))]
        self.kept = np.concatenate(out)
        return self.kept


# -- the distributed join ----------------------------------------------------------------------------------------


def trie_join(tries: DataFrame, bits: int, budget: int, near: tuple[int, float] | None = None, layers: int | None = 1, brief: bool = False) -> DataFrame:
    """Edges (a, b) that connect all ids whose values in one trie differ in at most `budget` bits.

    tries: trie long (which one), value long (`bits` bits, 63 at most), id long, and if near = (bits, similarity) is given the
    longs of SKETCH, of which a pair may differ in so many bits at the most if both sets have TELLING elements, their number
    n, a bound core on the elements that a set can share with any other (n if nothing more is known; the similarity can't be
    reached where     the lesser core of a pair is too small for its sizes), and a label long: ids of one label are connected
    already. With a column map (binary, see shingle_map) a pair also goes where its maps show that too few elements can be
    shared. A pair of a trie is given through `layers` spanning forests, so that a dense family isn't spelled out in all its
    pairs, or as it is if layers is None. With near, an edge (a, a) says that pairs of a were left out.

    The rows of a trie beyond HOT are dealt to its node pairs HOT_LEVELS down, each with the bits in which they differ so
    far, where the budget leaves few such pairs. What is still beyond HOT is cut into parts of about HOT rows, and each pair
    of parts is a cell of its own. So no task holds more than a few times HOT rows of one trie, and no pair is lost.
    """
    hot, levels = HOT, HOT_LEVELS
    columns = ["trie", "value", "id"] + ([*SKETCH, "n", "core", "label"] if near else []) + (["map"] if "map" in tries.columns else [])
    tries = tries.select(*columns)
    crowded = materialize(tries.groupBy("trie").count().where(F.col("count") > hot).select("trie"))
    masks = [m for m in range(1 << levels) if m.bit_count() <= budget]
    levels, masks = (levels, masks) if len(masks) <= 64 else (0, [0])
    dealt = tries.join(crowded, "trie", "left_semi").withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    node = F.shiftrightunsigned("value", bits - levels) if levels else F.lit(0).cast("long")
    other = node.bitwiseXOR(F.col("mask"))
    cell = F.shiftleft(F.least(node, other), 16) + F.col("mask") + 1 if levels else F.lit(0)
    dealt = dealt.select(*columns, cell.cast("long").alias("cell"), F.bit_count("mask").alias("errors"), (node > other).cast("int").alias("side"))
    parts = materialize(
        dealt.groupBy("trie", "cell").count().where(F.col("count") > hot).select("trie", "cell", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    )
    dealt = dealt.join(parts, ["trie", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    across = F.when(F.col("side") == 0, F.col("own") * F.col("parts") + F.col("other")).otherwise(F.col("other") * F.col("parts") + F.col("own"))
    inside = F.col("errors") == 0
    dealt = dealt.select(
        *columns, "cell", "errors", F.when(inside, first * F.col("parts") + second).otherwise(across).cast("long").alias("part"),
        F.when(inside, F.col("own") > F.col("other")).otherwise(F.col("side") == 1).cast("int").alias("side"),
        (~inside | (F.col("own") != F.col("other"))).alias("crossed"),
    )
    whole = tries.join(crowded, "trie", "left_anti").select(
        *columns, F.lit(0).cast("long").alias("cell"), F.lit(0).alias("errors"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), F.lit(False).alias("crossed")
    )
    rows = whole.unionByName(dealt)
    groups = max(12, int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    run = partial(_run, bits=bits, levels=levels, budget=budget, near=near, layers=layers, brief=brief)
    order = ["trie", "cell", "part", "side", "value"] + (["label"] if near else []) + ["id"]
    return rows.repartition(groups, "trie", "cell", "part").sortWithinPartitions(*order).mapInPandas(run, "a long, b long").distinct()


def _run(batches: Iterator[pd.DataFrame], **how) -> Iterator[pd.DataFrame]:
    for frame in _grouped(batches):
        yield from _join(frame, **how)


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (trie, cell, part) groups, several together, from sorted batches."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= GROUP:
            frame = pd.concat(held, ignore_index=True)
            last = np.logical_and.reduce([frame[c] == frame[c].iat[-1] for c in ("trie", "cell", "part")])
            first = len(frame) - int(last.sum())
            if first:
                yield frame.iloc[:first].reset_index(drop=True)
            held = [frame.iloc[first:]]
            n = len(frame) - first
    if n:
        yield pd.concat(held, ignore_index=True)


def _join(frame: pd.DataFrame, bits: int, levels: int, budget: int, near: tuple[int, float] | None, layers: int | None, brief: bool) -> Iterator[pd.DataFrame]:
    values = frame["value"].to_numpy().astype(np.uint64)
    ids, sides, cells, errors, crossed = (frame[c].to_numpy() for c in ("id", "side", "cell", "errors", "crossed"))
    new = np.r_[True, np.logical_or.reduce([np.diff(frame[c].to_numpy()) != 0 for c in ("trie", "cell", "part")])]
    starts = np.r_[np.flatnonzero(new), len(frame)]
    roots = []
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if not crossed[low]:
            if high - low > 1:
                roots.append((low, high, low, high, int(errors[low])))
        elif 0 < (right := int(sides[low:high].sum())) < high - low:
            roots.append((low, high - right, high - right, high, int(errors[low])))
    sketch = np.ascontiguousarray(frame[list(SKETCH)].to_numpy()).view(np.uint64) if near else None
    sizes, cores = (frame["n"].to_numpy(), frame["core"].to_numpy()) if near else (None, None)
    labels = frame["label"].to_numpy() if near else None
    maps = np.frombuffer(b"".join(frame["map"]), np.uint64).reshape(len(frame), -1) if "map" in frame else None
    forest = Forest(layers or 1)
    more: list[np.ndarray] | None = [] if brief else None
    for deep in (False, True):  # the rows of a cell lie below one node or two, so many levels down
        depth = bits - levels if deep else bits
        part = [r for r in roots if bool(cells[r[0]]) == deep]
        for i, j, far in trie_pairs(values & np.uint64((1 << depth) - 1) if deep else values, part, depth, budget, more, labels):
            if near:
                far = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
                # A similarity of s takes s / (1 + s) of both sizes in common.
                ok = ((far <= near[0]) | (np.minimum(sizes[i], sizes[j]) < TELLING)) & (
                    (1 + near[1]) * np.minimum(cores[i], cores[j]) >= near[1] * (sizes[i] + sizes[j]) - 1e-6
                )
                i, j, far = i[ok], j[ok], far[ok]
            if maps is not None:
                ok = (1 + near[1]) * most_shared(maps, sizes, i, j) >= near[1] * (sizes[i] + sizes[j]) - 1e-6
                i, j, far = i[ok], j[ok], far[ok]
            if layers:
                forest.add(i, j, far)
            else:
                yield pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}).drop_duplicates()
    edges = forest.edges()
    a, b = ids[edges[:, 0]], ids[edges[:, 1]]
    cut = ids[np.unique(np.concatenate([*forest.cut, *(more or []), np.empty(0, np.int64)]))] if near else a[:0]
    yield pd.DataFrame({"a": np.r_[np.minimum(a, b), cut], "b": np.r_[np.maximum(a, b), cut]})


def hamming_edges(fps: DataFrame, budget: int = 2) -> DataFrame:
    """Edges (a, b) that connect all rows (id, fp long) whose 64-bit fingerprints differ in at most `budget` bits.

    Two such fingerprints agree in one of budget + 1 blocks of bits. Each block in turn stands on top, without errors, and
    so names a trie of the fingerprints that share it; the trie below it holds the other bits.
    """
    blocks = budget + 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = []
    widest = max(64 - (b - a) for a, b in zip(cuts, cuts[1:]))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        width = b - a
        top = F.shiftrightunsigned("fp", 64 - b).bitwiseAND(F.lit((1 << width) - 1))
        low = F.col("fp").bitwiseAND(F.lit((1 << (64 - b)) - 1)) if b < 64 else F.lit(0)
        high = F.shiftrightunsigned("fp", 64 - a) if a else F.lit(0)
        parts.append(F.struct(
            (top * blocks + k).cast("long").alias("trie"),
            F.shiftleft(high.cast("long"), 64 - b).bitwiseOR(low).cast("long").alias("value"),
        ))
    tries = fps.select("id", F.explode(F.array(*parts)).alias("t")).select("t.trie", "t.value", "id")
    return trie_join(tries, widest, budget)


def simhash_components(docs: DataFrame, budget: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row: fingerprints at most `budget` bits apart are linked.

    A null text has no words and the fingerprint zero, and is linked like any other. Equal fingerprints are joined once,
    under their smallest doc_id; rows with a null doc_id get the component of the others with their fingerprint. Repeated
    rows are returned each. Only key and text are read, so other columns can't clash. An empty table gives no rows.
    """
    rows = materialize(
        fingerprints(docs, key=key, text=text).select("doc_id", F.conv(F.hex("fp"), 16, -10).cast("long").alias("fp"), F.lower(F.hex("fp")).alias("fingerprint"))
    )
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = connected_components(hamming_edges(fps.where("id is not null"), budget))
    named = fps.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fingerprint", "component_id")


# -- near duplicates by the similarity of their shingles ---------------------------------------------------------


def differing_share(similarity: float) -> float:
    """The share of SimHash bits in which two sets of equal size and this Jaccard similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def bands_for(similarity: float, recall: float) -> int:
    """Bands of MINIMA minima of which two sets of this Jaccard similarity share one with the recall wanted."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**MINIMA))


def most_differing(bits: int, similarity: float, deviations: float) -> int:
    """Bits in which SimHashes of so many bits differ at this similarity, so many standard deviations above the mean."""
    p = differing_share(similarity)
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def minima(h: np.ndarray, bands: int) -> np.ndarray:
    """A number for each band: of MINIMA minima of the set under further hashes, so that equal sets have equal numbers."""
    low = np.full(MINIMA * bands, np.iinfo(np.uint64).max, np.uint64)
    lanes = np.arange(16, 16 + MINIMA * bands)[:, None]
    for k in range(0, len(h), 1 << 16):
        low = np.minimum(low, _mixed(h[None, k : k + (1 << 16)], lanes).min(axis=1))
    out = np.arange(1, bands + 1).astype(np.uint64)
    for k in range(MINIMA):
        out = _mixed(out ^ low[k::MINIMA], 1)
    return out.view(np.int64)


def shingle_map(h: np.ndarray) -> bytes:
    """MAP_BITS bits, of which each element of a set of hashes sets one."""
    bits = np.zeros(MAP_BITS, bool)
    bits[h % np.uint64(MAP_BITS)] = True
    return np.packbits(bits).tobytes()


def most_shared(maps: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A bound from above on the elements that the sets i and j share, from their maps (rows of 64-bit words) and sizes.

    What they share lies on the bits that both maps have. A set of n elements on k bits has at most n - k more elements
    on these bits than there are bits, so that the lesser of these surpluses is all that can be added.
    """
    both = np.empty(len(i), np.int64)
    for k in range(0, len(i), MAP_PAIRS):
        part = slice(k, k + MAP_PAIRS)
        both[part] = np.bitwise_count(maps[i[part]] & maps[j[part]]).sum(axis=1, dtype=np.int64)
    surplus = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    return both + np.minimum(surplus[i], surplus[j])


def sketches(docs: DataFrame, size: int, bands: int, key: str, text: str) -> DataFrame:
    """doc_id, own (a hash of the set of shingles), n (its size), value (63 bits of its SimHash), SKETCH (others), tries (its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            own, fps, keys, sizes = [], [], [], []
            for raw in batch.column(1):
                h = np.unique(shingle_hashes(raw.as_py(), size))
                own.append(xxh64_intdigest(h.tobytes()))
                fps.append(fingerprint(h, 1 + len(SKETCH)))
                keys.append(minima(h, bands))
                sizes.append(len(h))
            n = batch.num_rows
            fps = np.array(fps, np.uint64).reshape(n, 1 + len(SKETCH))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * n + 1, bands), pa.int32()), pa.array(np.array(keys, np.int64).reshape(-1)))
            fps[:, 0] >>= np.uint64(1)
            numbers = [np.array(own, np.uint64).view(np.int64), np.array(sizes, np.int64), *np.ascontiguousarray(fps.T).view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers), lists], names)

    names = ["doc_id", "own", "n", "value", *SKETCH, "tries"]
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", tries array<long>"
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, *, recall: float = 0.999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of every document that isn't alone: texts linked by at least the similarity of shingle sets.

    Texts with equal sets of shingles are one class, compared once. A class stands in a few tries, each of the classes that
    share a band of minima of their shingles (so many bands that two sets at the least similarity meet with the recall
    wanted); the work per text is the same at every number of texts. In each trie the self-join finds SimHashes within the
    error budget of the similarity, and further bits and the sizes of the sets drop chance pairs on the spot. What is found is verified by the
    exact Jaccard similarity of the shingles, and components are formed of the pairs that pass: first of classes in tries of
    over FAMILY with the first of their trie, so that a dense family carries one label and its node pairs are passed over;
    then of a few spanning forests; then in further ROUNDS of the pairs left out whose texts verified links have not
    connected, and at last of all of these. Of classes with pairs left out the shingles are counted: what no other of them
    has can't be shared, so that pairs of texts of one template with too much of their own are dropped by two numbers, and
    exactly; a map of the shingles in MAP_BITS bits gives a second exact bound for each pair, on which nearly all pairs below
    the similarity fall that would be verified otherwise (texts of far more words than bits pass it). A pair is verified in a cell of parts of the classes by sorted hashes, which are sent once to each cell.

    Null and empty texts are copies of each other; rows of one doc_id count as one document, which has no link to itself;
    a null doc_id takes no part. Only key and text are read. An empty table gives no rows.
    """
    bands, budget, near = bands_for(similarity, recall), most_differing(63, similarity, 4.5), most_differing(64 * len(SKETCH), similarity, 3.7)
    rows = materialize(sketches(docs.where(F.col(key).isNotNull()), size, bands, key, text))
    classes = materialize(rows.groupBy("own", "value").agg(F.min("doc_id").alias("id"), *[F.min(c).alias(c) for c in ("n", *SKETCH, "tries")]))
    copies = rows.join(classes.select("own", "value", "id"), ["own", "value"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(raw.as_py(), size)).tobytes() for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "h"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [shingle_map(np.unique(shingle_hashes(raw.as_py(), size))) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["id", "map"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.unique(shingle_hashes(raw.as_py(), size)).view(np.int64)
                for k in range(0, len(h), SLICE):
                    part = h[k : k + SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), pa.array(part)], ["id", "h"])

    def alike(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        h = {i: np.frombuffer(x, np.uint64) if x else np.empty(0, np.uint64) for i, x in zip(sets["id"].to_pylist(), sets["h"].to_pylist())}
        keep = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            both = len(np.intersect1d(h[a], h[b], assume_unique=True))
            keep.append(both >= similarity * (len(h[a]) + len(h[b]) - both))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs of at least the similarity. A text is hashed once and sent to each cell that has a pair of it once."""
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sets = materialize(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(hashed, "id long, h binary"))
        total, k = sets.agg(F.coalesce(F.sum(F.length("h")), F.lit(0)), F.count("*")).first()
        n, mean = pairs.count(), total / max(1, k)
        side = math.ceil(max(1, (n / CELL_PAIRS) ** 0.5, min((2 * n * mean / CELL_BYTES) ** 0.5, 2 * total / CELL_BYTES)))
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        celled = pairs.select("a", "b", (part("a") * side + part("b")).alias("cell"))
        wanted = celled.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("id")).distinct()
        return wanted.join(sets, "id").groupBy("at").cogroup(celled.groupBy("cell")).applyInArrow(alike, "a long, b long")

    def bounded(some: DataFrame) -> DataFrame:
        """core without the shingles that no other of these classes has, and the map of all shingles."""
        own = texts.join(some.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
        every = own.mapInArrow(spelled, "id long, h long")
        alone = every.groupBy("h").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count("*").alias("own_only"))
        core = F.greatest(F.lit(0), F.col("n") - F.coalesce("own_only", F.lit(0)))
        return some.join(own.mapInArrow(mapped, "id long, map binary"), "id").join(alone, "id", "left").withColumn("core", core).drop("own_only")

    columns = ["id", "value", "n", "core", *SKETCH]
    classes = classes.withColumn("core", F.col("n"))
    dealt = classes.select(F.explode("tries").alias("trie"), *columns)
    first = materialize(dealt.groupBy("trie").agg(F.count("*").alias("k"), F.min(F.struct(*columns)).alias("p")).where(F.col("k") > FAMILY))
    apart = lambda *c: sum(F.bit_count(F.col(x).bitwiseXOR(F.col(f"p.{x}"))) for x in c)
    low, high = F.least("n", "p.n"), F.greatest("n", "p.n")
    alike_at_sight = (apart("value") <= budget) & ((apart(*SKETCH) <= near) | (low < TELLING)) & (low >= similarity * high)
    star = dealt.join(first, "trie").where((F.col("id") != F.col("p.id")) & alike_at_sight)
    tested = materialize(star.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct())
    links = materialize(copies.union(verified(tested)))
    components = connected_components(links)
    left = classes
    for layers in ROUNDS:
        named = materialize(left.join(components, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"))
        dealt = named.select(F.explode("tries").alias("trie"), *columns, "label", *(["map"] if "map" in left.columns else []))
        mixed = materialize(dealt.groupBy("trie").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("trie"))
        found = materialize(trie_join(dealt.join(mixed, "trie", "left_semi"), 63, budget, (near, similarity), layers, brief=left is classes))
        pairs = materialize(found.where("a < b").join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tested = tested.union(pairs)
            links = materialize(links.union(verified(pairs)))
            components = connected_components(links)
        cut = found.where("a = b").select(F.col("a").alias("id"))
        if cut.isEmpty():
            break
        left = materialize(bounded(classes.join(cut, "id", "left_semi")))
    return components.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
