"""Vectors dealt to cells of like direction, and the bounds on angles by which whole cells are left out of a search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import materialize

#: Vectors of a cell in the mean, centres at most, and vectors that these are learnt from: the driver holds no more of them.
CELL, CENTRES, SAMPLE = 4096, 2048, 8192
#: Rings of a cell by the angle to its centre; a single centre has one.
RINGS, WIDTH = 16, np.pi / 24
#: Rows of either side that one task holds, and cosines that one step of it computes.
QUERY_BLOCK, CORPUS_BLOCK, STEP = 2_000, 8_000, 4_000_000
#: How many times as many where few rows of each query leave a task, columns of one step, numbers of one slice of a frame, candidates kept
#: before they are cut to the best, and candidates that are computed in double precision at once.
WIDE, COLUMNS, SLICE, KEPT, PART = 8, 4_096, 2_000_000, 1_000_000, 50_000
#: What rounding may cost an angle.
SLACK = 1e-6


def unit(column: pd.Series) -> np.ndarray:
    """The vectors scaled to length 1; zero stays zero, and so has cosine 0 with all."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    """k directions that lie in the sample as its vectors do: a few rounds of spherical k-means."""
    rng = np.random.default_rng(11)
    found = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(5):
        at = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, at, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norm > 0, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0), found)
    return found


class Bounds:
    """Centres of directions, and for each ring about one that isn't empty the angles and the number of its vectors."""

    def __init__(self, centres: np.ndarray, stats: list):
        self.centres = centres
        self.cell = np.array([r[0] for r in stats], np.int64)
        self.low, self.high = (np.array([r[k] for r in stats], np.float64) for k in (1, 2))
        self.size = np.array([r[3] for r in stats], np.int64)

    def least_angles(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least angle to any vector of each cell, angle to the centre of each cell) of the rows."""
        if not len(self.cell):
            return np.zeros((len(x), 0)), np.zeros((len(x), 0))
        to = _angles(x, self.centres)[:, self.cell // RINGS]
        return np.maximum(np.maximum(to - self.high, self.low - to), 0.0), to

    def within(self, angle: float) -> Callable[[pd.DataFrame], np.ndarray]:
        """Which cells may hold a vector at most so far from each query.

        Besides the bound of the ring: if y is within the angle of x, then y's centre is at most twice the angle farther from x
        than x's nearest centre, as y is no farther from its own centre than from that one.
        """

        def choose(f: pd.DataFrame) -> np.ndarray:
            least, to = self.least_angles(unit(f["vector"]))
            on = least <= angle + SLACK
            if angle < np.pi / 2 and len(self.cell):
                near = _angles(unit(f["vector"]), self.centres).min(axis=1, keepdims=True)
                on &= to <= near + 2 * angle + SLACK
            return on

        return choose

    def first(self, queries: DataFrame, n: int) -> DataFrame:
        """The queries with `visited`: the numbers of the cells of least possible angle that together hold n vectors.

        Written once, as what a second visit leaves out must be what the first one saw, whatever rounding does to ties.
        """

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _sliced(frames, len(self.cell)):
                least, to = self.least_angles(unit(f["vector"]))
                order = np.lexsort((to, least), axis=1)
                before = np.cumsum(self.size[order], axis=1) - self.size[order]
                yield f.assign(visited=[o[: int(k)] for o, k in zip(order, (before < n).sum(axis=1))])

        kind = queries.schema["vector"].dataType.simpleString()
        return materialize(queries.mapInPandas(run, f"query_id long, vector {kind}, visited array<long>"))

    def seen(self, f: pd.DataFrame) -> np.ndarray:
        """The cells that `first` chose."""
        on = np.zeros((len(f), len(self.cell)), bool)
        for row, k in zip(on, f["visited"]):
            row[np.asarray(k, np.int64)] = True
        return on

    def better(self, f: pd.DataFrame) -> np.ndarray:
        """The cells that `first` left out and that may hold a cosine of the query's `floor` or more."""
        least, _ = self.least_angles(unit(f["vector"]))
        floor = np.arccos(np.clip(f["floor"].to_numpy(np.float64), -1.0, 1.0))
        return ~self.seen(f) & (least <= floor[:, None] + SLACK)


class Cells:
    """A corpus (id, vector) in cells, written once to the shared folder.

    A cell is a ring about a centre: the vectors whose nearest centre it is and whose angle to it lies between `low` and
    `high`. The angle between two unit vectors is a metric, so that a vector at the angle a of the centre is at least
    max(a - high, low - a) away from all of the cell. Centres only decide how much is left out, not what is found.
    What the driver holds are the centres and one row for each cell that isn't empty (CENTRES * RINGS at most).
    """

    def __init__(self, corpus: DataFrame):
        rows = corpus.select(F.col("id").cast("long").alias("id"), F.col("vector")).where("vector is not null")
        n = rows.count()
        share = min(1.0, SAMPLE / max(n, 1))
        chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(4 * SAMPLE).toPandas() if n else None
        sample = unit(chosen["vector"]) if n and len(chosen) else np.ones((1, 1))
        centres = _centres(sample, int(np.clip(-(-n // CELL), 1, CENTRES)))

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _sliced(frames, len(centres)):
                a = _angles(unit(f["vector"]), centres)
                at = a.argmin(axis=1)
                own = a[np.arange(len(f)), at]
                ring = np.minimum(own / WIDTH, RINGS - 1 if len(centres) > 1 else 0).astype(np.int64)
                yield f.assign(cell=at * RINGS + ring, angle=own)

        kind = rows.schema["vector"].dataType.simpleString()
        self.rows = materialize(rows.mapInPandas(assign, f"id long, vector {kind}, cell long, angle double"))
        stats = self.rows.groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count("*")).orderBy("cell").collect()
        self.bounds = Bounds(centres, stats)
        self.compared = 0

    def _units(self, most: int) -> np.ndarray:
        """The unit of each cell: neighbouring cells that together hold at most so many vectors. A cell with more is a unit by itself."""
        out, unit_, held = np.zeros(len(self.bounds.cell), np.int64), -1, most + 1
        for k, size in enumerate(self.bounds.size):
            if held + size > most:
                unit_, held = unit_ + 1, 0
            out[k], held = unit_, held + size
        return out

    def meet(self, queries: DataFrame, choose: Callable, found: Callable, schema: str, wide: bool = False) -> DataFrame:
        """found(Block) of the queries (query_id, vector, ...) and the cells that `choose` gives each.

        A task holds the queries of a unit of cells and its vectors; a query goes to a unit once, with a bit for each of its cells.
        Beyond QUERY_BLOCK or CORPUS_BLOCK of them they are dealt to several tasks by hash, so that a crowded cell is no single
        task; `wide` takes WIDE times as many, for what tells only a few rows of each query. Neither side is broadcast, and rows
        are handed on in slices of SLICE numbers. `compared` counts the cosines. A `floor` of the queries is given to the block.
        """
        most_queries, most_rows = (n * (WIDE if wide else 1) for n in (QUERY_BLOCK, CORPUS_BLOCK))
        cells, sizes, unit_of = self.bounds.cell, self.bounds.size, self._units(most_rows)
        n_units = int(unit_of[-1]) + 1 if len(cells) else 0
        at = [np.flatnonzero(unit_of == u) for u in range(n_units)]
        kind = queries.schema["vector"].dataType.simpleString()
        floored = "floor" in queries.columns

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _sliced(frames, len(cells)):
                on = choose(f)
                units = np.array([on[:, k].any(axis=1).sum() for k in at], np.int64)
                yield pd.DataFrame({"cell": np.concatenate([np.arange(len(cells)), -1 - np.arange(n_units)]), "k": np.concatenate([on.sum(axis=0), units]).astype(np.int64)})

        asked = {r[0]: r[1] for r in queries.mapInPandas(ask, "cell long, k long").groupBy("cell").agg(F.sum("k")).collect()} if len(cells) else {}
        self.compared += sum(int(s) * int(asked.get(k, 0)) for k, s in enumerate(sizes))
        rows_in = np.array([sizes[k].sum() for k in at], np.int64)
        held = np.maximum(-(-rows_in // most_rows), 1)
        asking = np.array([-(-int(asked.get(-1 - u, 0)) // most_queries) for u in range(n_units)], np.int64)
        place = {int(c): k for k, c in enumerate(cells)}
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)).alias("salt")

        def deal_queries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _sliced(frames, max(len(cells), int(held.max(initial=1)) * 64)):
                on = choose(f)
                for u, k in enumerate(at):
                    i = np.flatnonzero(on[:, k].any(axis=1))
                    if not len(i):
                        continue
                    bits = [b.tobytes() for b in np.packbits(on[np.ix_(i, k)], axis=1)]
                    part = f["salt"].to_numpy()[i] % max(asking[u], 1)
                    floor = f["floor"].to_numpy(np.float64)[i] if floored else np.full(len(i), -2.0)
                    one = pd.DataFrame({"query_id": f["query_id"].to_numpy()[i], "vector": f["vector"].to_numpy()[i], "floor": floor, "cells": bits})
                    for h in range(int(held[u])):
                        yield one.assign(task=(u << 40) + (h << 20) + part)

        def deal_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in _sliced(frames, int(asking.max(initial=1)) * 64):
                k = np.array([place[int(c)] for c in f["cell"]], np.int64)
                u = unit_of[k]
                i = np.repeat(np.arange(len(f)), asking[u])
                part = np.arange(len(i)) - np.repeat(np.cumsum(asking[u]) - asking[u], asking[u])
                mine = f["salt"].to_numpy()[i] % held[u[i]]
                yield pd.DataFrame({"task": (u[i] << 40) + (mine << 20) + part, "id": f["id"].to_numpy()[i], "cell": k[i], "vector": f["vector"].to_numpy()[i]})

        left = queries.select("query_id", "vector", *[c for c in queries.columns if c not in ("query_id", "vector")], salt("query_id")).mapInPandas(
            deal_queries, f"query_id long, vector {kind}, floor double, cells binary, task long"
        )
        own = self.rows.schema["vector"].dataType.simpleString()
        right = self.rows.select("id", "vector", "cell", salt("id")).mapInPandas(deal_rows, f"task long, id long, cell long, vector {own}")

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return found(Block(a, b, unit_of))

        return left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(block, schema)


def _sliced(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The frames in slices of so many rows that SLICE numbers are held when each row has `width` of them."""
    step = max(1, SLICE // max(width, 1))
    for f in frames:
        for k in range(0, len(f), step):
            yield f.iloc[k : k + step]


class Block:
    """The queries and the vectors of one task: ids, unit vectors and which queries ask which cell."""

    def __init__(self, a: pd.DataFrame, b: pd.DataFrame, unit_of: np.ndarray):
        b = b.sort_values(["cell", "id"])  # within a cell ties go to the smallest id
        self.x, self.y = (unit(f["vector"]) if len(f) else np.zeros((0, 1)) for f in (a, b))
        self.asks, self.ids = a["query_id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
        self.floor, self.cell = a["floor"].to_numpy(np.float64), b["cell"].to_numpy(np.int64)
        self.bits, self.unit_of = a["cells"], unit_of

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of queries, rows of vectors) that are to be compared, at most about STEP pairs at once."""
        if not len(self.asks) or not len(self.ids):
            return
        on = np.unpackbits(np.frombuffer(b"".join(self.bits), np.uint8).reshape(len(self.asks), -1), axis=1).astype(bool)
        starts = np.flatnonzero(np.r_[True, self.cell[1:] != self.cell[:-1]])
        first = np.flatnonzero(self.unit_of == self.unit_of[self.cell[0]])[0]
        groups: list = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(self.cell)]):
            i = np.flatnonzero(on[:, self.cell[lo] - first])
            if groups and np.array_equal(groups[-1][0], i):
                groups[-1] = (i, groups[-1][1], hi)  # cells that the same queries ask are one product
            elif len(i):
                groups.append((i, lo, hi))
        for i, lo, hi in groups:
            for c in range(lo, hi, COLUMNS):
                j = np.arange(c, min(c + COLUMNS, hi))
                step = max(1, STEP // len(j))
                for k in range(0, len(i), step):
                    yield i[k : k + step], j


def finite(x: np.ndarray) -> np.ndarray:
    """Single precision for the first look. Vectors that aren't finite are near nothing."""
    return np.where(np.isfinite(x).all(axis=1, keepdims=True), x, np.nan).astype(np.float32)


class Best:
    """The n greatest cosines of each row of x with rows of y, ties to the smallest id; exact.

    Cosines in single precision, with a bound on their error, say which pairs can be among the n best: they reach the row's
    floor, which is raised by the n-th best of the maxima of groups of columns. Those pairs only are computed in double precision.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, n: int, floor: np.ndarray, spare: int = 0):
        self.x, self.y, self.ids, self.n, self.spare = x, y, ids, n, spare
        self.x32, self.y32 = finite(x), finite(y)
        self.eps = (x.shape[1] + 8) * 1.2e-7
        self.low = (floor - self.eps - 1e-11).astype(np.float32)
        self.kept: list = []
        self.waiting = 0

    def add(self, i: np.ndarray, j: np.ndarray, leave_out: Callable | None = None, own: np.ndarray | None = None) -> None:
        """Compares the rows i of x with j of y; leave_out sets cosines of pairs that don't count to -inf; own: the ids of i, which don't count."""
        s = self.x32[i] @ self.y32[j].T
        if leave_out is not None:
            leave_out(s, i, j)
        need, wide = self.n + self.spare, len(j) // (4 * (self.n + self.spare))
        if wide > 1:
            count = len(j) // wide
            heads = s[:, : count * wide].reshape(len(i), count, wide).max(axis=2)
            heads[np.isnan(heads)] = -np.inf
            self.low[i] = np.maximum(self.low[i], np.partition(heads, count - need, axis=1)[:, count - need] - np.float32(2 * self.eps))
        at = np.flatnonzero(s >= self.low[i][:, None])
        a, b = i[at // len(j)], j[at % len(j)]
        if own is not None:
            other = own[a] != self.ids[b]
            a, b = a[other], b[other]
        if len(a):
            self.kept.append((a, b, np.concatenate([np.einsum("ij,ij->i", self.x[a[k : k + PART]], self.y[b[k : k + PART]]) for k in range(0, len(a), PART)])))
            self.waiting += len(a)
            if self.waiting > 2 * KEPT + 2 * self.n * len(self.x):
                self._cut()

    def _cut(self) -> None:
        a, b, s = (np.concatenate(x) for x in zip(*self.kept))
        rounded = np.round(s, 12)
        order = np.lexsort((self.ids[b], -rounded, a))
        a, b, s, rounded = a[order], b[order], s[order], rounded[order]
        place = np.arange(len(a))
        nth = place - np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], place, 0))
        full = nth == self.n - 1
        self.low[a[full]] = np.maximum(self.low[a[full]], (rounded[full] - self.eps - 1e-11).astype(np.float32))
        on = nth < self.n
        self.kept, self.waiting = [(a[on], b[on], s[on])], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, row of y, cosine) of what is best."""
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._cut()
        return self.kept[0]
