"""Operator 8: near-duplicate vectors by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import connected_components, materialize
from .simhash import Forest

#: Vectors from which the codebooks are learnt, at the least, and vectors for each centre; all else covers all vectors.
SAMPLE, PER_CENTRE = 20_000, 8
#: Vectors that a cell should hold; centres of each half in a block, so that SIDE * SIDE cells are one group of the join.
PER_CELL, SIDE = 24, 9
#: Members and probes of a group that one task compares; fuller groups are split.
MEMBERS, PROBES = 8_000, 32_000
#: The first of the numbers by which classes without an id go.
UNNAMED = 1 << 62


def learn_codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of Lloyd's k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def multi_sequence(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The nearest cells of the product grid for each vector, nearest first.

    Both codebooks are ranked by distance. A cell at ranks (i, j) comes after all at ranks (<= i, <= j), so that only those
    with (i + 1)(j + 1) <= cells can be among the first: the staircase that the traversal walks.
    """
    half, (one, two) = x.shape[1] // 2, books
    d1 = (one**2).sum(1) - 2 * x[:, :half] @ one.T
    d2 = (two**2).sum(1) - 2 * x[:, half:] @ two.T
    cells = min(cells, len(one) * len(two))
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    i, j = (np.array(z) for z in zip(*((a, b) for a in range(min(cells, len(one))) for b in range(min(len(two), cells // (a + 1))))))
    sums = np.take_along_axis(d1, o1[:, i], 1) + np.take_along_axis(d2, o2[:, j], 1)
    first = np.argsort(sums, axis=1, kind="stable")[:, :cells]
    return np.take_along_axis(o1, i[first], 1) * len(two) + np.take_along_axis(o2, j[first], 1)


def in_blocks(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which aligned blocks of SIDE are near each other: halved along the longest axis."""
    if len(centres) <= SIDE:
        return centres
    middle = centres - centres.mean(axis=0)
    axis = np.linalg.svd(middle, full_matrices=False)[2][0] if middle.any() else np.ones(centres.shape[1])
    order = np.argsort(middle @ axis, kind="stable")
    half = -(-len(centres) // (2 * SIDE)) * SIDE
    return np.concatenate([in_blocks(centres[order[:half]]), in_blocks(centres[order[half:]])])


def cells_for_recall(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], least: float, recall: float, seed: int = 11) -> int:
    """Cells to visit so that a neighbour at the least cosine, in a random direction, is found by one of the pair.

    The number is doubled until it is enough; at most it is all cells, which is exact.
    """
    rng = np.random.default_rng(seed)
    x = x[rng.choice(len(x), size=min(len(x), 2000), replace=False)]
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(1, keepdims=True) * x
    r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    y = least * x + np.sqrt(1 - least**2) * r
    most, every = 64, len(books[0]) * len(books[1])
    while True:
        there = multi_sequence(x, books, most), multi_sequence(y, books, most)
        rank = np.minimum(*(np.where((a == b[:, :1]).any(1), (a == b[:, :1]).argmax(1), most) for a, b in (there, there[::-1])))
        need = int(np.quantile(rank, recall, method="higher") + 1)
        if need <= most or most >= every:
            return min(need, every)
        most *= 2


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(table: DataFrame, least: float = 0.9, recall: float = 0.98, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are one class and are compared once. Each class is a member of its nearest cell and probes the cells
    that multi-sequence traversal visits first, as many as find a neighbour at the least cosine with the recall wanted (all
    cells at recall 1, which is exact); what they find is verified in double precision. Cells are joined in groups of SIDE
    by SIDE, whose centres are near each other, so that a vector is sent to a few groups and not to each cell. A link found
    from both sides counts once. Groups with many members or probes are split among tasks. A dense cell returns counts and
    a spanning forest of its links, not its pairs. The codebooks grow with the root of the number of vectors.

    A null or zero vector, or one with null or non-finite components, links with nothing. Vectors of different lengths aren't
    compared: each length has an index of its own, one after the other, as a table has few. Repeated rows are copies. A row
    with a null id is compared and counted like any other and returned with kept false; its component_id is null if nothing
    that it reaches has an id. Ids lie below 2^62. Only the two columns are read. An empty table gives no rows.
    """
    single = table.schema[vector].dataType == ArrayType(FloatType(), table.schema[vector].dataType.containsNull)
    kind = np.float32 if single else np.float64
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("e"))
    fine = F.coalesce(
        F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0.0), F.lit(False)
    )
    rows = materialize(rows.select("vec_id", "e", fine.alias("fine"), F.xxhash64("e").alias("h"), F.xxhash64(F.lit(7), "e").alias("h2")))
    # A class without an id goes by a number beyond the ids, so that it never names a component that holds one.
    key_ = F.coalesce(F.min("vec_id"), F.xxhash64("h", "h2").bitwiseAND(UNNAMED - 1).bitwiseOR(UNNAMED)).alias("id")
    classes = materialize(rows.where("fine").groupBy("h", "h2").agg(key_, F.count("*").alias("copies"), F.first("e").alias("e")))
    sizes = classes.groupBy(F.size("e").alias("width")).count().orderBy("width").collect()
    nothing = rows.select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"), "fine"
    )
    if not sizes:
        return nothing.drop("fine")
    found = reduce(DataFrame.union, [_links(classes.where(F.size("e") == s["width"]), s["count"], s["width"], kind, least, recall) for s in sizes])
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b is not null").select("a", "b"))
    component = F.coalesce("component", "id")
    result = classes.select("h", "h2", "id", "copies").join(counts, "id", "left").join(components, "id", "left").select(
        "h", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(component < UNNAMED, component).alias("component_id")
    )
    some = rows.where("fine").join(result, ["h", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return some.unionByName(nothing.where("not fine").drop("fine"))


def _links(known: DataFrame, n: int, width: int, kind: type, least: float, recall: float) -> DataFrame:
    """Rows (a, b, n) of n classes of one length: with null b the links that a class has outside of it, else an edge."""
    k = max(1, round((n / PER_CELL) ** 0.5))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, PER_CENTRE * k)).select("e").toPandas()["e"]
    x = _unit(np.stack(sample.to_numpy()))
    books = tuple(in_blocks(learn_codebook(half, k)) for half in (x[:, : width // 2], x[:, width // 2 :]))
    visits = cells_for_recall(x, books, least, recall)
    across = len(books[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 2000):
                part = batch.iloc[k : k + 2000]
                e = np.stack(part["e"].to_numpy()).astype(kind)
                seen = multi_sequence(_unit(e), books, visits).astype(np.int64)
                yield pd.DataFrame({"id": part["id"], "copies": part["copies"], "e": [v.tobytes() for v in e], "seen": list(seen)})

    members = materialize(known.select("id", "copies", "e").mapInPandas(assign, "id long, copies long, e binary, seen array<long>"))
    group = lambda c: F.floor(F.floor(c / across) / SIDE) * (-(-across // SIDE)) + F.floor(F.pmod(c, F.lit(across)) / SIDE)
    members = members.withColumn("own", F.get("seen", F.lit(0)))
    probes = members.withColumn("group", F.explode(F.array_distinct(F.transform("seen", group))))
    probes = probes.select("group", "id", "copies", "e", "own", F.filter("seen", lambda c: group(c) == F.col("group")).alias("cells"))
    members = members.withColumn("group", group(F.col("own")))
    # One row for each group of cells, from the counts alone; Spark broadcasts it if it is small.
    load = materialize(
        members.groupBy("group").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("mb")).join(probes.groupBy("group").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("pb")), "group")
    )
    salt = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = members.join(load, "group").withColumn("m", salt("mb")).withColumn("p", each("pb")).drop("mb", "pb")
    right = probes.join(load, "group").withColumn("p", salt("pb")).withColumn("m", each("mb")).drop("mb", "pb")
    right = right.select(*(F.col(c).alias(f"q_{c}") for c in right.columns))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64")})
        left = left.sort_values(["own", "id"], ignore_index=True)
        ids, home, copies = (left[c].to_numpy() for c in ("id", "own", "copies"))
        m = _unit(np.frombuffer(b"".join(left["e"]), kind).reshape(len(left), width))
        seen = np.stack(left["seen"].to_numpy())
        others, own, weights = (right[f"q_{c}"].to_numpy() for c in ("id", "own", "copies"))
        q = _unit(np.frombuffer(b"".join(right["q_e"]), kind).reshape(len(right), width))
        counts_m, counts_p, forest = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64), Forest()
        cells = np.concatenate(right["q_cells"].to_numpy())
        who = np.repeat(np.arange(len(right)), right["q_cells"].map(len).to_numpy())
        order = np.argsort(cells, kind="stable")
        cells, who = cells[order], who[order]
        for cell in np.unique(home):
            low, high = np.searchsorted(home, (cell, cell + 1))
            asked = who[slice(*np.searchsorted(cells, (cell, cell + 1)))]
            for at in range(0, len(asked), 2000):
                part = asked[at : at + 2000]
                i, j = np.nonzero(q[part] @ m[low:high].T >= least)
                i, j = part[i], j + low
                ok = others[i] != ids[j]
                i, j = i[ok], j[ok]
                np.add.at(counts_p, i, copies[j])
                # The member's own probe finds the link too if it visits the other's cell.
                alone = ~(seen[j] == own[i][:, None]).any(axis=1)
                np.add.at(counts_m, j[alone], weights[i[alone]])
                forest.add(others[i], ids[j], np.zeros(len(i), np.int64))
        edges = forest.edges()
        some_m, some_p = counts_m > 0, counts_p > 0
        a = np.concatenate([ids[some_m], others[some_p], edges[:, 0]])
        b = pd.array(np.concatenate([np.zeros(some_m.sum() + some_p.sum(), np.int64), edges[:, 1]]), dtype="Int64")
        b[: some_m.sum() + some_p.sum()] = pd.NA
        return pd.DataFrame({"a": a, "b": b, "n": np.concatenate([counts_m[some_m], counts_p[some_p], np.zeros(len(edges), np.int64)])})

    return materialize(left.groupBy("group", "m", "p").cogroup(right.groupBy("q_group", "q_m", "q_p")).applyInPandas(compare, "a long, b long, n long"))
