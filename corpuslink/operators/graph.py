"""The entity graph: mentions, weighted edges, communities and the chunks that stand for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import connected_components, materialize, numbered
from .vectors import dense_topk

NAME = r"\b[A-Z][a-z]{3,}"


def entity_key(by: str = "canonical") -> Column:
    """`canonical`: one entity per (name, type); `mention`: each extracted mention is its own."""
    return F.concat_ws("|", "canonical_name", "entity_type") if by == "canonical" else F.col("entity_id").cast("string")


def extract_mentions(chunks: DataFrame, entities: Column | None = None) -> DataFrame:
    """chunk_id, source_id, entity_id, canonical_name, entity_type and confidence of what a chunk mentions.

    entities: a column of [{name, type}], such as parsed answers; the default takes capitalised words as names.
    """
    found = entities if entities is not None else F.transform(F.regexp_extract_all("content", F.lit(NAME), 0), lambda x: F.struct(x.alias("name"), F.lit("name").alias("type")))
    rows = chunks.select("chunk_id", "source_id", F.posexplode(found).alias("pos", "e"))
    return rows.select(
        "chunk_id", "source_id", F.sha2(F.concat_ws("|", "chunk_id", "pos"), 256).alias("entity_id"),
        F.col("e.name").alias("canonical_name"), F.col("e.type").alias("entity_type"), F.lit(1.0).alias("confidence"),
    )


def relation_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst, type, confidence and chunk_id where both names of a relation are entities of its chunk; the last id wins."""
    last = entities.groupBy("chunk_id", "name").agg(F.max("entity_id").alias("id"))
    one, two = (last.select("chunk_id", F.col("name").alias(n), F.col("id").alias(i)) for n, i in (("source", "src"), ("target", "dst")))
    return relations.join(one, ["chunk_id", "source"]).join(two, ["chunk_id", "target"]).select("src", "dst", "type", "confidence", "chunk_id")


def scope_graph(mentions: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: entity, n_chunks, n_sources of the scope; sources of the scope without any mention)."""
    inside = mentions.join(scope, "source_id", "left_semi")
    nodes = inside.groupBy("entity").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("source_id").alias("n_sources"))
    return nodes, scope.join(inside.select("source_id").distinct(), "source_id", "left_anti")


#: Entities of a chunk of which a task makes all pairs.
CROWD = 500


def _pairs_within(m: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """All rows of a key with all others of it, as (key, a, b and both sides' columns), a < b.

    A key's rows are one list, of which all pairs are made where it lies. The rows of a crowded key are dealt to parts of about CROWD by
    hash, and each pair of parts is a key of its own for the join, so that no task has all pairs of one key and each pair is met once.
    """
    counted = m.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    few = counted.where(F.col("_n") <= CROWD).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("entity", *columns))).alias("_all"))
    few = few.select(key, F.posexplode("_all").alias("_pos", "_a"), "_all").select(key, "_a", F.explode(F.slice("_all", F.col("_pos") + 2, F.size("_all"))).alias("_b"))
    both = [F.col(f"_{e}.{c}").alias(f"{c}_{e}") for e in "ab" for c in columns]
    few = few.select(key, F.col("_a.entity").alias("a"), F.col("_b.entity").alias("b"), *both)
    dealt = counted.where(F.col("_n") > CROWD).withColumn("_parts", F.ceil(F.col("_n") / CROWD).cast("int"))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("entity"), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    side = lambda e, own, other: dealt.withColumn("_other", every).select(
        key, F.col("_own").alias(own), F.col("_other").alias(other), F.col("entity").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in columns)
    )
    crowded = side("a", "_i", "_j").join(side("b", "_j", "_i"), [key, "_i", "_j"]).drop("_i", "_j")
    return few.unionByName(crowded).where("a < b")


def cooccurrence_edges(mentions: DataFrame, max_entities: int | None = None) -> DataFrame:
    """a < b and weight: per shared chunk 1 / sqrt(degree a * degree b), half as much again if a and b share no source.

    The degree is the number of chunks. With max_entities, chunks with more are left out; without, none are, and the pairs
    of a crowded chunk are made by several tasks.
    """
    several = mentions.groupBy("chunk_id").agg((F.min("source_id") < F.max("source_id")).alias("x"), F.count_if(F.col("source_id").isNull()).alias("none"))
    several = bool(several.where("x or none > 0").take(1))  # where all entities of a chunk share its source, no pair has to be asked for its sources
    m = mentions.select("chunk_id", "source_id", "entity").repartition("chunk_id").distinct()
    # One row for each entity of a chunk, so that a pair is met once in a chunk; degrees go along with the entities, not with the pairs.
    met = m.groupBy("chunk_id", "entity").agg(F.collect_set("source_id").alias("sources")) if several else m.select("chunk_id", "entity").distinct()
    met = met.withColumn("degree", F.count("*").over(Window.partitionBy("entity")))
    if max_entities is not None:
        small = met.groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_entities)
        met = met.join(small, "chunk_id", "left_semi")
        m = m.join(small, "chunk_id", "left_semi")
    met = _pairs_within(met, "chunk_id", ("sources", "degree") if several else ("degree",))
    same = F.arrays_overlap("sources_a", "sources_b") if several else F.lit(True)
    pairs = met.select("a", "b", same.alias("same"), "degree_a", "degree_b").groupBy("a", "b")
    pairs = pairs.agg(F.count("*").alias("n"), F.max("same").alias("same"), F.max("degree_a").alias("da"), F.max("degree_b").alias("db"))
    once = F.col("n") / F.sqrt(F.col("da") * F.col("db"))
    if not several:
        return pairs.select("a", "b", once.alias("weight"))
    # Entities of one chunk nearly always share its source; only for the others are all their sources compared.
    apart = pairs.where("not same").select("a", "b")
    own = m.select("entity", "source_id").distinct()
    shared = apart.join(own.withColumnRenamed("entity", "a"), "a").join(own.withColumnRenamed("entity", "b"), ["b", "source_id"]).select("a", "b", F.lit(True).alias("also")).distinct()
    bonus = F.when(F.col("same") | F.coalesce("also", F.lit(False)), 1.0).otherwise(1.5)
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", (once * bonus).alias("weight"))


def met_in_chunks(mentions: DataFrame) -> DataFrame:
    """a < b that some chunk mentions both, once for each chunk: the pairs of `cooccurrence_edges` where their weights aren't asked for."""
    return _pairs_within(mentions.select("chunk_id", "entity").repartition("chunk_id").distinct(), "chunk_id", ()).select("a", "b")


#: Sources of an entity from which its pairs are dealt to several groups.
MANY = 10_000


def same_source_edges(mentions: DataFrame, known: DataFrame, weight: float = 0.1, most: int = 60) -> DataFrame:
    """Pairs of one source with at most `most` entities that aren't among the known ones (a, b).

    An entity leaves a source once, with the list of those after it, and meets the lists of its other sources and what is known
    of it in one shuffle. Entities of more than MANY sources, at most one in MANY mentions, are broadcast, and their pairs are dealt to
    several groups.
    """
    own = mentions.select("source_id", "entity").repartition("source_id").distinct()
    few = own.withColumn("n", F.count("*").over(Window.partitionBy("source_id"))).where(F.col("n") <= most)
    few = few.groupBy("source_id").agg(F.sort_array(F.collect_list("entity")).alias("all"))
    later = few.select(F.posexplode("all").alias("pos", "a"), "all").select("a", F.slice("all", F.col("pos") + 2, F.size("all")).alias("b")).where(F.size("b") > 0)
    many = F.broadcast(own.groupBy(F.col("entity").alias("a")).agg(F.ceil(F.count("*") / MANY).cast("int").alias("parts")).where("parts > 1"))
    dealt = lambda x: F.pmod(F.xxhash64(x), F.col("parts")).cast("int")
    whole, apart = F.array(F.struct(F.lit(0).alias("part"), F.col("b").alias("b"))), F.transform("b", lambda x: F.struct(dealt(x).alias("part"), F.array(x).alias("b")))
    later = later.join(many, "a", "left").select("a", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(apart)).alias("x"))
    later = later.select("a", "x.part", "x.b", F.lit(None).cast("long").alias("known"))
    known = known.join(many, "a", "left").select("a", F.coalesce(dealt("b"), F.lit(0)).alias("part"), F.lit(None).cast("array<long>").alias("b"), F.col("b").alias("known"))
    rows = later.unionByName(known).repartition("a", "part").sortWithinPartitions("a", "part")
    return rows.mapInArrow(_new_pairs, "a long, b long").withColumn("weight", F.lit(weight))


def _new_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each a and b of the lists (a, part, b) once, without those that are known (a, part, known). Rows come by a and part; the last group of a batch waits."""
    def pairs(t: pa.Table) -> pa.RecordBatch:
        lists = pc.fill_null(pc.list_value_length(t["b"]), 1).to_numpy()
        seen = t["b"].is_null().to_numpy()
        b = np.empty(lists.sum(), np.int64)
        at, old = np.repeat(np.arange(len(lists)), lists), np.repeat(seen, lists)
        b[~old], b[old] = t["b"].combine_chunks().flatten().to_numpy(), t["known"].drop_null().to_numpy()
        a = t["a"].to_numpy()
        group = np.cumsum(np.r_[False, a[1:] != a[:-1]])[at] if len(a) else at
        names, place = np.unique(b, return_inverse=True)
        # Of equal pairs a known one comes first.
        key = np.sort((group * len(names) + place) * 2 + ~old)
        first = key[_starts(key >> 1)]
        first = first[first % 2 == 1] >> 1
        return pa.record_batch({"a": a[np.flatnonzero(np.r_[True, a[1:] != a[:-1]])][first // len(names)], "b": names[first % len(names)]})

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        a, part = t["a"].to_numpy(), t["part"].to_numpy()
        last = np.flatnonzero((a != a[-1]) | (part != part[-1])) if len(a) else []
        n = int(last[-1]) + 1 if len(last) else 0
        held = t.slice(n)
        if n:
            yield pairs(t.slice(0, n))
    if held is not None and held.num_rows:
        yield pairs(held)


def semantic_edges(entities: DataFrame, mentions: DataFrame, least: float = 0.85, k: int = 10, max_queries: int | None = None) -> DataFrame:
    """a < b and half the cosine of entities (entity, vector): the k nearest of all, then those from `least` on without a shared source.

    All ask, and all are candidates. With max_queries only so many of the most mentioned ask.
    """
    asking = entities.where("vector is not null")
    if max_queries is not None:
        n = mentions.groupBy("entity").agg(F.countDistinct("chunk_id").alias("n"))
        asking = asking.join(n, "entity", "left").orderBy(F.desc(F.coalesce("n", F.lit(0))), "entity").limit(max_queries)
    near = dense_topk(asking.select(F.col("entity").alias("query_id"), "vector"), entities.select(F.col("entity").alias("id"), "vector"), k, others=True)
    near = near.where(F.col("score") >= least).select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "score")
    pairs = near.groupBy("a", "b").agg((F.max("score") * 0.5).alias("weight"))
    own = mentions.select("entity", "source_id").distinct()
    shared = pairs.join(own.withColumnRenamed("entity", "a"), "a").join(own.withColumnRenamed("entity", "b"), ["b", "source_id"]).select("a", "b")
    return pairs.join(shared, ["a", "b"], "left_anti")


def combine_edges(*kinds: DataFrame) -> DataFrame:
    """The union of edges; where several kinds have an edge, the first kind's weight stands."""
    rows = None
    for prio, e in enumerate(kinds):
        e = e.select("a", "b", "weight", F.lit(prio).alias("prio"))
        rows = e if rows is None else rows.unionByName(e)
    return rows.groupBy("a", "b").agg(F.min_by("weight", "prio").alias("weight"))


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """`combine_edges` of two kinds that have each edge once: they are joined where the first lies by its edges already, not shuffled again."""
    both = first.join(second.withColumnRenamed("weight", "_other"), ["a", "b"], "full")
    return both.select("a", "b", F.coalesce("weight", "_other").alias("weight"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of (entity, community) over the edges (a, b, weight)."""
    m = membership.select("entity", "community")
    e = edges.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("w"))
    ends = e.select(F.col("ca").alias("c"), "weight").union(e.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    total = e.agg(F.sum("weight").alias("m"))
    part = F.coalesce("w", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("k") / (2 * F.col("m")), 2)
    return ends.join(inside, "c", "left").crossJoin(F.broadcast(total)).agg(F.sum(part).alias("modularity"))


#: Edges, counted both ways, of the vertices that a task of `Neighbours` holds at once.
CELL_EDGES = 2_000_000


class Neighbours:
    """A graph (a, b, w, each edge both ways) whose vertices are dealt to cells: ranges of ids with about CELL_EDGES edges each.

    `cells` has one row for each cell with all its edges in arrays. It stays on the disks of the executors until `done`, so that edges are
    shuffled when it is made, and in no round. `rows` has one row for each vertex: a, its cell, its strength k and the cells `to` where
    it has neighbours, its own one included. What the vertices are to know of each other (`state`: v and more columns) is sent once to
    each of these, in arrays, not along each edge.
    """

    def __init__(self, e: DataFrame):
        n = max(1, -(-e.count() // CELL_EDGES))
        # Names of cells that the shuffle deals to one partition each.
        number = F.col("id").cast("int")
        dealt = dict(tuple(r)[::-1] for r in e.sparkSession.range(32 * n).select(number, F.pmod(F.hash(number), F.lit(n))).collect())
        labels = [dealt.get(i, 32 * n + i) for i in range(n)]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]))
            if not t.num_rows:
                return
            a, b, w = (t[name].to_numpy() for name in ("a", "b", "w"))
            own, degree = np.unique(a, return_counts=True)
            v = np.union1d(own, b)
            ib = np.searchsorted(v, b)
            order, key = _ordered(np.searchsorted(own, a) * len(v) + ib, len(own) * len(v))
            if (key[1:] == key[:-1]).any():  # an edge that comes again: by weight, in whatever order they come
                order = np.lexsort((w, b, a))
            found = {"own": own, "degree": degree, "v": v, "ib": ib[order].astype(np.int32), "w": w[order]}
            yield pa.record_batch({"cell": pa.array([labels[TaskContext.get().partitionId()]], pa.int32()), "least": [int(own[0])], **{k: pa.array([x.tobytes()], pa.binary()) for k, x in found.items()}})

        packed = e.select("a", "b", "w").repartitionByRange(n, "a").mapInArrow(pack, "cell int, least long, own binary, degree binary, v binary, ib binary, w binary")
        self.cells = packed.repartition(n, "cell").sortWithinPartitions("cell").persist(StorageLevel.DISK_ONLY)
        leasts = np.array(sorted(tuple(r) for r in self.cells.select("least", "cell").collect()), np.int64).reshape(-1, 2)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    own, degree, v = (np.frombuffer(r[name], np.int64) for name in ("own", "degree", "v"))
                    ia, ib, w = np.repeat(np.arange(len(own)), degree), np.frombuffer(r["ib"], np.int32), np.frombuffer(r["w"])
                    near = np.searchsorted(leasts[:, 0], v, "right") - 1
                    here = np.searchsorted(leasts[:, 0], own, "right") - 1
                    to = np.unique(np.r_[ia * len(leasts) + near[ib], np.arange(len(own)) * len(leasts) + here])
                    at = np.r_[_starts(to // len(leasts)), len(to)].astype(np.int32)
                    lists = pa.ListArray.from_arrays(at, leasts[to % len(leasts), 1].astype(np.int32))
                    yield pa.record_batch({"a": own, "cell": np.full(len(own), r["cell"], np.int32), "k": np.bincount(ia, w, len(own)).astype(float), "to": lists})

        self.rows = materialize(self.cells.select("cell", "own", "degree", "v", "ib", "w").mapInArrow(spread, "a long, cell int, k double, to array<int>"))

    def done(self) -> None:
        self.cells.unpersist()

    def each(self, state: DataFrame, work: Callable[..., dict], schema: str) -> DataFrame:
        """What `work` makes of each cell.

        It is given the state of the cell's vertices and their neighbours (column -> values, in the order of v), the places in it
        of both ends of each edge and the weights, and the places of the cell's own vertices. Edges come by a and b.
        """
        names, kinds = state.columns, {f.name: {"bigint": np.int64, "double": np.float64, "boolean": np.bool_}[f.dataType.simpleString()] for f in state.schema}

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = batch["to"].flatten().to_numpy()
                of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["to"]).to_numpy())
                order = np.argsort(cell, kind="stable")
                first = _starts(cell[order])
                groups = np.split(of[order], first[1:])
                columns = {name: batch[name].to_numpy(zero_copy_only=False).astype(kinds[name], copy=False) for name in names}
                yield pa.record_batch({"cell": cell[order][first], **{name: pa.array([x[g].tobytes() for g in groups], pa.binary()) for name, x in columns.items()}})

        def run(edges: pa.Table, known: pa.Table) -> pa.Table:
            at = {name: np.concatenate([np.frombuffer(x.as_buffer(), kinds[name]) for x in known[name]]) for name in names}
            order = np.argsort(at["v"])
            at = {name: x[order] for name, x in at.items()}
            own, degree, ib, w = (np.frombuffer(edges[name][0].as_buffer(), kind) for name, kind in (("own", np.int64), ("degree", np.int64), ("ib", np.int32), ("w", np.float64)))
            own = np.searchsorted(at["v"], own)
            return pa.table(work(at, np.repeat(own, degree), ib, w, own))

        sent = self.rows.select(F.col("a").alias("v"), "to").join(state, "v").mapInArrow(pack, "cell int, " + ", ".join(f"{name} binary" for name in names))
        return self.cells.select("cell", "own", "degree", "ib", "w").groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, schema)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _ordered(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that order keys from 0 to below `top`, equal ones as they come, and the keys in that order."""
    bits = len(key).bit_length()
    if top.bit_length() + bits < 63:  # sorting values is faster than sorting places
        both = np.sort((key << bits) | np.arange(len(key)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _chosen(at: dict, ia: np.ndarray, ib: np.ndarray, w: np.ndarray, total: float, resolution: float) -> tuple[np.ndarray, ...]:
    """i, to, g and now: the neighbouring community of greatest gain of each vertex, and the gain of its own one, nan without neighbours there.

    at: c, k, and tot, the weight of c as a whole. ia ascends. Of equal gains the smallest community is taken.
    """
    if not len(ia):
        return ia, ia, w, w
    c, place = np.unique(at["c"], return_inverse=True)
    row = np.cumsum(np.r_[False, ia[1:] != ia[:-1]])
    order, key = _ordered(row * len(c) + place[ib], (int(row[-1]) + 1) * len(c))
    at_run = _starts(key)
    w, i, b = np.add.reduceat(w[order], at_run), ia[order][at_run], ib[order][at_run]
    to, k = at["c"][b], at["k"][i]
    mine = to == at["c"][i]
    gain = np.round(w - resolution * k * (at["tot"][b] - np.where(mine, k, 0.0)) / total, 10)
    first = _starts(i)
    best = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == np.repeat(best, np.diff(np.r_[first, len(i)])))
    now = np.maximum.reduceat(np.where(mine, gain, -np.inf), first)
    return i[first], to[hit[np.searchsorted(hit, first)]], best, np.where(np.isinf(now), np.nan, now)


def _move(e: Neighbours, at: DataFrame, total: float, resolution: float, rounds: int) -> tuple[DataFrame, bool]:
    """(at after local moving, whether any vertex moved). at: v, c, k.

    In each round a hashed half of the vertices moves to the neighbouring community of greatest gain, if that beats staying.
    """
    def work(at: dict, ia: np.ndarray, ib: np.ndarray, w: np.ndarray, own: np.ndarray) -> dict:
        other = ia != ib
        i, to, g, now = _chosen(at, ia[other], ib[other], w[other], total, resolution)
        stay = np.where(np.isnan(now), -resolution * at["k"][i] * (at["tot"][i] - at["k"][i]) / total, now)
        c = at["c"].copy()
        go = at["turn"][i] & (to != c[i]) & (g > stay + 1e-9)
        c[i[go]] = to[go]
        return {"v": at["v"][own], "c": c[own], "k": at["k"][own], "moved": (c != at["c"])[own]}

    any_, last, size = False, 0, None
    for r in range(rounds):
        totals = at.groupBy("c").agg(F.sum("k").alias("tot"))
        state = at.join(totals, "c").select("v", "c", "k", "tot", (F.pmod(F.xxhash64("v", F.lit(r)), F.lit(2)) == 0).alias("turn"))
        at = materialize(e.each(state, work, "v long, c long, k double, moved boolean"))
        size, n = at.agg(F.count("*"), F.count_if("moved")).first()
        any_ |= n > 0
        at = at.drop("moved")
        if r % 2 and n + last <= size / 500:  # both halves have had their turn, and hardly any moved
            break
        last = n
    return at, any_


def _refine(e: DataFrame | Neighbours, at: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """v, c, k and p: each community p of `at` (v, c, k) in parts c that are connected inside it.

    All begin alone. A vertex that is alone and well connected to the rest of its community joins the part of it with the
    greatest gain, if that part is well connected too: its weight to the rest is at least what the weights of both ends
    let expect. Whoever joins has an edge into the part, and a vertex alone is only joined while it can't move itself, so
    that a part is always connected (Traag, Waltman and van Eck, 2019).
    """
    e = e if isinstance(e, Neighbours) else Neighbours(e)

    def outer(at: dict, ia: np.ndarray, ib: np.ndarray, w: np.ndarray, own: np.ndarray) -> dict:
        out = (at["p"][ia] == at["p"][ib]) & (at["c"][ia] != at["c"][ib])
        return {"v": at["v"][own], "outer": np.bincount(ia[out], w[out], len(at["v"])).astype(float)[own]}

    def join(at: dict, ia: np.ndarray, ib: np.ndarray, w: np.ndarray, own: np.ndarray) -> dict:
        out = at["asks"][ia] & at["open"][ib] & (at["p"][ia] == at["p"][ib]) & (at["c"][ia] != at["c"][ib])
        i, to, g, _ = _chosen(at, ia[out], ib[out], w[out], total, resolution)
        c = at["c"].copy()
        c[i[g > 1e-9]] = to[g > 1e-9]
        return {"v": at["v"][own], "c": c[own]}

    whole = at.groupBy(F.col("c").alias("p")).agg(F.sum("k").alias("all"))
    tied = lambda w, k: w >= resolution * k * (F.col("all") - k) / total - 1e-12
    now = materialize(at.select("v", F.col("v").alias("c"), "k", F.col("c").alias("p")).join(whole, "p"))
    for r in range(rounds):
        turn = F.pmod(F.xxhash64("c", F.lit(r)), F.lit(2)) == 0
        own = materialize(e.each(now.select("v", "c", "p"), outer, "v long, outer double"))
        now = now.join(own, "v")
        if r == 0:
            now = now.withColumn("tied", tied(F.col("outer"), F.col("k")))
        parts = now.groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("n"), F.max("all").alias("all"), F.sum("outer").alias("outer"))
        parts = parts.select("c", "tot", (tied(F.col("outer"), F.col("tot")) & ((F.col("n") > 1) | ~turn)).alias("open"), ((F.col("n") == 1) & turn).alias("asks"))
        state = materialize(now.drop("outer").join(parts, "c").withColumn("asks", F.col("asks") & F.col("tied")))
        joined = e.each(state.select("v", "c", "k", "p", "tot", "open", "asks"), join, "v long, c long")
        now = materialize(state.select("v", "k", "p", "all", "tied").join(joined, "v"))
    return now.select("v", "c", "k", "p")


def _contracted(e: Neighbours, to: DataFrame) -> DataFrame:
    """a, b and w, both ways, of the graph whose vertices are the communities of (v, c)."""
    def work(at: dict, ia: np.ndarray, ib: np.ndarray, w: np.ndarray, own: np.ndarray) -> dict:
        c, place = np.unique(at["c"], return_inverse=True)
        order, key = _ordered(place[ia] * len(c) + place[ib], len(c) ** 2)
        first = _starts(key)
        w = np.add.reduceat(w[order], first) if len(first) else w
        key = key[first]
        return {"a": c[key // len(c)], "b": c[key % len(c)], "w": w}

    return materialize(e.each(to.select("v", "c"), work, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w")))


def communities(edges: DataFrame, min_size: int = 3, resolution: float = 1.0, rounds: int = 6, levels: int = 3, refining: int = 3) -> DataFrame:
    """(entity, community) of communities with at least min_size members, by modularity.

    Each level moves vertices to neighbouring communities (`_move`) and contracts these. Then all communities are refined into
    well-connected parts (`_refine`) of the original graph, and the parts move from the communities that they are in, so that
    what the levels have put together wrongly comes apart again; that is kept if it raises the modularity. At last each
    community is split into its connected parts. State stays distributed; the driver sees totals and a number of
    moves per round. ids are longs; the result doesn't depend on partitions.

    Parts are connected and lie inside one community, before and after, so that the modularity of both and what is connected are
    found on the graph of the parts.
    """
    once = materialize(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("w")))
    total = once.agg(F.sum("w")).first()[0]
    if not total:
        return edges.select(F.col("a").alias("entity"), F.col("a").alias("community")).limit(0)
    total *= 2
    whole = e = Neighbours(once.union(once.select("b", "a", "w")))
    strength = whole.rows.select(F.col("a").alias("v"), "k")
    owner = strength.select(F.col("v").alias("entity"), F.col("v").alias("community"))
    for level in range(levels):
        at, moved = _move(e, e.rows.select(F.col("a").alias("v"), F.col("a").alias("c"), "k"), total, resolution, rounds)
        if not moved:
            break
        owner = materialize(owner.join(at.select(F.col("v").alias("community"), "c"), "community").select("entity", F.col("c").alias("community")))
        if level < levels - 1:
            above = _contracted(e, at)
            if e is not whole:
                e.done()
            e = Neighbours(above)
    if e is not whole:
        e.done()
    parts = strength.join(owner.toDF("v", "p"), "v").select("v", F.col("v").alias("c"), "k", "p")
    if refining:
        parts = materialize(_refine(whole, parts.select("v", F.col("p").alias("c"), "k"), total, resolution, refining))
    among = _contracted(whole, parts)
    whole.done()
    held = parts.groupBy("c").agg(F.min("p").alias("p"), F.sum("k").alias("k"), F.min("v").alias("least"), F.count("*").alias("n"))
    of = held = materialize(held)
    if refining:
        e = Neighbours(among)
        at, moved = _move(e, held.select(F.col("c").alias("v"), F.col("p").alias("c"), "k"), total, resolution, rounds)
        e.done()
        again = held.drop("p").join(at.select(F.col("v").alias("c"), F.col("c").alias("p")), "c")
        half = among.select("a", "b", (F.col("w") / 2).alias("weight"))
        quality = lambda m: modularity(half, m.select(F.col("c").alias("entity"), F.col("p").alias("community")), resolution).first()[0]
        if moved and quality(again) > quality(held):
            of = materialize(again)
    named = of.select("c", "p")
    inside = among.where("a <> b").join(named.toDF("a", "pa"), "a").join(named.toDF("b", "pb"), "b").where("pa = pb").select("a", "b")
    split = of.join(connected_components(inside).toDF("c", "_to"), "c", "left").withColumn("_to", F.coalesce("_to", "c"))
    large = split.groupBy("_to").agg(F.min("least").alias("community"), F.sum("n").alias("size")).where(F.col("size") >= max(min_size, 2))
    return parts.select(F.col("v").alias("entity"), "c").join(split.join(large, "_to").select("c", "community"), "c").select("entity", "community")


def score_chunks(mentions: DataFrame, membership: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """community, chunk_id, source_id, overlap and score = overlap**2 / size, from the cutoff on."""
    size = membership.groupBy("community").agg(F.count("*").alias("size"))
    rows = mentions.select("chunk_id", "source_id", "entity").distinct().join(membership.select("entity", "community").distinct(), "entity")
    n = rows.groupBy("community", "chunk_id", "source_id").agg(F.count("*").alias("overlap")).join(size, "community")
    return n.withColumn("score", F.col("overlap") * F.col("overlap") / F.col("size")).where(F.col("score") >= cutoff).drop("size")


def pick_chunks(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k chunks of each community in turns over its sources, sources ordered by their best score.

    A source's chunks beyond its first k can't be among them, and leave before anything is ordered by community.
    """
    own = Window.partitionBy("community", "source_id").orderBy(F.desc("score"), "chunk_id")
    s = scored.withColumn("round", F.row_number().over(own)).where(F.col("round") <= k).withColumn("best", F.max("score").over(Window.partitionBy("community", "source_id")))
    turn = Window.partitionBy("community").orderBy("round", F.desc("best"), "source_id")
    return s.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select("community", "chunk_id", "source_id", "score", "rank")


def community_report(membership: DataFrame, mentions: DataFrame) -> DataFrame:
    """community, size, its entities, its sources, whether there are several, and its place: across sources first, then by size.

    The lists are those of one community, once each; only community and size are ordered over all communities.
    """
    own = membership.join(mentions.select("entity", "source_id").distinct(), "entity")
    r = materialize(own.groupBy("community").agg(F.sort_array(F.collect_set("entity")).alias("entities"), F.sort_array(F.collect_set("source_id")).alias("sources")))
    sizes = r.select("community", F.size("entities").cast("long").alias("size"), (F.size("sources") > 1).alias("is_cross_source"))
    placed = numbered(sizes, F.desc("is_cross_source"), F.desc("size"), F.col("community"))
    return r.join(placed, "community").select("community", "size", "entities", "sources", "is_cross_source", F.col("place").cast("int").alias("place"))


def resolve_scope(results: DataFrame, mode: str = "ids", corpus: DataFrame | None = None) -> DataFrame:
    """query_id and source_id, each source once, at the place where it first occurs.

    results: query_id, source_id, rank where the sources are named (`ids`); query_id, id, rank of the chunks that hybrid_search
    (`search`) or the reranked first stage (`retrieve`) found, whose sources are those of the corpus (id, source_id).
    """
    if mode not in ("ids", "search", "retrieve"):
        raise ValueError(f"no way to find a scope: {mode}")
    if mode != "ids":
        results = results.join(corpus.select("id", "source_id"), "id")
    first = results.groupBy("query_id", "source_id").agg(F.min("rank").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "source_id"))).drop("first")
