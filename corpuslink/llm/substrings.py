"""Operator 3: removal of word sequences that occur more than once, found by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words that a task holds at once, and elements that a bucket of the index should hold.
CHUNK = 400_000
BUCKET = 2_000_000
#: Parts by the highest two bits of the hash in which a bucket is sorted, so that a task holds little besides its elements.
RANGES = 4
ROWS = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
DDL = "part int, blob binary"
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


# -- hashes of windows -------------------------------------------------------------------------------------------


class WordHashes(dict):
    """XXH64 of words, each computed once until the table is full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Rolling:
    """Hashes of all windows of `size` words: differences of prefix sums of a polynomial modulo 2**64, then mixed."""

    def __init__(self, size: int):
        self.size, self.up, self.down = size, [], []

    def of(self, words: np.ndarray, lane: int) -> np.ndarray:
        n = len(words)
        if not self.up or len(self.up[0]) < n:
            self.up = [_powers(m, 2 * n) for m in ODD]
            self.down = [_powers(np.uint64(pow(int(m), -1, 1 << 64)), 2 * n) for m in ODD]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_mix(words) if lane else words) * self.up[lane][:n], out=sums[1:])
        return _mix((sums[self.size :] - sums[: -self.size]) * self.down[lane][: n - self.size + 1])


# -- elements (hash, flag, document, position) and where they meet ------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers, place by place, so that rarely used places compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(blob: memoryview, at: int, n: int, kind) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    end = at + n * width
    return np.ascontiguousarray(np.frombuffer(blob[at:end], np.uint8).reshape(width, n).T).view(kind).ravel(), end


def _pack_places(keys: np.ndarray, at: np.ndarray) -> bytes:
    """Places in the order of documents: each document's key once, then its positions as differences."""
    new = np.r_[True, np.diff(keys) != 0]
    step = np.diff(at, prepend=0)
    step[new] = at[new]
    return b"".join((np.int64(new.sum()).tobytes(), _planes(keys[new]), np.packbits(new).tobytes(), _planes(step.astype(np.int32))))


def _unpack_places(blob: memoryview, at: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    docs = int(np.frombuffer(blob[at : at + 8], np.int64)[0])
    keys, at = _unplanes(blob, at + 8, docs, np.int64)
    new = np.unpackbits(np.frombuffer(blob[at : at + (n + 7) // 8], np.uint8), count=n).astype(bool)
    step, at = _unplanes(blob, at + (n + 7) // 8, n, np.int32)
    sums = np.cumsum(step.astype(np.int64))
    first = np.flatnonzero(new)
    offset = sums[first] - step[first]
    group = np.cumsum(new) - 1
    return keys[group], sums - offset[group], at


def _pack(h: tuple[np.ndarray, ...], widths: tuple[int, ...], flag: np.ndarray, keys: np.ndarray, at: np.ndarray) -> bytes:
    hashes = [np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for x, w in zip(h, widths)]
    return b"".join((np.int64(len(at)).tobytes(), *hashes, np.packbits(flag).tobytes(), _pack_places(keys, at)))


def _unpack(raw: bytes, widths: tuple[int, ...]):
    blob = memoryview(raw)
    n, at, h = int(np.frombuffer(blob[:8], np.int64)[0]), 8, []
    for w in widths:
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = np.frombuffer(blob[at : at + n * w], np.uint8).reshape(w, n).T
        h.append(full.view(">u8").ravel().astype(np.uint64))
        at += n * w
    flag = np.unpackbits(np.frombuffer(blob[at : at + (n + 7) // 8], np.uint8), count=n).astype(bool)
    keys, places, _ = _unpack_places(blob, at + (n + 7) // 8, n)
    return h, flag, keys, places


def _groups(h: list[np.ndarray] | tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order in which equal hashes stand side by side, number of the group of each in that order)."""
    order = np.argsort(h[0], kind="stable") if len(h) == 1 else np.lexsort(h[::-1])
    new = np.zeros(len(order), bool)
    for x in h:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    return order, np.cumsum(new)


def _hit_rows(keys: np.ndarray, at: np.ndarray, parts: int, shift: int) -> Iterator[tuple[int, bytes]]:
    """Places by the part that their documents go to."""
    part = (keys % parts).astype(np.int64)
    order = np.lexsort((at, keys, part))
    part, keys, at = part[order], keys[order], at[order]
    starts = np.r_[np.flatnonzero(np.r_[True, np.diff(part) != 0]), len(part)] if len(part) else [0]
    for a, b in zip(starts[:-1], starts[1:]):
        yield shift + int(part[a]), np.int64(b - a).tobytes() + _pack_places(keys[a:b], at[a:b])


def _send(h: tuple[np.ndarray, ...], flag: np.ndarray, keys: np.ndarray, at: np.ndarray, widths: tuple[int, ...], buckets: int) -> pa.RecordBatch:
    """A chunk's elements by bucket of their hash, each hash once; places of hashes that the chunk repeats as hits.

    Whatever a hash's frequency, a chunk sends one element of it, so that no bucket grows with a frequent passage.
    """
    order, group = _groups(h)
    size = np.bincount(group)
    first = np.r_[0, np.cumsum(size)[:-1]]
    chosen = order[first]
    any_flag = np.add.reduceat(flag[order].astype(np.int32), first) > 0
    again = order[np.repeat(size > 1, size)]
    rows = list(_hit_rows(keys[again], at[again], buckets, buckets)) if len(again) else []
    chosen_order = np.argsort(chosen)  # in the order of documents again
    chosen, any_flag = chosen[chosen_order], any_flag[chosen_order]
    bucket = ((h[0][chosen] & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)):
        own = by[ends[k] : ends[k + 1]]
        c = chosen[own]
        rows.append((int(k), _pack(tuple(x[c] for x in h), widths, any_flag[own], keys[c], at[c])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=ROWS)


class Chunk:
    """Elements on their way to their buckets."""

    def __init__(self, widths: tuple[int, ...], buckets: int):
        self.widths, self.buckets, self.held, self.n = widths, buckets, [], 0

    def add(self, key: int, h: tuple[np.ndarray, ...], flag: np.ndarray, at: np.ndarray) -> None:
        self.held.append((h, flag, np.full(len(at), key, np.int64), at))
        self.n += len(at)

    def full(self) -> bool:
        return self.n >= CHUNK

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            h = tuple(np.concatenate([x[0][k] for x in self.held]) for k in range(len(self.widths)))
            flag, keys, at = (np.concatenate([x[k] for x in self.held]) for k in (1, 2, 3))
            self.held, self.n = [], 0
            yield _send(h, flag, keys, at, self.widths, self.buckets)


def _meet(sent: DataFrame, widths: tuple[int, ...], buckets: int) -> DataFrame:
    """(part, blob) of places whose hash occurs elsewhere and somewhere with the flag; part names where documents go."""

    def run(table: pa.Table) -> pa.Table:
        parts, blobs = table.column(0).to_numpy(), table.column(1)
        if not len(parts) or parts[0] >= buckets:  # hits on their way
            return pa.table({"part": pa.array(parts - buckets, pa.int32()), "blob": blobs}, schema=ROWS)
        held: list[list] = [[] for _ in range(RANGES)]
        for b in blobs:
            h, flag, keys, at = _unpack(b.as_py(), widths)
            own, at = h[0] >> np.uint64(62), at.astype(np.int32)
            for k in range(RANGES):
                m = own == k
                held[k].append((*(x[m] for x in h), flag[m], keys[m], at[m]))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(RANGES):
            *h, flag, keys, at = map(np.concatenate, zip(*held[k]))
            held[k] = []
            order, group = _groups(h)
            size, flags = np.bincount(group), np.bincount(group, flag[order])
            hit = order[((size > 1) & (flags > 0))[group]]
            if len(hit):
                hits.append((keys[hit], at[hit]))
        # One row for each part of documents, not one for each range of hashes: their number is bounded by that of buckets and parts.
        keys, at = map(np.concatenate, zip(*hits)) if hits else (np.empty(0, np.int64), np.empty(0, np.int32))
        del held, hits
        rows = list(_hit_rows(keys, at.astype(np.int64), buckets, 0)) if len(keys) else []
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())}, schema=ROWS)

    return sent.groupBy("part").applyInArrow(run, DDL)


def _places(table: pa.Table) -> dict[int, np.ndarray]:
    """Positions by document."""
    all_ = []
    for b in table.column("blob"):
        blob = memoryview(b.as_py())
        all_.append(_unpack_places(blob, 8, int(np.frombuffer(blob[:8], np.int64)[0]))[:2])
    if not all_:
        return {}
    keys, at = (np.concatenate([x[k] for x in all_]) for k in (0, 1))
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    starts = np.flatnonzero(np.r_[True, np.diff(keys) != 0])
    return {int(keys[a]): np.unique(x) for a, x in zip(starts, np.split(at, starts[1:]))}


# -- the operator ------------------------------------------------------------------------------------------------


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with texts also the kept text, after the columns `keep`.

    A word is removed if a window of so many words that covers it also starts anywhere else in the corpus. Anchors: the
    aligned blocks of (window + 1) // 2 words, of which every window holds one, are the index, and every rolling block of
    that size probes it. A hit is extended to all windows around it, and a window is repeated if its whole sequence (by
    80 bits and more of its hash) occurs again; runs of repeated windows are the maximal exact repeats. Windows are
    judged on the input. A null text has no words; repeated rows repeat each other; rows with equal key and text share
    their places; a text without repeats is kept as it is, from others the kept words are joined by spaces. Only key,
    text and `keep` are read. An empty table gives no rows. Texts of any length are cut into slices that overlap.
    """
    block = (window + 1) // 2
    src = docs.select(
        F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *[F.col(c).alias(f"k_{c}") for c in keep]
    ).withColumn("_key", F.xxhash64("_id", "_text"))
    src = src.withColumn("_text", F.col("_text").cast("binary"))
    spark = docs.sparkSession
    total = src.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (6 * BUCKET) + 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rolling = Chunk((5,), buckets), Rolling(block)
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = raw.as_py().split()
                if len(words) < window:
                    continue
                for k in range(0, len(words) - block + 1, CHUNK):
                    h = rolling.of(_HASHES.of(words[k : k + CHUNK + block - 1]), 0)
                    at = np.arange(k, k + len(h), dtype=np.int64)
                    chunk.add(doc, (h,), at % block == 0, at)
                    if chunk.full():
                        yield from chunk.rows()
        yield from chunk.rows()

    hits = materialize(_meet(src.select("_key", "_text").mapInArrow(anchors, DDL), (5,), buckets))

    fields = [f for f in src.schema.fields if f.name.startswith("k_")]
    seen = "_id long, _key long, _text binary, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fields) + "n_words long, kept_sha256 string, _starts binary"

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _places(right)
        n, digests, starts, bodies = [], [], [], []
        for doc, raw in zip(left.column("_key").to_pylist(), left.column("_text")):
            body = raw.as_py()
            words = body.split()
            n.append(len(words))
            near = np.empty(0, np.int64)
            if doc in found and len(words) >= window:
                near = np.flatnonzero(_covered(np.maximum(found[doc] - (window - block), 0), window - block + 1, len(words)))
                near = near[near <= len(words) - window]
            digests.append(None if len(near) else hashlib.sha256(b" ".join(words)).hexdigest())
            starts.append(near.astype(np.int32).tobytes() if len(near) else None)
            bodies.append(body if len(near) or texts else None)
        out = left.drop_columns(["_part", "_text"])
        out = out.append_column("n_words", pa.array(n, pa.int64())).append_column("kept_sha256", pa.array(digests, pa.string()))
        out = out.append_column("_starts", pa.array(starts, pa.binary())).append_column("_text", pa.array(bodies, pa.binary()))
        return out.select(names)

    names = [x.split()[0] for x in ("_id _", "_key _", "_text _")] + [f.name for f in fields] + ["n_words", "kept_sha256", "_starts"]
    parts = F.pmod("_key", F.lit(buckets)).cast("int").alias("_part")
    first = materialize(
        src.select("*", parts).groupBy("_part").cogroup(hits.groupBy(F.col("part").alias("_part"))).applyInArrow(candidates, seen)
    )
    open_ = first.where("_starts is not null")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rolling = Chunk((8, 2), buckets), Rolling(window)
        for batch in batches:
            for doc, raw, near in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words, starts = raw.as_py().split(), np.frombuffer(near.as_py(), np.int32).astype(np.int64)
                for k in range(0, len(words) - window + 1, CHUNK):
                    own = starts[(starts >= k) & (starts < k + CHUNK)]
                    if len(own):
                        w = _HASHES.of(words[k : k + CHUNK + window - 1])
                        chunk.add(doc, (rolling.of(w, 0)[own - k], rolling.of(w, 1)[own - k]), np.ones(len(own), bool), own)
                    if chunk.full():
                        yield from chunk.rows()
        yield from chunk.rows()

    repeats = materialize(_meet(open_.select("_key", "_text", "_starts").mapInArrow(windows, DDL), (8, 2), buckets))
    columns = ["doc_id", *(f.name for f in fields), "n_words", "n_removed", "kept_sha256", "_kept"]
    done = "doc_id long, " + "".join(f"{f.name} {f.dataType.simpleString()}, " for f in fields) + "n_words long, n_removed long, kept_sha256 string, _kept binary"

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _places(right)
        gone, digests, bodies = [], [], []
        for doc, raw in zip(left.column("_key").to_pylist(), left.column("_text")):
            body = raw.as_py()
            words = body.split()
            if doc in found:
                cover = _covered(found[doc], window, len(words))
                words = [w for w, c in zip(words, cover.tolist()) if not c]
                body = b" ".join(words)
                gone.append(int(cover.sum()))
            else:
                gone.append(0)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            bodies.append(body if texts else None)
        out = left.rename_columns([{"_id": "doc_id"}.get(c, c) for c in left.column_names]).drop_columns(["kept_sha256", "_part"])
        out = out.append_column("n_removed", pa.array(gone, pa.int64())).append_column("kept_sha256", pa.array(digests, pa.string()))
        return out.append_column("_kept", pa.array(bodies, pa.binary())).select(columns)

    cut = open_.select("*", parts).groupBy("_part").cogroup(repeats.groupBy(F.col("part").alias("_part"))).applyInArrow(removed, done)
    whole = first.where("_starts is null").select(
        F.col("_id").alias("doc_id"), *[f.name for f in fields], "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.col("_text").alias("_kept")
    )
    both = whole.unionByName(cut)
    if not texts:
        return both.select("doc_id", "n_words", "n_removed", "kept_sha256")
    return both.select(
        "doc_id", *[F.col(f.name).alias(f.name[2:]) for f in fields], "n_words", "n_removed", "kept_sha256", F.col("_kept").cast("string").alias("kept_text")
    )
