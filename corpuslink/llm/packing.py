"""Operator 1: best-two-fit packing of documents into token sequences."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize

END = (2).to_bytes(4, "little")
#: Pieces of one length are numbered lane by lane, so that a length that a third of all pieces have is no single task.
LANES = 1024
SLICE = 1 << 20
#: Characters of Latin-1 that two modules for patterns put into different classes.
ODD = b"\x1c\x1d\x1e\x1f\xb2\xb3\xb9\xbc\xbd\xbe"


class Known(dict):
    """Token ids of separate strings, each encoded once by the tokenizers library until the table is full."""

    def __init__(self, tokenizer, room: int):
        self.tokenizer, self.room = tokenizer, room

    def __missing__(self, piece: str) -> bytes:
        if len(self) > self.room:
            self.clear()
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        self[piece] = value = pack_ids(f"<{len(ids)}I", *ids)
        return value


class Encoder:
    """Texts to token ids as little-endian 32-bit bytes.

    The vocabulary's own pre-tokenizer never joins what its pattern separates, so that separate strings are looked up. A
    text that holds an added token, such as <|endoftext|>, goes to the tokenizer as it is.
    """

    def __init__(self, path: str, room: int = 400_000):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # The same for texts of Latin-1 without ODD, for which the faster module has the same classes.
        self.latin = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.known = Known(self.tokenizer, room)

    def encode(self, text: str) -> bytes:
        if self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= SLICE:
            return self._part(text)
        parts, at = [], 0
        while at < len(text):
            cut = at + SLICE
            # A single space between two characters that are none always starts a new string.
            while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1 : cut + 2].isspace()):
                cut += 1
            parts.append(self._part(text[at:cut]))
            at = cut
        return b"".join(parts)

    def _part(self, text: str) -> bytes:
        try:
            raw = text.encode("latin-1")
            pattern = self.latin if len(raw.translate(None, ODD)) == len(raw) else self.pattern
        except UnicodeEncodeError:
            pattern = self.pattern
        return b"".join(map(self.known.__getitem__, pattern.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole capacities, with the remainder in front."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) from the number of pieces of each length.

    Each bin is filled greedily with the longest piece that fits. Then its smallest piece, if it isn't the first, gives
    way to the two unpacked pieces that fill the gap it leaves best, if they fill it better than it does. The bin is
    repeated as long as the counts last, so that the work depends on the number of lengths and not of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while left:
        sizes = sorted(left)
        bin_, used, gap = [], Counter(), capacity
        k = len(sizes)
        while (k := bisect_right(sizes, gap, 0, k)) > 0:
            length = sizes[k - 1]
            take = min(left[length] - used[length], gap // length)
            bin_ += [length] * take
            used[length] += take
            gap -= take * length
            k -= 1
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            used[smallest] -= 1
            pair = _best_pair(sizes, left, used, gap + smallest)
            if pair and sum(pair) > smallest:
                bin_[-1:] = pair
                used.update(pair)
            else:
                used[smallest] += 1
        used = +used
        times = min(left[length] // n for length, n in used.items())
        plan.append((sorted(bin_, reverse=True), times))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def _best_pair(sizes: list[int], left: dict[int, int], used: Counter, room: int) -> list[int] | None:
    best, low, high = None, 0, len(sizes) - 1
    while low <= high:
        a, b = sizes[low], sizes[high]
        if a + b > room:
            high -= 1
            continue
        if left[a] - used[a] >= 1 + (a == b) and left[b] - used[b] >= 1:
            if best is None or a + b > sum(best):
                best = [b, a]
        if left[b] - used[b] < 1:
            high -= 1
        else:
            low += 1
    return best


def _layout(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces of that length in a bin, first sequence, offset in the bin), by length and rank."""
    rows, next_rank, sequence = [], Counter(), 0
    for lengths, times in plan:
        at = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, next_rank[length], n, sequence, at))
            next_rank[length] += n * times
            at += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = raw.as_py()
                ids = (encoder.encode(value.decode("utf-8", "replace")) if value else b"") + END
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    for column, x in zip(out, (doc, k, start, length, crc)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = 1024, *, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its place in a sequence of at most `capacity` tokens.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its ids and the end id 2, so that
    a null or empty text is one piece of length 1; only longer ones than the capacity are cut. Repeated rows are packed
    each; ties between equal lengths are broken by doc_id and piece. Only key and text are read, so other columns can't
    clash. An empty table gives no rows. The driver sees the number of pieces of each length, at most `capacity` numbers.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = materialize(tokenized_pieces(docs, path, capacity, key, text))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    layout = _layout(best_two_fit(counts, capacity))
    laned = pieces.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(LANES)).cast("int"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = laned.groupBy("length", "lane").count().select(
        "length", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("length", "lane").orderBy("doc_id", "piece")
    ranked = laned.withColumn("k", F.row_number().over(within) - 1).join(lanes, ["length", "lane"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("k")).alias("rank")
    )
    keys = layout[:, 0] * (1 << 50) + layout[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = layout[np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1]
            bin_, nth = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + bin_), pa.array(row[:, 4] + nth * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
