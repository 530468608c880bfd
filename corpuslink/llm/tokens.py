"""Operator 12: token counts from pieces that are counted once for each distinct pre-token."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The most frequent pre-tokens are joined where texts are read; no other one can then be a hot key of the join.
#: What the driver holds and sends is bounded by their number and their characters.
HEAD, HEAD_CHARS = 1 << 16, 32
#: Distinct pre-tokens that a task gathers before it hands their counts on.
ROOM = 300_000
#: Below this all characters are in NFC, and `re` parts them by explicit classes.
PLAIN = "ƀ"


class Splitter:
    """Texts to pre-tokens as the tokenizer's own normalizer and pre-tokenizer part them, and the pieces of one pre-token.

    A pre-token is the normalized string. Texts of characters below PLAIN go by a pattern of the standard library that
    gives the same strings; others go by the tokenizer's own parts. Strings of added tokens are one token each and part
    the text around them, as the tokenizer does by default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.normalizer, self.parts, self.model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        kinds = {k: "".join(re.escape(c) for c in map(chr, range(ord(PLAIN))) if unicodedata.category(c)[0] == k) for k in "LN"}
        letters, numbers = kinds["L"], kinds["N"]
        spaces = r" \t\n\x0b\x0c\r\x85\xa0"
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        # The byte-level alphabet: bytes that print stand for themselves, the others for characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte = {c: b for b, c in self.sign.items()}

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens in order, and the number of added tokens among them."""
        if not self.added.search(text):
            return self._split(text), 0
        between = self.added.split(text)
        return [x for part in between for x in self._split(part)], len(between) - 1

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        if text.isascii() or max(text) < PLAIN:
            return self.plain.findall(text.lower())
        found = self.parts.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in s).decode("utf-8") for s, _ in found]

    def pieces(self, pre_token: str) -> int:
        return len(self.model.tokenize("".join(self.sign[b] for b in pre_token.encode("utf-8"))))


_SPLITTERS: dict[str, Splitter] = {}


def splitter_of(path: str) -> Splitter:
    """One splitter for all tasks of a worker."""
    if path not in _SPLITTERS:
        _SPLITTERS.clear()
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def _texts(column: pa.Array) -> Iterator[str]:
    for raw in column:
        value = raw.as_py()
        yield value.decode("utf-8", "replace") if value else ""


def pre_token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """piece, n and n_tokens of each distinct pre-token of all texts: its occurrences, and its tokens, counted once.

    A task counts what it reads before anything is shuffled, so that a frequent pre-token is a row of each task.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = splitter_of(path), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            for value in _texts(batch.column(0)):
                seen.update(splitter.split(value)[0])
                if len(seen) > ROOM:
                    yield flush()
        yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = splitter_of(path)
        for batch in batches:
            tokens = [splitter.pieces(p) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(tokens, pa.int64())], ["piece", "n", "n_tokens"])

    told = docs.select(F.col(text).cast("string").cast("binary")).mapInArrow(gather, "piece string, n long")
    return told.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(count, "piece string, n long, n_tokens long")


def _least_of_head(known: DataFrame) -> int:
    """The occurrences from which on at most HEAD pre-tokens are left, by their numbers for each sixteenth of a power of two.

    Where more than HEAD are alike frequent none of these is in the head, and none of them is frequent.
    """
    step = F.floor(16 * F.log2("n")).cast("int")
    sizes = known.where(F.length("piece") <= HEAD_CHARS).groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    left, least = HEAD, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["step"]):
        left -= r["k"]
        if left < 0:
            break
        least = r["n"]
    return least


def token_counts(docs: DataFrame, limit: int = 2048, *, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every row, by the counts of its pre-tokens.

    The tokens of a text are the sum over its pre-tokens of how often it has them times their pieces; ids are never made
    for a text. The HEAD most frequent pre-tokens (at most HEAD_CHARS characters each) are looked up where a text is read;
    each other one is a row (text, pre-token, times) that is joined to the table of counts by the pre-token.

    A null text counts as empty (0 bytes, 0 tokens). Texts are read whole, and a text without white space is as long a
    pre-token as it is. Repeated rows are counted each, null keys stay, an empty table gives no rows. Only key and text
    are read, so other columns can't clash; a key that is no number becomes null.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    known = materialize(pre_token_counts(docs, path, text))
    first = known.where((F.length("piece") <= HEAD_CHARS) & (F.col("n") >= _least_of_head(known)))
    head = docs.sparkSession.sparkContext.broadcast({r["piece"]: r["n_tokens"] for r in first.select("piece", "n_tokens").collect()})
    rest = pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, of = splitter_of(path), head.value
        for batch in batches:
            sizes, sums, others = [], [], []
            for value in _texts(batch.column(2)):
                pieces, total = splitter.split(value)
                left = []
                for piece, times in Counter(pieces).items():
                    if piece in of:
                        total += times * of[piece]
                    else:
                        left.append({"piece": piece, "times": times})
                sizes.append(len(value.encode("utf-8")))
                sums.append(total)
                others.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(others, rest)],
                ["row", "doc_id", "n_bytes", "n_tokens", "rest"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("_t"))
    # Written once, since the numbers of rows are to be the same on both sides of the join.
    read = materialize(rows.mapInArrow(run, "row long, doc_id long, n_bytes long, n_tokens long, rest array<struct<piece:string,times:long>>"))
    tail = read.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.times").join(known.select("piece", F.col("n_tokens").alias("each")), "piece")
    added = tail.groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("more"))
    total = F.col("n_tokens") + F.coalesce("more", F.lit(0))
    return read.drop("rest").join(added, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
