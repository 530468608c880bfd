"""Chunking of documents: strategies, splitting, hierarchy, validation samples and prompts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import HEADING, WORDS, TokenCounter, token_count

SECTION = re.compile(r"\s*#{1,3}(?: |\s*$)")
#: Characters a token, where a size in tokens bounds characters.
CHARS = 4
#: Characters of the pieces that leave a task at once.
FRAME = 2_000_000
SENTENCE = r"(?<=[.!?])\s+|\n{2,}"
HIGH_STAKES = ("legal", "financial", "medical")


def select_strategy(profile: Column) -> Column:
    """markdown_header, semantic or recursive by the profile that parse_profile gives."""
    headed = (profile["structure_type"] == "well-structured") & (profile["heading_consistency"] == "consistent")
    plain = (profile["content_density"] == "uniform") & (profile["structure_type"] == "unstructured")
    return F.when(headed, "markdown_header").when(profile["primary_content_type"].isin("transcript", "qa_pairs"), "semantic").when(plain, "recursive").otherwise("semantic")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _starts(sizes: Column, most: Column) -> Column:
    """The places, from 1, at which greedy runs of at most `most` begin. The fold carries numbers; only starts are appended."""
    def step(s, n):
        fresh = (F.size(s["starts"]) == 0) | (s["sum"] + n > most)
        return F.struct(
            (s["at"] + 1).alias("at"), F.when(fresh, n).otherwise(s["sum"] + n).alias("sum"),
            F.when(fresh, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(sizes, F.struct(F.lit(1).alias("at"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("starts")), step)["starts"]


def _semantic(rows: DataFrame, keys: list[str], max_tokens: Column, counter: TokenCounter = WORDS) -> DataFrame:
    """keys, piece_no and content: each text is cut within its row, without a shuffle."""
    cut = rows.select(*keys, max_tokens.alias("_most"), sentences(F.col("text")).alias("_s"))
    sized = cut.withColumn("_at", _starts(F.transform("_s", counter.column), F.col("_most")))
    run = lambda start, i: F.array_join(F.slice("_s", start, F.coalesce(F.get("_at", i + 1), F.size("_s") + 1) - start), " ")
    return sized.select(*keys, F.posexplode(F.transform("_at", run)).alias("piece_no", "content"))


def semantic_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = 400, counter: TokenCounter = WORDS) -> DataFrame:
    """key, chunk_index, content and token_count: sentences packed greedily up to max_tokens and joined by spaces.

    A longer sentence stays whole. A null or empty text has no chunk.
    """
    out = _semantic(docs.select(F.col(key), F.col(text).alias("text")), [key], F.lit(max_tokens), counter)
    return out.select(key, F.col("piece_no").alias("chunk_index"), "content", counter.column(F.col("content")).alias("token_count"))


def recursive_pieces(text: str, size: int = 1600, overlap: int = 320, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, split at the coarsest separator that helps and merged with an overlap."""
    separator = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(separator) + 1 :]
    out: list[str] = []
    run: list[str] = []

    def merge() -> None:
        window: list[str] = []
        length = 0
        for part in run:
            extra = len(part) + (len(separator) if window else 0)
            if window and length + extra > size:
                out.append(separator.join(window).strip())
                while window and (length > overlap or length + extra > size):
                    length -= len(window.pop(0)) + (len(separator) if window else 0)
                extra = len(part) + (len(separator) if window else 0)
            window.append(part)
            length += extra
        if window:
            out.append(separator.join(window).strip())
        run.clear()

    for part in list(text) if separator == "" else text.split(separator):
        if len(part) <= size:
            if part:
                run.append(part)
        else:
            merge()
            out += recursive_pieces(part, size, overlap, finer or ("",))
    merge()
    return [x for x in out if x]


def markdown_pieces(text: str, max_tokens: int = 400, count: Callable[[str], int] = WORDS.plain) -> list[str]:
    """Sections at headings of level 1 to 3 outside of fences; longer ones are cut as recursive_pieces does.

    Pieces that are headings only go in front of the next body; trailing ones stand alone.
    """
    sections: list[list[str]] = [[]]
    fence = ""
    for line in text.split("\n"):
        mark = line.strip()[:3]
        if mark in ("```", "~~~") and fence in ("", mark):
            fence = "" if fence else mark
        elif not fence and SECTION.match(line):
            sections.append([])
        sections[-1].append(line)
    out: list[str] = []
    waiting: list[str] = []
    for body in ("\n".join(lines) for lines in sections):
        for piece in recursive_pieces(body, CHARS * max_tokens, CHARS * max_tokens // 5) if count(body) > max_tokens else [body]:
            piece = "\n".join(line.rstrip() for line in piece.strip().split("\n"))
            if not piece:
                continue
            waiting.append(piece)
            if not all(re.match(HEADING, line.strip()) for line in piece.split("\n") if line.strip()):
                out.append("\n\n".join(waiting))
                waiting = []
    return out + ["\n\n".join(waiting)] if waiting else out


def _framed(rows: Iterator[tuple], names: list[str], most: int = FRAME) -> Iterator[pd.DataFrame]:
    """Rows whose last entry is a text as frames of about so many characters, so that a task doesn't hold all that it makes of its input."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def split_texts(rows: DataFrame, keys: list[str], max_tokens: int = 400, counter: TokenCounter = WORDS) -> DataFrame:
    """keys, piece_no and content of (keys, text, strategy): each text cut by its strategy, within its row.

    Sections by headings always are at most 400 tokens, whatever max_tokens is. Null and empty texts have no piece.
    """
    fields = [rows.schema[k] for k in keys]
    schema = StructType([*fields, StructField("piece_no", IntegerType()), StructField("content", StringType())])

    count = counter.plain

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cut = (
                (*key, n, piece)
                for key, text, strategy in zip(frame[keys].itertuples(index=False, name=None), frame["text"], frame["strategy"])
                for n, piece in enumerate(markdown_pieces(text, count=count) if strategy == "markdown_header" else recursive_pieces(text, CHARS * max_tokens))
            )
            yield from _framed(cut, schema.names)

    known = rows.where("text is not null").select(*dict.fromkeys([*keys, "text", "strategy"]))
    return _semantic(known.where("strategy = 'semantic'"), keys, F.lit(max_tokens), counter).unionByName(known.where("strategy <> 'semantic'").mapInPandas(run, schema))


def recursive_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1600, counter: TokenCounter = WORDS) -> DataFrame:
    """key, chunk_index, content and token_count of pieces of at most `size` characters, which overlap by up to 320."""
    return _one_strategy(docs, key, text, "recursive", size // CHARS, counter)


def markdown_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", counter: TokenCounter = WORDS) -> DataFrame:
    return _one_strategy(docs, key, text, "markdown_header", 400, counter)


def _one_strategy(docs: DataFrame, key: str, text: str, strategy: str, max_tokens: int, counter: TokenCounter) -> DataFrame:
    out = split_texts(docs.select(key, F.col(text).alias("text"), F.lit(strategy).alias("strategy")), [key], max_tokens, counter)
    return out.select(key, F.col("piece_no").alias("chunk_index"), "content", counter.column(F.col("content")).alias("token_count"))


def chunk_documents(docs: DataFrame, key: str = "doc_id", max_tokens: int = 400, parent_tokens: int = 2000, counter: TokenCounter = WORDS) -> DataFrame:
    """The chunks of documents (key, text, profile), each by the strategy of its profile; long sections in two levels.

    Columns: key, chunk_index, parent_index, strategy, base_strategy, content, token_count. Propositions of documents in a
    high-stakes domain are put in by expand_propositions.
    """
    rows = docs.select(key, "text", select_strategy(F.col("profile")).alias("strategy"), (F.col("profile")["avg_section_length"] == "long").alias("_long"))
    flat = split_texts(rows.where("not _long"), [key, "strategy"], max_tokens, counter)
    no = F.lit(None)
    one = flat.select(key, F.col("piece_no").alias("chunk_index"), no.cast("int").alias("parent_index"), "strategy", no.cast("string").alias("base_strategy"), "content")
    out = one.unionByName(hierarchical_chunks(rows.where("_long"), key, parent_tokens=parent_tokens, child_tokens=max_tokens, counter=counter).drop("token_count"))
    return out.withColumn("token_count", counter.column(F.col("content")))


def hierarchical_chunks(docs: DataFrame, key: str = "doc_id", parent_tokens: int = 2000, child_tokens: int = 400, counter: TokenCounter = WORDS) -> DataFrame:
    """Parents of parent_tokens and below each its children, both by the strategy of the document (key, text, strategy).

    One running index per document; a child has its parent's index, the strategy `hierarchical` and its base strategy.
    """
    parents = split_texts(docs, [key, "strategy"], parent_tokens, counter).withColumnRenamed("piece_no", "parent_no")
    children = split_texts(parents.withColumnRenamed("content", "text"), [key, "strategy", "parent_no"], child_tokens, counter)
    both = parents.withColumn("child_no", F.lit(-1)).unionByName(children.withColumnRenamed("piece_no", "child_no"))
    numbered = both.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("parent_no", "child_no")) - 1)
    child = F.col("child_no") >= 0
    return numbered.select(
        key, "chunk_index", F.when(child, F.col("chunk_index") - F.col("child_no") - 1).alias("parent_index"), F.when(child, "hierarchical").otherwise(F.col("strategy")).alias("strategy"),
        F.when(child, F.col("strategy")).alias("base_strategy"), "content", counter.column(F.col("content")).alias("token_count"),
    )


def expand_propositions(chunks: DataFrame, propositions: DataFrame) -> DataFrame:
    """After each chunk of a high-stakes domain a row for each of its propositions (chunk_id, pos, proposition), reindexed."""
    wanted = chunks.where(F.col("domain").isin(*HIGH_STAKES)).select("source_id", "chunk_id", "chunk_index")
    rows = wanted.join(propositions, "chunk_id").select("source_id", "chunk_id", "chunk_index", "pos", F.col("proposition").alias("content"))
    both = chunks.select("source_id", "chunk_id", "chunk_index", F.lit(-1).alias("pos"), "content").unionByName(rows)
    order = Window.partitionBy("source_id").orderBy("chunk_index", "pos")
    return both.select("source_id", (F.row_number().over(order) - 1).alias("chunk_index"), F.when(F.col("pos") >= 0, F.col("chunk_id")).alias("parent_chunk_id"), "content")


def sample_for_validation(chunks: DataFrame, rates: Column, seed: str = "v1") -> DataFrame:
    """max(1, ceil(n * rate)) chunks of each source, those with the smallest hashes of seed and id."""
    w = Window.partitionBy("source_id")
    order = w.orderBy(F.md5(F.concat(F.lit(seed), F.col("chunk_id").cast("string"))), "chunk_id")
    n = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * rates).cast("int"))
    return chunks.withColumn("_n", n).withColumn("_k", F.row_number().over(order)).where("_k <= _n").drop("_n", "_k")


def validation_verdict(sample: DataFrame, verdicts: DataFrame, most: float = 0.2) -> DataFrame:
    """Per source, sampled and failed chunks and whether it fails: more than that share failed; no verdict is a pass."""
    failed = F.sum((~F.coalesce("pass", F.lit(True))).cast("int"))
    counted = sample.join(verdicts, "chunk_id", "left").groupBy("source_id").agg(F.count("*").alias("n_sampled"), failed.alias("n_failed"))
    return counted.withColumn("fails", F.col("n_failed") > most * F.col("n_sampled"))


def build_prompt(template: str, columns: dict[str, tuple[Column, int | None]]) -> Column:
    """The template with each {name} replaced by its column, cut to its limit of characters if it has one."""
    out = F.lit(template)
    for name, (column, limit) in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), column if limit is None else F.substring(column, 1, limit))
    return out


def answer_context(question: Column, results: Column, instructions: str) -> Column:
    return F.concat(F.lit(instructions), F.lit("\n\nQuestion: "), question, F.lit("\n\n```json\n"), F.to_json(results), F.lit("\n```"))


def best_rows(rows: DataFrame, key: str, n: int, order: tuple[str, ...] = ("rank",), text: str | None = None, budget: int | None = None) -> DataFrame:
    """The n first rows of each key by the order, and of these as many as fit into a budget of tokens of their text, at least one.

    Each task keeps its own first n before anything is shuffled, so that a key with any number of rows is n of them.
    """
    w = Window.partitionBy(key).orderBy(*order)
    best = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    if budget is not None:
        spent = F.sum(token_count(F.col(text))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        best = best.withColumn("_spent", spent).where((F.col("_k") == 1) | (F.col("_spent") <= budget)).drop("_spent")
    return best.drop("_k")


def answer_contexts(results: DataFrame, key: str, question: Column, columns: tuple[str, ...], instructions: str, n: int | None = 20, order: tuple[str, ...] = ("rank",)) -> DataFrame:
    """key and prompt: the question with the columns of its n best results, or of all, in their order."""
    best = (results if n is None else best_rows(results, key, n, order)).withColumn("_q", question)
    listed = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("r"))))
    rows = best.groupBy(key, "_q").agg(F.transform(listed, lambda x: x["r"]).alias("r"))
    return rows.select(key, answer_context(F.col("_q"), F.col("r"), instructions).alias("prompt"))


def community_context(chunks: DataFrame, n: int = 5, budget: int | None = None) -> DataFrame:
    """Per community its n best chunks in the order of their rank, within a budget of tokens if there is one, each under its source's name."""
    chunks = best_rows(chunks, "community", n, ("rank",), "content", budget)
    said = F.concat(F.lit("[Source: "), "source_name", F.lit("]\n"), "content")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", said.alias("s")))), lambda x: x["s"])
    return chunks.groupBy("community").agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))
