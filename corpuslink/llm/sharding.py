"""Operator 6: minimax contiguous partition of atomic groups into shards."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, text_of

#: Atomic groups: equal texts always share a unit. The driver holds at most one size for each unit.
UNITS = 1 << 16
#: Rows of a shard are numbered lane by lane, so that no task orders a whole shard.
LANES = 1024


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity at which the sizes, in their order, fit into so many contiguous shards."""
    ends = list(accumulate(sizes))
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(_greedy(ends, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def _greedy(ends: list[int], capacity: int) -> list[int]:
    """Positions at which a new shard starts when each is filled as far as the capacity goes."""
    starts, k, done = [], 0, 0
    while (k := bisect_right(ends, done + capacity, k)) < len(ends):
        starts.append(k)
        done = ends[k - 1]
    return starts


def plan_shards(units: list[tuple[int, int]], shards: int) -> tuple[list[int], list[int]]:
    """(unit, size) in the order of units -> (units with a shard of their own, units at which each next shard starts).

    A unit above the mean of what is left takes a shard of its own, and the others are divided among the other shards.
    """
    rest, alone = sorted(units), []
    while rest and len(alone) < shards - 1:
        unit, size = max(rest, key=lambda x: x[1])
        if size * (shards - len(alone)) <= sum(s for _, s in rest):
            break
        alone.append(unit)
        rest.remove((unit, size))
    sizes = [s for _, s in rest]
    ends = list(accumulate(sizes))
    starts = _greedy(ends, least_capacity(sizes, shards - len(alone))) if rest else []
    return alone, [rest[k][0] for k in starts]


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard under the law `bytes`: the largest shard is as small as contiguous cuts allow.

    Size is the UTF-8 length of the text plus 1; a null text counts as empty. Equal texts form one atomic unit (units are
    texts by hash, 65,536 at most, so what the driver searches is bounded at any input). Ties and repeated rows each get
    a slot of their own; a null key is a key like any other; columns other than key and text are not read, so their names
    can't clash. An empty table gives no rows.
    """
    rows = materialize(
        docs.select(F.col(key).alias("doc_id"), text_of(text).alias("t")).select(
            "doc_id",
            (F.octet_length("t") + 1).cast("long").alias("size"),
            F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64("t"), F.lit(UNITS)).cast("int").alias("unit"),
        )
    )
    units = [tuple(r) for r in rows.groupBy("unit").agg(F.sum("size")).collect()]
    alone, starts = plan_shards(units, shards)
    at = F.lit(len(alone))
    for start in starts:
        at = at + (F.col("unit") >= start).cast("int")
    for k, unit in enumerate(alone):
        at = F.when(F.col("unit") == unit, k).otherwise(at)
    placed = rows.withColumn("shard", at.cast("int")).withColumn(
        "lane", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(LANES)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = placed.groupBy("shard", "lane").agg(F.count("*").alias("n")).select(
        "shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("k", F.row_number().over(within) - 1)
        .join(F.broadcast(lanes), ["shard", "lane"])  # at most shards * LANES rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
