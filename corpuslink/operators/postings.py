"""A full-text index that is stored once and read by term: postings in blocks of rows, each with its best possible score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import materialize
from ..functions.text import ANALYZERS

#: Rows of the corpus in a block in the mean, folders that terms are dealt to, and terms that are named to the scan.
BLOCK, BUCKETS, NAMED = 128, 16, 10_000


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def exact_sum(column: Column) -> Column:
    """The sum in decimals: the same in any order, so that rows with equal parts tie."""
    return F.sum(column.cast("decimal(28,18)")).cast("double")


class Index:
    """The postings of a corpus (id, text) below a path.

    Rows of the corpus are dealt to blocks by a hash of their id. `postings` has one row for each term and block: the rows
    that hold the term, with positions and lengths, and `best`, the greatest saturation of the term's frequency in the
    block (BM25 without its inverse document frequency). Terms lie in folders by hash, sorted in their files, so that a
    scan that names its terms reads their folders and, by the statistics of Parquet, few of their pages; a frequent term is
    many rows in several files. `terms` has the document frequency of each term, `corpus` a single row of totals.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.totals = spark.read.parquet(f"{path}/corpus").first()

    @classmethod
    def build(cls, docs: DataFrame, path: str, analyzer: str = "simple", k1: float = 1.2, b: float = 0.75) -> Index:
        """Writes the index of docs (id, text; ids are unique) to a new path. Texts without a term and null texts are in no block."""
        spark = docs.sparkSession
        read = docs.select(F.col("id").cast("long").alias("id"), ANALYZERS[analyzer](F.col("text")).alias("terms")).where(F.size("terms") > 0)
        n, mean = read.agg(F.count("*"), F.avg(F.size("terms"))).first()
        blocks = max(1, -(-n // BLOCK))
        totals = [(n, float(mean or 0.0), blocks, k1, b, analyzer)]
        spark.createDataFrame(totals, "n_docs long, avg_len double, blocks long, k1 double, b double, analyzer string").coalesce(1).write.parquet(f"{path}/corpus")
        # The texts are dealt by block once; the groups below are then within a task, and no posting is shuffled to be grouped.
        placed = read.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition("block")
        each = placed.select("block", "id", F.size("terms").alias("len"), F.posexplode("terms").alias("pos", "term"))
        held = each.groupBy("block", "term", "id", "len").agg(F.collect_list("pos").alias("positions"))
        tf = F.size("positions")
        saturation = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(float(mean or 1.0))))
        rows = held.groupBy("block", "term").agg(
            F.collect_list(F.struct("id", "len", F.sort_array("positions").alias("positions"))).alias("rows"), F.max(saturation).alias("best")
        )
        # A folder's terms are written by as many tasks as the corpus has blocks for, so that a frequent term isn't one file.
        spread = F.pmod(F.col("block"), F.lit(max(1, min(64, blocks // 64))))
        dealt = rows.withColumn("bucket", _bucket("term")).repartition("bucket", spread).sortWithinPartitions("bucket", "term", "block")
        dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
        kept = spark.read.parquet(f"{path}/postings").select("term", F.size("rows").alias("n")) if n else rows.select("term", F.lit(0).alias("n"))
        terms = kept.groupBy("term").agg(F.sum("n").alias("df")).withColumn("bucket", _bucket("term"))
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
        return cls(spark, path)

    def _read(self, table: str, asked: DataFrame) -> DataFrame:
        """The rows of the asked terms (term). Up to NAMED of them are named in the scan, more are joined."""
        schema = {
            "postings": "term string, block long, rows array<struct<id:bigint,len:int,positions:array<int>>>, best double, bucket int",
            "terms": "term string, df long, bucket int",
        }[table]
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        some = [r[0] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        if len(some) > NAMED:
            return df.join(asked.select("term").distinct(), "term", "left_semi").drop("bucket")
        if not some:
            return df.where("false").drop("bucket")
        rows = self.spark.createDataFrame([(x,) for x in some], "term string")
        buckets = sorted({r[0] for r in rows.select(_bucket("term")).distinct().collect()})
        return df.where(F.col("bucket").isin(buckets) & F.col("term").isin(some)).drop("bucket")

    def posted(self, asked: DataFrame) -> DataFrame:
        """term, id, positions and tf of the asked terms (term), as `ranking.postings` has them of all."""
        rows = self._read("postings", asked).select("term", F.explode("rows").alias("r"))
        return rows.select("term", "r.id", "r.positions", F.size("r.positions").cast("long").alias("tf"))

    def weights(self, asked: DataFrame) -> DataFrame:
        """term and idf of the asked terms that the corpus has."""
        df = F.col("df").cast("double")
        return self._read("terms", asked).select("term", F.log(1 + (F.lit(float(self.totals["n_docs"])) - df + 0.5) / (df + 0.5)).alias("idf"))

    def bm25_topk(self, terms: DataFrame, n: int, first: int = 2) -> DataFrame:
        """query_id, id, score and rank of the n best rows that have any of the terms (query_id, term), by BM25; ties by id. Exact.

        A block can't score above the sum of what its terms can score at best, which is read without the postings. Each
        query scores the `first` blocks of greatest bounds; its n-th score is a floor, and of the other blocks only those
        whose bound reaches it are read. `visited` holds how many (query, block) pairs were scored, and of how many.
        """
        asked = terms.select("query_id", "term").distinct()
        wanted = materialize(asked.join(self.weights(asked), "term"))
        kept = self._read("postings", asked)
        bound = wanted.join(kept.select("term", "block", "best"), "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        bound = materialize(bound.withColumn("nth", F.row_number().over(order)))
        near = materialize(self._top(bound.where(F.col("nth") <= first), wanted, kept, n))
        floor = near.where(F.col("rank") == n).select("query_id", F.col("score").alias("floor"))
        more = materialize(bound.where(F.col("nth") > first).join(floor, "query_id", "left").where("floor is null or bound >= floor - 1e-9"))
        self.visited = bound.where(F.col("nth") <= first).count() + more.count(), bound.count()
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
        both = near.drop("rank").unionByName(self._top(more, wanted, kept, n).drop("rank"))
        return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)

    def _top(self, blocks: DataFrame, wanted: DataFrame, kept: DataFrame, n: int) -> DataFrame:
        t = self.totals
        rows = blocks.select("query_id", "block").join(wanted, "query_id").join(kept, ["term", "block"]).select("query_id", "idf", F.explode("rows").alias("r"))
        tf = F.size("r.positions")
        one = F.col("idf") * tf * (t["k1"] + 1) / (tf + t["k1"] * (1 - t["b"] + t["b"] * F.col("r.len") / F.lit(t["avg_len"] or 1.0)))
        scored = rows.groupBy("query_id", F.col("r.id").alias("id")).agg(exact_sum(one).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
