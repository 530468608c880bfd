"""Operator 7: mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, words_of

log = logging.getLogger(__name__)

SWEEPS = 12
#: How far a raked marginal may be from its target before this is reported.
TOLERANCE = 0.001
#: Values of a dimension up to which the cells are raked on the driver; beyond, they are raked as a table, to the same targets.
NAMED = 1000
DIMENSIONS = ("source", "lang", "topic")


def topic_of(n_tokens: Column) -> Column:
    """The topic where documents have no such column: the form of the text by its length."""
    return F.when(n_tokens < 150, "note").when(n_tokens < 600, "article").otherwise("long form")


def flattened(power: float) -> Callable[[Mapping], dict]:
    """Target shares in proportion to a power of the present shares: 1 leaves them, 0 makes them equal."""
    def targets(shares: Mapping) -> dict:
        raised = {k: v**power for k, v in shares.items()}
        total = sum(raised.values())
        return {k: v / total for k, v in raised.items()}
    return targets


def rake(cells: dict[tuple, float], targets: list[dict], sweeps: int = SWEEPS) -> dict[tuple, float]:
    """Weights of the cells whose marginals are the targets, nearest to the given ones in relative entropy.

    Each step scales the cells so that one dimension has its target shares; a value without a target keeps weight zero.
    """
    w = dict(cells)
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            sums = defaultdict(float)
            for cell, x in w.items():
                sums[cell[d]] += x
            w = {cell: x * target.get(cell[d], 0.0) / sums[cell[d]] if sums[cell[d]] else 0.0 for cell, x in w.items()}
    return w


def rake_table(cells: DataFrame, targets: Mapping[str, Callable[[Mapping], dict]], sweeps: int = SWEEPS) -> DataFrame:
    """DIMENSIONS, share and w, the raked share, of cells (DIMENSIONS, n tokens): as from rake(), over any number of cells.

    A sweep is three sums and joins, written to the shared folder. The driver holds the shares and targets of the values
    of one dimension at a time, as the targets are functions of these.
    """
    total = float(cells.agg(F.sum("n")).first()[0] or 1.0)
    w = materialize(cells.select(*DIMENSIONS, (F.coalesce("n", F.lit(0)) / F.lit(total)).alias("share"))).withColumn("w", F.col("share"))
    goals = {}
    for d in DIMENSIONS:
        shares = {r[0]: r[1] for r in w.groupBy(d).agg(F.sum("share")).collect()}
        goals[d] = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[d](shares).items()], f"{d} string, goal double")
    for _ in range(sweeps):
        for d in DIMENSIONS:
            sums = w.groupBy(d).agg(F.sum("w").alias("s")).join(goals[d], d, "left")
            scaled = F.when(F.col("s") > 0, F.col("w") * F.coalesce("goal", F.lit(0.0)) / F.col("s")).otherwise(0.0)
            w = w.join(sums, d).select(*DIMENSIONS, "share", scaled.alias("w"))
        w = materialize(w)
    gap = max(w.groupBy(d).agg(F.sum("w").alias("s")).join(goals[d], d, "full").agg(F.max(F.abs(F.coalesce("s", F.lit(0.0)) - F.coalesce("goal", F.lit(0.0))))).first()[0] or 0.0 for d in DIMENSIONS)
    _report(gap)
    return w


def _report(gap: float) -> None:
    if gap > TOLERANCE:
        log.warning("raking leaves a marginal %.4f from its target: the targets may not be reachable together", gap)


def scale_for(budget: float, sums: Callable[[float], tuple[float, float]]) -> float:
    """The factor c at which sum(min(share, c * w)) over the cells is the budget, as far as they hold enough.

    sums(c) gives the share of the cells that are kept whole at c (w * c >= share) and the w of the others. From c = budget
    on, what whole cells can't give is asked of the others, until no further cell becomes whole.
    """
    c = budget
    while True:
        whole, rest = sums(c)
        if rest <= 1e-15 or whole >= budget:
            return c
        if (now := (budget - whole) / rest) <= c * (1 + 1e-12):
            return c
        c = now


def uniform(key: Column) -> Column:
    """A number in [0, 1) from a key, the same in every run: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixture(
    docs: DataFrame, targets: Mapping[str, Callable[[Mapping], dict]] | None = None, *, budget: float = 0.5, sweeps: int = SWEEPS, keep: tuple[str, ...] = (), topic: Callable[[Column], Column] = topic_of
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, short and kept of every row, after the columns `keep` as k_<name>.

    Tokens are words, counted over all rows. The cells of source, language and topic are raked to the target shares; a
    document's probability is in proportion to its cell's raked share over its present share, so that `budget` of all
    tokens are expected to be kept. A cell that would need more than all of its documents is kept whole and marked short,
    and the others make up for it: a rare cell costs the others nothing. A document is kept if its own number in [0, 1) is
    below its probability. Rows of one doc_id are kept or left together; a null source or language is the empty one; a null
    text has no tokens; a cell without tokens is kept whole. Only doc_id, source, lang, text and `keep` are read. An empty
    table gives no rows. A marginal further than TOLERANCE from its target after the sweeps is logged as a warning. Where a
    dimension has more than NAMED values, the cells stay a table.
    """
    targets = dict.fromkeys(DIMENSIONS, flattened(0.8)) | dict(targets or {})
    t = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep], F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.size(words_of(text_of())).cast("long").alias("n_tokens"),
    )
    t = t if keep else materialize(t)  # without texts it is small, and these are then split once
    t = t.withColumn("topic", topic(F.col("n_tokens")))
    counted = materialize(t.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")))
    many = counted.agg(*[F.countDistinct(d) for d in DIMENSIONS]).first()
    if max(many) > NAMED:
        w = rake_table(counted, targets, sweeps)
        whole = lambda c: F.col("w") * F.lit(c) >= F.col("share")
        c = scale_for(budget, lambda c: tuple(x or 0.0 for x in w.agg(F.sum(F.when(whole(c), F.col("share"))), F.sum(F.when(~whole(c), F.col("w")))).first()))
        wanted = F.when(F.col("share") > 0, F.col("w") * F.lit(c) / F.col("share")).otherwise(F.lit(1.0))
        table = w.select(*DIMENSIONS, F.least(F.lit(1.0), wanted).alias("probability"), (wanted > 1 + 1e-9).alias("short"))
        return _chosen(t.join(table, [*DIMENSIONS]), keep)
    cells = {tuple(cell): float(n or 0) for *cell, n in counted.collect()}
    total = sum(cells.values()) or 1.0
    share = {c: n / total for c, n in cells.items()}
    marginals = [defaultdict(float) for _ in DIMENSIONS]
    for cell, x in share.items():
        for d in range(len(DIMENSIONS)):
            marginals[d][cell[d]] += x
    goals = [targets[d](m) if any(m.values()) else dict(m) for d, m in zip(DIMENSIONS, marginals)]
    raked = rake(share, goals, sweeps)
    _report(max((abs(sum(x for cell, x in raked.items() if cell[d] == v) - goal) for d in range(len(DIMENSIONS)) for v, goal in goals[d].items()), default=0.0))
    c = scale_for(budget, lambda c: (sum(share[k] for k, x in raked.items() if x * c >= share[k]), sum(x for k, x in raked.items() if x * c < share[k])))
    wanted = {k: raked[k] * c / x if x else 1.0 for k, x in share.items()}
    rows = [(*k, min(1.0, v), v > 1 + 1e-9) for k, v in sorted(wanted.items())]
    table = docs.sparkSession.createDataFrame(rows, "source string, lang string, topic string, probability double, short boolean")
    return _chosen(t.join(F.broadcast(table), [*DIMENSIONS]), keep)  # one row per cell, bounded as above


def _chosen(t: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return t.select(*[f"k_{c}" for c in keep], "doc_id", "source", "lang", "topic", "n_tokens", "probability", "short", (uniform(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sql(power: float = 0.8, sweeps: int = SWEEPS, budget: float = 0.5) -> str:
    """The same in SQL, for documents with the topic by length.

    The factor: with cells in the order of their odds, the first k are kept whole for the least k at which the factor that
    the others then need leaves the next one below 1.
    """
    steps = ["c0 AS (SELECT source, lang, topic, sum(n_tokens) AS n, sum(n_tokens) / (SELECT sum(n_tokens) FROM t) AS w FROM t GROUP BY ALL)"]
    for d in DIMENSIONS:
        steps.append(f"g_{d} AS (SELECT {d}, pow(sum(w), {power}) / sum(pow(sum(w), {power})) OVER () AS goal FROM c0 GROUP BY {d})")
    for k in range(3 * sweeps):
        d = DIMENSIONS[k % 3]
        steps.append(f"c{k + 1} AS (SELECT c.source, c.lang, c.topic, c.n, c.w * g.goal / sum(c.w) OVER (PARTITION BY c.{d}) AS w FROM c{k} c JOIN g_{d} g ON g.{d} = c.{d})")
    last = f"c{3 * sweeps}"
    return f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_tokens,
        CASE WHEN n_tokens < 150 THEN 'note' WHEN n_tokens < 600 THEN 'article' ELSE 'long form' END AS topic
      FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents)),
    {", ".join(steps)},
    odds AS (SELECT c.source, c.lang, c.topic, c.w, a.w AS share, c.w / a.w AS o FROM {last} c JOIN c0 a USING (source, lang, topic) WHERE a.n > 0),
    ranked AS (SELECT o, coalesce(sum(share) OVER b, 0.0) AS whole, coalesce(sum(w) OVER b, 0.0) AS gone
      FROM odds WINDOW b AS (ORDER BY o DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    factor AS (SELECT ({budget} - whole) / (1 - gone) AS c FROM ranked WHERE whole < {budget} AND ({budget} - whole) / (1 - gone) * o <= 1 ORDER BY whole LIMIT 1)
    SELECT doc_id, source, lang, topic, n_tokens, round(least(1.0, p), 9) AS probability, p > 1 + 1e-9 AS short,
      CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS kept
    FROM (SELECT t.*, coalesce(o * (SELECT c FROM factor), 1.0) AS p FROM t LEFT JOIN odds USING (source, lang, topic))"""
