"""Operator 10: URL rules, and association rules mined from labelled URLs for what they leave open."""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path, verdict): a rule fits its host and all subdomains if the URL's path starts with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BAD = "\x00bad"
#: Mined rules up to which the index is a constant of the projection.
MOST = 2000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(_after(url, r"^([^/?#]*)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return _after(url, r"^[^/?#]*([^?#]*)")


def _after(url: Column, pattern: str) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, pattern, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: its scheme, every host label by its place, path segments and query keys."""
    host, path = host_of(url), path_of(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1)))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(scheme, labels, segments, keys))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_rows: int = 20, deviations: float = 3.0) -> DataFrame:
    """(antecedent, confidence, support) of the association rules whose consequent is bad, from (url, bad).

    Spark's parallel FP-growth counts over all labelled URLs. A rule holds on at least the share min_support of the rows and
    on min_rows of them, and its confidence, less so many standard deviations (Wilson's bound), is above the share of bad
    rows: a few rows are no evidence, on a small table or a large one. Rules that contain another rule with at least their
    confidence are pruned. Their number is bounded by the support: an item is kept if a share of min_support of the
    rows has it, so that at most (tokens a URL) / min_support items remain at any size of the input.
    """
    known = labelled.where("url is not null and bad is not null")
    n, base = known.agg(F.count("*"), F.avg(F.col("bad").cast("double"))).first()
    baskets = known.select(F.when(F.col("bad"), F.array_append(tokens_of(F.col("url")), BAD)).otherwise(tokens_of(F.col("url"))).alias("items"))
    least = min(1.0, max(min_support, min_rows / n if n else 1.0))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    p, z, rows = F.col("confidence"), F.lit(deviations), F.col("support") * F.lit(float(n)) / F.col("confidence")
    low = (p + z * z / (2 * rows) - z * F.sqrt(p * (1 - p) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows)
    rules = materialize(
        model.associationRules.where(F.array_contains("consequent", BAD) & (F.round(F.col("support") * n) >= min_rows) & (low > F.lit(base or 0.0)))
        .select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support")
    )
    other = rules.select(F.col("antecedent").alias("a2"), F.col("confidence").alias("c2"))
    wider = (F.size("a2") < F.size("antecedent")) & (F.size(F.array_except("a2", "antecedent")) == 0) & (F.col("c2") >= F.col("confidence") - 1e-12)
    # A narrower rule shares its first token with the wider one, so that the join has a key.
    held = rules.select("*", F.explode("antecedent").alias("token")).join(other.withColumn("token", F.get("a2", F.lit(0))), "token").where(wider)
    return rules.join(held.select("antecedent").distinct(), "antecedent", "left_anti")


def _postings(rules: DataFrame) -> DataFrame:
    """Each rule under one of its tokens, the one with the longest text."""
    longest = F.reduce("antecedent", F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return rules.select(longest.alias("token"), "antecedent")


def hits(url: Column, postings: dict[str, list[list[str]]]) -> Column:
    """Whether a URL holds every token of some rule, from an inverted index that the expression holds as a constant."""
    index = F.from_json(F.lit(json.dumps(postings)), "map<string,array<array<string>>>")
    tokens = tokens_of(url)
    posted = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(index, t)), lambda rules: rules.isNotNull()))
    return F.exists(posted, lambda rule: F.size(F.array_except(rule, tokens)) == 0)


def match_rules(urls: DataFrame, postings: DataFrame) -> DataFrame:
    """The distinct urls that hold every token of some rule.

    A URL's tokens look up the postings in a join and the other tokens of the rule are then checked, so that no counting
    shuffle is needed.
    """
    return (
        urls.select("url", tokens_of(F.col("url")).alias("tokens"))
        .select("url", "tokens", F.explode("tokens").alias("token"))
        .join(postings, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .select("url").distinct()
    )


def filter_urls(
    pages: DataFrame, labels: DataFrame, *, min_support: float = 0.002, min_confidence: float = 0.6, min_rows: int = 20, rules=RULES
) -> DataFrame:
    """Every page's host, path, rule and verdict.

    labels (doc_id, quality, toxic) are joined to page_id; a page is bad if it is toxic or of no quality, and unlabelled
    if both are null. A URL that no fixed rule fits is blocked if a mined rule matches it, else allowed. Up to MOST mined
    rules become an index within the projection, so that each page is judged where it is scanned; more are joined by token.
    A null URL has an empty host and path and no tokens and is allowed. Repeated pages are judged each; repeated labels weigh
    each. Without labels, or without bad ones, nothing is mined. Only the named columns are read, so that others can't clash.
    """
    p = pages.select("page_id", "url")
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = labels.where("toxic is not null or quality is not null").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    mined = materialize(_postings(mine_rules(p.join(known, "page_id"), min_support, min_confidence, min_rows)))
    few = mined.limit(MOST + 1).collect()
    if len(few) <= MOST:
        postings: dict[str, list] = {}
        for token, antecedent in few:
            postings.setdefault(token, []).append(antecedent)
        judged = p.withColumn("hit", hits(F.col("url"), postings) if postings else F.lit(False))
    else:
        blocked = match_rules(p.where("url is not null"), mined).select("url", F.lit(True).alias("hit"))
        judged = p.where("url is not null").join(blocked, "url", "left").unionByName(p.where("url is null").withColumn("hit", F.lit(False)))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    found = judged.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("r"), "hit")
    return found.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
    )
