"""Operator 9: quality rules, a threshold table compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of, words_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de des un une et est que qui dans pour sur pas par au avec ce il sont plus "
    "el los las y en por con para una su al lo como más pero sus o este si no se del"
).split()
WINDOW = 5

#: (rule, ratio, lower bound or None, upper bound or None, words from which on it holds); a text that leaves the bounds of
#: any is rejected. A few words say little about ratios, so that only longer texts are held to some.
#: Ratios are taken over words, lines that have a word, or the words' characters.
THRESHOLDS = (
    ("length", "n_words", 10, None, 0),
    ("word_length", "word_chars / n_words", 2.0, 25.0, 0),
    ("symbols", "n_symbols / n_words", None, 0.1, 0),
    ("stop_words", "n_stop_words / n_words", 0.02, None, 50),
    ("repeated_words", "n_repeat_words / n_words", None, 0.2, 0),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.5, 0),
    ("capitals", "n_capitals / word_chars", None, 0.5, 0),
)


def _occurrences(char_class: str) -> Column:
    return (F.size(F.split("_t", char_class, -1)) - 1).cast("long")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every whole text, by built-in functions only; `keep` names further columns to hand on."""
    carried = [F.col(c) for c in keep]
    names = [*keep, "_key"]
    t = docs.select(*carried, F.col(key).alias("_key"), text_of(text).alias("_t"))
    t = t.select(*names, "_t", words_of(F.col("_t")).alias("_w"), F.size(words_of(F.col("_t"))).alias("_n"))
    w = lambda i: F.get("_w", i)
    windows = F.when(
        F.col("_n") > WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("_n") - WINDOW, F.lit(0))),
            lambda i: F.xxhash64(*(w(i + k) for k in range(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    t = t.select(*names, "_t", "_w", "_n", windows.alias("_h"), lines.alias("_l"))
    # Only texts with a repeated window are sorted; equal windows then stand side by side.
    repeated = F.size("_h") > F.size(F.array_distinct("_h"))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    t = t.select(*names, "_t", "_w", "_n", "_l", F.when(repeated, F.sort_array(pairs)).otherwise(nothing).alias("_s"))
    twice = F.transform(
        F.filter(
            F.transform(
                "_s",
                lambda x, k: F.struct(
                    x["i"].alias("i"),
                    (
                        F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))
                    ).alias("d"),
                ),
            ),
            lambda y: y["d"],
        ),
        lambda y: y["i"],
    )
    t = t.select(*names, "_t", "_w", "_n", "_l", F.sort_array(twice).alias("_p"))
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get("_p", k - 1), F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    plain = F.split(F.lower("_t"), r"[\x09-\x0D\x20.,;:!?]+")
    return t.select(
        *names,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _occurrences("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter(plain, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        _occurrences("[A-Z]").alias("n_capitals"),
    ).withColumnRenamed("_key", "doc_id" if "doc_id" not in keep else "_key")


def verdict(thresholds=THRESHOLDS) -> Column:
    """One boolean expression for the whole table of thresholds: true if every ratio is within its bounds."""
    good = F.lit(True)
    for _, ratio, low, high, words in thresholds:
        top, _, below = ratio.partition(" / ")
        value = F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(below).cast("double")), F.lit(0.0)) if below else F.col(top)
        within = F.lit(True)
        if low is not None:
            within = within & (value >= low)
        if high is not None:
            within = within & (value <= high)
        good = good & (within | (F.col("n_words") < words))
    return good


def passing(measured: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of measures() within all thresholds.

    The row number keeps the filter above the counts: pushed below them it would repeat their expressions in itself, and
    those theirs, until the plan no longer fits.
    """
    return measured.withColumn("_row", F.monotonically_increasing_id()).where(verdict(thresholds) & (F.col("_row") >= 0)).drop("_row")


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Every row's counts, base_failed and kept.

    A null text has no words and fails; an empty table gives no rows; repeated rows are judged each; only key and text
    are read, so other columns can't clash. A text's counts cover all of it, however long it is. Spaces are the six
    ASCII ones of common.SPACES; a line without a word is no line.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, key, text).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict(thresholds)).alias("kept"),
    )


def sql(table: str = "documents", thresholds=THRESHOLDS) -> str:
    """The SQL (DuckDB) that gives the rows of quality_rules over a table of doc_id and text."""
    rules = []
    for _, ratio, low, high, words in thresholds:
        top, _, below = ratio.partition(" / ")
        value = f"coalesce({top}::double / nullif({below}, 0), 0.0)" if below else top
        bounds = [f"{value} >= {low}"] * (low is not None) + [f"{value} <= {high}"] * (high is not None)
        rules.append(f"(({' and '.join(bounds)}) or n_words < {words})")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    following = ", ".join(f"lead(word, {k}) over o" for k in range(1, WINDOW))
    return rf"""with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from {table}),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from t),
u as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n from w where len(w) > {WINDOW}),
g as (select r, i, n, concat_ws(' ', word, {following}) as x from u window o as (partition by r order by i)),
h as (select r, i, count(*) over (partition by r, x) as k from g where i <= n - {WINDOW - 1}),
p as (select r, count(distinct i + x) as n from h, range(0, {WINDOW}) as o(x) where k > 1 group by r),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals,
  len(list_filter(string_split_regex(lower(t), '[\x09-\x0D\x20.,;:!?]+'), lambda x: list_contains([{stop}], x)))::bigint as n_stop_words
  from t join w using (r) join l using (r) left join p using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(rules)} as kept from b"""
