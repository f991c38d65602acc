"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean column over per-text measures. A sample gives each rule's cost (seconds to
evaluate it) and selectivity (share of rows that it rejects); the rules are ordered by rejection per
cost and become one CASE expression, which Spark evaluates branch by branch and leaves at the first
rejection. A text is kept if no rule rejects it, so the verdict does not depend on the order.

Words are [^\\x20\\x09-\\x0D]+. Arrays that are used more than once are bound with a one-element
transform, so nothing is split or hashed twice and no lambda re-evaluates an outer expression.

Defined results: null and empty text have no words and no lines, all measures are 0, and the rule on
word count rejects them; ties in cost per rejection keep the order in which rules are given; an empty
table leaves the given order; repeated rows are judged alike; further columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def removed(text: Column, chars: str) -> Column:
    """Characters of text that are in chars."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(tokens: Column, k: int = WINDOW) -> Column:
    """Words that lie in a window of k words which occurs at least twice in the text.

    A window is its xxhash64 over the words; only texts with an equal pair of hashes are sorted.
    """

    def covered(hashes: Column) -> Column:
        def neighbours(order: Column) -> Column:
            n = F.size(order)
            at = lambda i: F.get(order, i)["h"]
            mine = F.filter(order, lambda x, i: ((i > 0) & (at(i - 1) == x["h"])) | ((i < n - 1) & (at(i + 1) == x["h"])))
            starts = F.array_sort(F.transform(mine, lambda x: x["p"]))
            return let(starts, lambda s: F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(k), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"]))

        sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(sorted_, neighbours))

    def hashed(w: Column) -> Column:
        n = F.size(w) - k + 1
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n < 2, F.lit(0)).otherwise(let(each, covered))

    return let(tokens, hashed).cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five measures as long columns; the words are split once."""
    t = F.col(f"`{text}`").cast("string")
    made = docs.withColumns(
        {
            "__counts": let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))),
            "word_chars": word_chars(t),
            "n_symbols": removed(t, SYMBOLS),
            "n_dup_lines": duplicate_lines(t),
        }
    )
    return made.withColumns({"n_words": F.col("__counts.n_words"), "n_repeat_words": F.col("__counts.n_repeat_words")}).drop("__counts")


@dataclass(frozen=True)
class Rule:
    """A rule rejects a text where `rejects` holds; null counts as false."""

    name: str
    rejects: Column


def default_rules(text: str = "text", min_words: int = 10, max_repeat: int = 20, max_symbols: int = 10, max_dup_lines: int = 30) -> list[Rule]:
    """Rules over the measures and the text. max_*: percent of words, characters or lines."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    upper, letters = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0))
    return [
        Rule("few_words", F.col("n_words") < min_words),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
        Rule("symbols", 100 * F.col("n_symbols") > max_symbols * F.col("word_chars")),
        Rule("odd_word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > max_dup_lines * lines),
        Rule("mostly_capitals", 2 * upper > letters),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
    ]


@dataclass(frozen=True)
class RuleCost:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = 400, text: str = "text") -> list[RuleCost]:
    """Cost and rejections of each rule over the first sample_rows rows that Spark reads, measured once each.

    The sample decides the order of evaluation only. Cost is that of the rule with the measures it reads.
    """
    sample = docs.limit(sample_rows).select(F.col(f"`{text}`").cast("string").alias(text)).cache()
    try:
        sample.count()
        known = measures(sample, text)
        out = []
        for rule in rules:
            began = time.perf_counter()
            rejected = known.agg(F.count_if(F.coalesce(rule.rejects, F.lit(False))).alias("n")).first()["n"]
            out.append(RuleCost(rule, time.perf_counter() - began, rejected))
        return out
    finally:
        sample.unpersist()


def order(costs: list[RuleCost]) -> list[Rule]:
    """The rules by rejections per second, the most first."""
    return [c.rule for c in sorted(costs, key=lambda c: -c.worth)]


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    chain = F.when(F.coalesce(rules[0].rejects, F.lit(False)), F.lit(rules[0].name))
    for rule in rules[1:]:
        chain = chain.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return chain


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 400, text: str = "text") -> DataFrame:
    """docs with the measures, `rejected_by` (rule that ended the cascade, null if none) and kept."""
    rules = default_rules(text) if rules is None else rules
    ordered = order(estimate(docs, rules, sample_rows, text)) if len(rules) > 1 else rules
    return measures(docs, text).withColumn("rejected_by", first_rejection(ordered)).withColumn("kept", F.col("rejected_by").isNull())


#: The same measures and verdict as DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS lines
  FROM d
), p AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: {'i': i, 'g': words[i:i+4]})) AS x FROM w WHERE len(words) >= 5
), r AS (
  SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS n FROM p
), c AS (
  SELECT doc_id, sum(least(5, nxt - i)) AS n_repeat_words
  FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 5) AS nxt FROM r WHERE n > 1)
  GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 2 * upper > letters OR 2 * letters < word_chars) AS kept
FROM m
"""
