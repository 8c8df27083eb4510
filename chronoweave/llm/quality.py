"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a test over measures of the text. Its cost (seconds a row) and its selectivity (share of rows it rejects)
are measured on a sample of at most ``SAMPLE_ROWS`` rows; rules then stand in one CASE by rejection per cost, so most bad
rows are rejected by the cheapest test that can do it and dearer measures are not worked out for them. The order changes
the time and which rule is named, never which rows are kept.

Repeated word windows are found without a shuffle and without comparing windows in pairs: words are hashed once (64 bits),
windows of 2, 4 and 8 hashes are built by zipping the array with itself, and only texts in which two windows are equal sort
(window, place) to count the words they cover.

Defined results: a null text counts as empty, has no words and is rejected; a null id or null in another column changes
nothing; repeated rows give repeated results; an empty table gives an empty result; input columns may have any names,
measures are only added under the names asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.text import table
from chronoweave.session import cut_lineage

#: Rows on which costs and rejections of the rules are measured; the rules themselves see every row.
SAMPLE_ROWS = 256
WINDOW = 8


def words(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _paired(hashes: Column, shift: int) -> Column:
    """Hash of each item with the one ``shift`` places on; the tail, short of a partner, is cut off by the caller."""
    rest = F.slice(hashes, F.lit(shift + 1), F.greatest(F.size(hashes) - shift, F.lit(0)))
    return F.zip_with(hashes, rest, lambda left, right: F.xxhash64(left, right))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def windows(held: Column) -> Column:
    """Hashes of all windows of eight words; none for fewer words."""
    eight = _paired(_paired(_paired(F.transform(held, lambda word: F.xxhash64(word)), 1), 2), 4)
    return F.when(F.size(held) >= WINDOW, F.slice(eight, F.lit(1), F.greatest(F.size(held) - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _covered(found: Column) -> Column:
    """Words within the windows that occur twice or more."""

    def of_sorted(placed: Column) -> Column:
        twice = F.filter(placed, lambda item, i: (F.get(placed, i - 1)["h"] == item["h"]) | (F.get(placed, i + 1)["h"] == item["h"]))
        return _bound(F.sort_array(twice["p"]), lambda at: F.aggregate(
            F.zip_with(at, F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), lambda here, following: F.least(F.coalesce(following - here, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("long"), lambda total, step: total + step))

    return _bound(F.sort_array(F.transform(found, lambda h, p: F.struct(h.alias("h"), p.alias("p")))), of_sorted)


def repeat_words(held: Column) -> Column:
    """Words in windows of eight that are found twice or more in the text, the first included."""
    return _bound(windows(held), lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), _covered(found)).otherwise(F.lit(0).cast("long")))


def _lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


#: Measures over (text, words), all long.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, held: F.size(held).cast("long"),
    "word_chars": lambda text, held: F.char_length(F.array_join(held, "")).cast("long"),
    "n_symbols": lambda text, held: F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
    "n_lines": lambda text, held: F.size(_lines(text)).cast("long"),
    "n_dup_lines": lambda text, held: _bound(_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")),
    "n_repeat_words": lambda text, held: repeat_words(held),
    "n_capitals": lambda text, held: F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """Rows for which ``rejects`` holds are rejected; it gets a function from measure name to column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: The two rules of the contract.
BASE = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
#: The method's own: set wide, so that only plainly broken text goes.
OWN = (
    Rule("symbols", lambda m: 2 * m("n_symbols") > m("n_words")),
    Rule("capitals", lambda m: 2 * m("n_capitals") > m("word_chars")),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 40 * m("n_words"))),
)
RULES = BASE + OWN


def measured(text: Column, held: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text, held)


def _needs(rule: Rule) -> set[str]:
    """The measures that a rule asks for."""
    asked = set()
    rule.rejects(lambda name: asked.add(name) or F.lit(0))
    return asked


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both measured on at most ``rows`` rows of ``docs``; ties keep the given order."""
    # taking rows reads partitions only until there are enough; a written limit would read some rows of each of them
    taken = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).take(rows)
    sample = cut_lineage(docs.sparkSession.createDataFrame(taken, "t string"))
    worth = {}
    for again in (False, True):  # the first pass compiles code
        for rule in rules:
            began = time.perf_counter()
            held = sample.select("t", words(F.col("t")).alias("w")).select(rule.rejects(measured(F.col("t"), F.col("w"))).alias("bad"))
            seen = held.agg(F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("n")).first()
            if again:
                worth[rule.name] = (seen["bad"] / max(seen["n"], 1)) / (time.perf_counter() - began)
    return sorted(rules, key=lambda rule: -worth[rule.name])


def cascade(m: Callable[[str], Column], rules: list[Rule]) -> Column:
    """Name of the first rule, in the given order, that rejects the row; null for rows to keep."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects(m), F.lit(False)), rule.name)
    return verdict.otherwise(None)


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns."""
    order = rule_order(docs, rules, text)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.filter(_bound(words(body), lambda held: F.coalesce(cascade(measured(body, held), order), F.lit("")) == ""))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's measures of all documents and the cascade's verdict.

    Measures that are returned are columns anyway, so rules on them cost nothing more and stand first in the cascade; those that
    only the method's own rules need are worked out within it, for rows that no earlier rule rejects.
    """
    docs = table(spark, sf_dir, "documents")
    order = rule_order(docs)
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    held = body.withColumn("_w", words(F.col("_t")))
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    m = measured(F.col("_t"), F.col("_w"))
    known = held.select("doc_id", "_t", *[m(name).alias(name) for name in shown])
    free = [rule for rule in order if _needs(rule) <= set(shown)]
    ranked = free + [rule for rule in order if rule not in free]
    verdict = cascade(lambda name: F.col(name) if name in shown else MEASURES[name](F.col("_t"), F.array()), ranked)
    base = F.coalesce(BASE[0].rejects(F.col) | BASE[1].rejects(F.col), F.lit(False))
    return known.select("doc_id", *shown, base.alias("base_failed"), (~base & verdict.isNull()).alias("kept"))


OP10_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM t),
g AS (SELECT r, i AS p, list_slice(w, i, i + 7) AS g FROM w, unnest(range(1, len(w) - 6)) AS u(i)),
d AS (SELECT r, p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(coalesce(following - p, 8), 8))::BIGINT AS n FROM (SELECT *, lead(p) OVER (PARTITION BY r ORDER BY p) AS following FROM d) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{Lu}')) AS n_capitals
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 2 * n_symbols > n_words OR 2 * n_capitals > word_chars OR 2 * n_dup_lines > n_lines
       OR word_chars < 2 * n_words OR word_chars > 40 * n_words) AS kept
FROM m
"""
