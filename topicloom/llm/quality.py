"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a Column over the text that is true where the document is to be rejected. On a bounded
sample each rule is timed and its rejections are counted; the rules then run in the order of rejections
per cost, and a document stops at the first rule that rejects it. The order decides the work, never the
verdict: a document is kept when no rule rejects it.

Defined cases: a null text counts as empty and is rejected (``few_words``); repeated rows get the same
verdict; ties in the order fall to the name; an empty table gives the default order and no rows; other
columns pass through untouched, and the column added is renamed by ``into`` if its name is taken.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import BLANK, table
from topicloom.llm.registry import query
from topicloom.session import materialize

SAMPLE_ROWS = 1000  # rows on which cost and selectivity are estimated
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_DUP_LINE_PERCENT = 50
MAX_STUTTER_PERCENT = 30
MAX_SYMBOL_PERCENT = 10
MAX_SHOUT_PERCENT = 10
MAX_UPPER_PERCENT = 50
WORD_LENGTHS = (2, 20)
BOILERPLATE = "lorem ipsum"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(plain_text(text), f"[{BLANK}]+"), lambda w: w != "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbols_in(text: Column) -> Column:
    return F.regexp_count(plain_text(text), F.lit("[#*$%&|<>]")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(plain_text(text), "\n"), lambda x: x.rlike(f"[^{BLANK}]"))


def repeats_of(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def stutters_in(words: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))


def _covered(hashes: Column, window: int) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s):
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"])
                         | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return let(numbered, lambda s: F.aggregate(
        starts(s), zero,
        lambda a, i: F.struct((i + window).alias("end"),
                              (a["n"] + i + window - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"])).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more; documents without one leave early."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1),
                         lambda i: F.xxhash64(F.slice(words, i, window)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h),
                                         _covered(h, window)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > window, found).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is built from the text and its words, and is evaluated only when reached."""

    name: str
    rejects: object

    def column(self, text: Column, words: Column) -> Column:
        return F.coalesce(self.rejects(text, words), F.lit(False))


def _over(part: Column, percent: int, whole: Column) -> Column:
    return part * 100 > whole * percent


def _letters(text: Column, pattern: str) -> Column:
    return F.regexp_count(plain_text(text), F.lit(pattern))


BASE_RULES = (
    Rule("few_words", lambda t, w: F.size(w) < MIN_WORDS),
    Rule("repeated_words", lambda t, w: _over(repeated_words(w), MAX_REPEAT_PERCENT, F.size(w))),
)
METHOD_RULES = (
    Rule("symbols", lambda t, w: _over(symbols_in(t), MAX_SYMBOL_PERCENT, F.size(w))),
    Rule("shouting", lambda t, w: _over(_letters(t, "!"), MAX_SHOUT_PERCENT, F.size(w))),
    Rule("upper_case", lambda t, w: _over(_letters(t, r"\p{Lu}"), MAX_UPPER_PERCENT,
                                          _letters(t, r"\p{L}"))),
    Rule("no_letters", lambda t, w: ~plain_text(t).rlike(r"\p{L}")),
    Rule("word_length", lambda t, w: ~F.length(F.array_join(w, "")).between(
        WORD_LENGTHS[0] * F.size(w), WORD_LENGTHS[1] * F.size(w))),
    Rule("repeated_lines", lambda t, w: let(lines_with_words(t), lambda x: _over(
        repeats_of(x), MAX_DUP_LINE_PERCENT, F.size(x)))),
    Rule("stutter", lambda t, w: _over(stutters_in(w), MAX_STUTTER_PERCENT, F.size(w))),
    Rule("filler", lambda t, w: F.contains(F.lower(plain_text(t)), F.lit(BOILERPLATE))),
)


def estimate(docs: DataFrame, rules: Sequence[Rule], text: str = "text",
             sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) on at most ``sample_rows`` rows."""
    sample = materialize(docs.select(F.col(text).cast("string").alias("text")).limit(sample_rows),
                         "quality-sample").select("text", words_of(F.col("text")).alias("words"))

    def timed(*what: Column) -> tuple[float, object]:
        start = time.perf_counter()
        row = sample.agg(F.count("*"), *what).first()
        return time.perf_counter() - start, row

    idle = F.sum(F.size("words"))
    timed(idle)
    base, row = timed(idle)
    total, found = max(1, row[0]), []
    for rule in rules:
        rejected = F.count_if(rule.column(F.col("text"), F.col("words")))
        seconds, row = timed(idle, rejected)
        found.append((rule.name, max(seconds - base, 1e-3), row[2] / total))
    return found


def ordered(docs: DataFrame, rules: Sequence[Rule], text: str = "text",
            sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per cost, best first."""
    measured = {n: share / cost for n, cost, share in estimate(docs, rules, text, sample_rows)}
    return sorted(rules, key=lambda r: (-measured[r.name], r.name))


def first_rejection(text: Column, words: Column, rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.column(text, words), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + METHOD_RULES, text: str = "text",
          into: str = "rejected_by", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows with the rule that rejects them (null: kept)."""
    order = ordered(docs, rules, text, sample_rows)
    return docs.withColumn(into, let(words_of(docs[text]), lambda w: first_rejection(
        docs[text], w, order)))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    mark = "__rejected_by"
    return judge(docs, into=mark, **options).filter(F.col(mark).isNull()).drop(mark)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], chr(10)) AS h
        FROM w, unnest(range(1, len(words) - 6)) AS u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) AS r(k) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(text, '!')) AS shouts, len(regexp_extract_all(text, '\p{Lu}')) AS uppers,
        len(regexp_extract_all(text, '\p{L}')) AS letters, contains(lower(text), 'lorem ipsum') AS filler,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS stutters
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * shouts > 10 * n_words
    OR 100 * uppers > 50 * letters OR letters = 0 OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words)
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * stutters > 30 * n_words OR filler) AS kept
FROM b
"""


@query("op1_quality_rules", ORACLE)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five measures and both verdicts for every document.

    ``base_failed`` needs its two measures for all rows; the cascade of the other rules runs only
    where it is false.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = ordered(docs, METHOD_RULES)
    text, words = F.col("text"), F.col("words")
    lines = lines_with_words(text)
    measured = docs.withColumn("words", words_of(text)).select(
        "doc_id", "text", "words", F.size(words).cast("long").alias("n_words"),
        word_chars(words).alias("word_chars"), symbols_in(text).alias("n_symbols"),
        let(lines, repeats_of).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"))
    failed = ((F.col("n_words") < MIN_WORDS)
              | _over(F.col("n_repeat_words"), MAX_REPEAT_PERCENT, F.col("n_words")))
    judged = measured.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False))
        .otherwise(first_rejection(text, words, order).isNull()))
    return judged.drop("text", "words")
