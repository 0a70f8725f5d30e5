import re

import pytest
from compare import check, connect
from conftest import SF
from odd import documents, empty, plain
from pyspark.sql import functions as F

from topicloom.llm import quality
from topicloom.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k:k + 8]), []).append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def test_measures_against_brute_force(spark):
    repeated = "a b c d e f g h i a b c d e f g h x y z " * 3
    rows = [(1, repeated), (2, "a " * 100), (3, "one\none\n\n \none two"), (4, "|a| <b> ## $ % & *"),
            (5, None), (6, "  nbsp is a letter here"), (7, "p q r s t u v w p q r s t u v w")]
    df = documents(spark, rows).select("doc_id", "text")
    words = quality.words_of(F.col("text"))
    got = df.select("doc_id", F.size(words), quality.word_chars(words), quality.symbols_in(F.col("text")),
                    quality.let(quality.lines_with_words(F.col("text")), quality.repeats_of),
                    quality.repeated_words(words)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in rows}


def test_query_agrees_with_sql(spark):
    name = "op1_quality_rules"
    assert check(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("order", [1, -1])
def test_order_does_not_change_the_verdict(spark, order):
    rules = list(quality.BASE_RULES + quality.METHOD_RULES)[::order]
    df = documents(spark)
    text = F.col("text")
    verdict = quality.let(quality.words_of(text), lambda w: quality.first_rejection(text, w, rules))
    kept = {(r.doc_id, r.text) for r in df.filter(verdict.isNull()).collect()}
    assert kept == {(r.doc_id, r.text) for r in quality.keep_good(df).collect()}
    assert {i for i, _ in kept} == {1, 7}


def test_cheap_and_rejecting_rules_come_first(spark, monkeypatch):
    found = [("few_words", 1.0, 0.5), ("repeated_words", 10.0, 0.5), ("symbols", 1.0, 0.0)]
    monkeypatch.setattr(quality, "estimate", lambda *a: found)
    rules = [r for r in quality.BASE_RULES + quality.METHOD_RULES if r.name in {f[0] for f in found}]
    assert [r.name for r in quality.ordered(None, rules)] == ["few_words", "repeated_words", "symbols"]


def test_odd_rows_and_columns(spark):
    df = documents(spark)
    judged = plain(quality.judge(df, into="why"))
    assert len(judged) == df.count() and list(judged.columns) == [*df.columns, "why"]
    assert set(judged[judged.text.isna()].why) == {"few_words"}
    assert quality.keep_good(df).columns == df.columns


def test_empty_table(spark):
    assert quality.judge(empty(spark), into="why").count() == 0
    assert quality.keep_good(empty(spark)).columns == empty(spark).columns
