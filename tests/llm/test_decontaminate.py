import itertools
import random

import pytest
from conftest import SF
from odd import documents, empty, plain
from pyspark.sql import types as T

from topicloom.llm import decontaminate as dc
from topicloom.llm.registry import QUERIES

SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("overlaps", T.StringType())])


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "?") for r in rows], SCHEMA)


def brute(text, item):
    """Whether some window of the item agrees with the text in enough places, on any diagonal."""
    words, own = dc.words_of(text), dc.words_of(item)
    least = dc.MIN_MATCH_PERCENT if len(own) >= dc.MIN_ITEM_WORDS else 100
    if not own:
        return False
    width = min(dc.WINDOW, len(own))
    for d in range(-len(own), len(words)):
        for q in range(len(own) - width + 1):
            if 0 <= q + d and q + d + width <= len(words):
                same = sum(words[q + d + j] == own[q + j] for j in range(width))
                if 100 * same >= least * width:
                    return True
    return False


def found(spark, docs, items):
    rows = dc.mark(documents(spark, docs), items_of(spark, items), into="hits").collect()
    return {(r.doc_id, x.item_id) for r in rows for x in r.hits}


def test_passages_with_substitutions(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([8, 16, 40])))) for k in range(20)]
    docs = []
    for k in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        if k % 3:
            passage = items[rng.randrange(20)][1].split()
            for _ in range(rng.choice([0, 1, 2, 3, len(passage) // 6])):
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in passage]
        docs.append((k, " ".join(words)))
    got = found(spark, docs, items)
    want = {(i, j) for i, t in docs for j, x in items if brute(t, x)}
    assert got == want and len(want) > 50


def test_short_items_and_scripts_without_blanks():
    items = [(1, "我们昨天去了北京的大学"), (2, "two words"), (3, "สวัสดีครับ"), (4, "one, two three four five"), (5, "字")]
    block = dc.build_block([(i, dc.WordCache().hashes(dc.words_of(t))) for i, t in items])
    texts = ["x 我们昨天去了北京的大学 y", "我们昨天去了上海的大学", "two  words", "two other words", "A TWO words.", "สวัสดีครับ!",
             "one two three four five", "one two three four", "one two three for five", "字", "", None, "a字b 我们"]
    for text in texts:
        got = {x[0] for x in dc.overlaps(text, block, dc.WordCache())}
        assert got == {i for i, t in items if brute(text, t)}, text


def test_texts_that_repeat_themselves():
    rng = random.Random(3)
    for period in (1, 2, 3, 7):
        cycle = [f"n{k}" for k in range(period)]
        items = [(1, " ".join((cycle * 90)[:90])), (2, " ".join((cycle * 9)[:9] + rng.choices("abc", k=20)))]
        block = dc.build_block([(i, dc.WordCache().hashes(dc.words_of(t))) for i, t in items])
        text = " ".join((cycle * 700)[:700] + ["other"] * 5 + (cycle * 40)[:40])
        hashes = dc.WordCache().hashes(dc.words_of(text))
        fast = set(map(tuple, dc._hits(hashes, block)))
        saved, dc.FEW_PAIRS = dc.FEW_PAIRS, 10**12
        assert fast == set(map(tuple, dc._hits(hashes, block)))
        dc.FEW_PAIRS = 3
        assert fast == set(map(tuple, dc._hits(hashes, block)))
        dc.FEW_PAIRS = saved
        assert {x[0] for x in dc.overlaps(text, block, dc.WordCache())} == {i for i, t in items if brute(text, t)}
    long = dc.WordCache().hashes([b"na"] * 20_000)
    block = dc.build_block([(1, long[:500])])
    assert len(dc._hits(long, block)) == 20_000 + 500 - 1 - 4 - 4


def test_masks_meet_every_window_that_agrees_enough():
    for width in range(dc.MIN_ITEM_WORDS, dc.WINDOW + 1):
        most = width * (100 - dc.MIN_MATCH_PERCENT) // 100
        for wrong in itertools.combinations(range(width), most):
            assert any(not any(mask[w - t] == "1" for w in wrong if 0 <= w - t < len(mask))
                       for mask in dc.MASKS for t in range(width - len(mask) + 1)), (width, wrong)


def test_place_is_reported(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = dc.mark(documents(spark, [(1, f"a b. C {text} d")]), items_of(spark, [(9, text), (11, text)]),
                   into="hits").collect()
    assert [tuple(x) for x in rows[0].hits] == [(9, 3, 12, 12)]


def test_test_set_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 12)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(10))) for k in range(5)]
    docs = [(k, f"x {t} y") for k, t in items]
    assert len(list(dc.blocks(items_of(spark, items)))) == 3
    assert found(spark, docs, items) == {(k, k) for k, _ in items}


def test_odd_items_and_rows(spark):
    items = [(1, None), (2, ""), (3, "too short"), (6, "..."), (None, "quick brown fox jumps over the lazy dog"),
             (4, "quick brown fox jumps over the lazy dog"), (5, "quick brown fox jumps over the lazy dog")]
    df = documents(spark)
    rows = dc.mark(df, items_of(spark, items), into="hits")
    assert rows.columns == [*df.columns, "hits"] and rows.count() == df.count()
    assert {(r.doc_id, x.item_id) for r in rows.collect() for x in r.hits} == {(1, 4), (7, 4)}
    kept = dc.keep_clean(df, items_of(spark, items))
    assert kept.columns == df.columns and kept.count() == df.count() - 3
    assert dc.keep_clean(df, items_of(spark, [])).count() == df.count()
    assert dc.keep_clean(empty(spark), items_of(spark, items)).count() == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_finds_every_verbatim_item(spark, sf):
    got = plain(QUERIES["op9_benchmark_decontamination"](spark, sf))
    docs = plain(spark.read.parquet(f"{sf}/documents.parquet"))
    items = plain(spark.read.parquet(f"{sf}/benchmark.parquet"))
    whole = [(i, b" " + b" ".join(dc.alnum_words(t)) + b" ") for i, t in zip(docs.doc_id, docs.text)]
    want = {(i, j) for j, t in zip(items.item_id, items.text) for i, w in whole
            if b" " + b" ".join(dc.alnum_words(t)) + b" " in w}
    assert want <= {(i, j) for i, ids in zip(got.doc_id, got.item_ids) for j in ids}
    assert len(got) == len(docs) and (got.contaminated == got.item_ids.map(len).gt(0)).all()
