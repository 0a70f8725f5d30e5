import random
import zlib

import pandas as pd
from conftest import SF
from odd import documents, empty, plain
from pyspark.sql import functions as F

from topicloom.llm import language_id as li
from topicloom.llm.registry import QUERIES


def test_grams_against_brute_force():
    words = ["a", "straße", "ab", "你好", "x-y"]
    grams, owners = li.word_grams(words)
    want = []
    for k, word in enumerate(words):
        framed = f" {word} "
        for n in li.GRAMS:
            want += [(n, k, framed[j:j + n]) for j in range(len(framed) - n + 1) if framed[j:j + n] != " "]
    assert sorted(owners.tolist()) == sorted(k for _, k, _ in want)
    assert len(set(grams.tolist())) == len({g for _, _, g in want})


def test_filter_holds_every_taught_gram(spark):
    rows = [(k, t) for k, t in enumerate(["der hund und die katze", "the dog and the cat"] * 3)]
    df = documents(spark, rows, clashing=False).withColumn(
        "lang", F.when(F.col("text").startswith("der"), "de").otherwise("en"))
    model = li.learn(df)
    assert model.languages == ["de", "en"]
    for k, text in enumerate(["der hund und die katze", "the dog and the cat"]):
        grams, _ = li.word_grams(text.split())
        assert (model.masks(grams) >> k & 1).all()
    assert (model.false_hits < 0.01).all()
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(df, model).select(
        "doc_id", "lang_pred", li.F.col("score")).collect()}
    assert all(got[k] == (("de", "en")[k % 2], 1.0) for k in got)


def test_held_out_accuracy(spark):
    got = plain(QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01"))
    truth = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]]
    both = got.merge(truth, on="doc_id")
    assert len(both) == len(truth)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_is_no_input_of_a_prediction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = li.learn(li.training_rows(docs))
    a = plain(li.identify(docs, model)).sort_values("doc_id").lang_pred.tolist()
    b = plain(li.identify(docs.withColumn("lang", F.lit("xx")), model)).sort_values("doc_id").lang_pred.tolist()
    assert a == b


def test_small_cache_gives_the_same(spark, monkeypatch):
    model = li.Model(["a", "b"], li.np.zeros(1 << li.SLOT_BITS, li.np.int64), li.np.zeros(2))
    rng = random.Random(1)
    for k in (0, 1):
        for probe in range(li.PROBES):
            model.slots[li.slot_of(li.word_grams([f"word{k}"])[0], probe)] |= 1 << k
    texts = [" ".join(rng.choices(["word0", "word1", "other", "7"], k=9)) for _ in range(40)]
    whole = li._predict_batch(model, texts, {})
    monkeypatch.setattr(li, "CACHE_WORDS", 1)
    cache, names, scores = {}, [], []
    for text in texts:
        n, s = li._predict_batch(model, [text], cache)
        names, scores = names + n, scores + s
    assert (names, scores) == whole


def test_odd_rows(spark):
    df = documents(spark)
    model = li.learn(df)
    got = plain(li.identify(df.select("doc_id", "text"), model))
    assert len(got) == df.count()
    none = got[got.text.isna() | got.text.isin(["", " \t\n ", "12345 67890 !!! ### $$$"])]
    assert set(none.lang_pred) == {"und"} and set(none.score) == {0.0}
    assert li.keep_identified(df, df).columns == df.columns


def test_letters_without_a_known_piece_and_other_models(spark):
    """A text with letters gets a learned language; a worker that has used one model reads another one anew."""
    def learned(rows):
        return li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    one = learned([(1, "aaa bbb", "x"), (2, "ccc ddd eee fff ggg", "y")])
    two = learned([(1, "aaa bbb", "y"), (2, "ccc ddd eee fff ggg", "x")])
    texts = spark.createDataFrame([(1, "aaa"), (2, "ccc"), (3, "字"), (4, "12"), (5, None)], "doc_id long, text string")
    for model, names in ((one, "xyy"), (two, "yxx")) * 3:
        got = {r.doc_id: r for r in li.identify(texts, model).collect()}
        assert [got[k].lang_pred for k in range(1, 6)] == [*names, "und", "und"]
        assert got[3].score == 0.0 and got[1].score > 0.5
    assert one.key != two.key


def test_columns_of_the_same_name_are_replaced(spark):
    df = documents(spark)
    out = li.identify(df, li.learn(df))
    assert sorted(out.columns) == sorted(df.columns) and dict(out.dtypes)["score"] == "double"


def test_nothing_learned_and_empty(spark):
    model = li.learn(empty(spark))
    assert model.languages == []
    assert {r.lang_pred for r in li.identify(documents(spark).select("doc_id", "text"), model).collect()} == {"und"}
    assert li.identify(empty(spark).select("doc_id", "text"), model).count() == 0
