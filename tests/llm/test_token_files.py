import io
import random
import zlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, empty, plain
from tokenizers import Tokenizer

from topicloom.llm import shards
from topicloom.llm import token_files as tf
from topicloom.llm.registry import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=400),
       st.integers(1, 90))
def test_words_round_trip(values, block):
    values = np.array(values, np.uint64)
    words, starts = tf.pack(values, block)
    assert tf.unpack(words).tolist() == values.tolist()
    for k, start in enumerate(starts.tolist()):  # every block by itself
        stop = starts[k + 1] if k + 1 < len(starts) else len(words)
        assert tf.unpack(words[start:stop]).tolist() == values[k * block:(k + 1) * block].tolist()


def test_each_word_takes_as_many_values_as_fit():
    words, _ = tf.pack(np.zeros(60, np.uint64))
    assert len(words) == 1
    words, _ = tf.pack(np.full(60, 40_000, np.uint64))
    assert len(words) == 20
    words, _ = tf.pack(np.array([2**63, 1, 2**60 - 1], np.uint64))
    assert (words >> np.uint64(60)).tolist()[0] == 0 and len(words) == 4


def test_parts_of_a_file():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 3000, 20).tolist()
    ids = rng.integers(0, 49_408, sum(lengths))
    file = tf.TokenFile(io.BytesIO(tf.file_bytes([None, *range(19)], lengths, ids)))
    assert file.doc_ids == [None, *range(19)] and file.lengths.tolist() == lengths
    for a, b in ((0, len(ids)), (5, 5), (4095, 4097), (100, 9000), (len(ids) - 1, len(ids))):
        assert file.ids(a, b).tolist() == ids[a:b].tolist()


def expected(rows):
    tokenizer = Tokenizer.from_str(tf.tokenizer_text())
    data = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
            for i, t in rows]
    data.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    out, start = [], 0
    for i, b in data:
        out.append((i, start, len(b) // 4, zlib.crc32(b)))
        start += len(b) // 4
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows, key=lambda r: r[1])


def test_query_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got(QUERIES["op6_token_binary"](spark, SF)) == expected([tuple(r) for r in docs])


def test_white_space_is_the_librarys():
    """U+001C to U+001F have ids of their own; every other blank only separates."""
    texts = [f"one{c}two {c} three{c}{c}" for c in map(chr, [*range(1, 48), *range(127, 161), 0x1680, 0x180E,
             *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])]
    texts += ["\x1c", "\x1d\x1e a", "a \x1f\x1f", "", " ", "\x85a"]
    tokenizer = Tokenizer.from_str(tf.tokenizer_text())
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    found = tf.Chunks(tf.tokenizer_text()).encode_all(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in found] == want


@pytest.mark.parametrize("file_ids,shard_bytes", [(50, 100), (4_000_000, 1 << 26)])
def test_odd_rows_over_many_files(spark, monkeypatch, file_ids, shard_bytes):
    monkeypatch.setattr(tf, "FILE_IDS", file_ids)
    monkeypatch.setattr(shards, "SHARD_BYTES", shard_bytes)
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    rows += [(40 + k, t) for k, t in enumerate(["<|endoftext|> x<|startoftext|>y", "I'm DON'T a1b22", "é É Größe, ÀÉ! ŒUVRE... İstanbul ΣΑΣ e\u0301a ﬁn _x, it's,",
        "ß ſ ŉ ǅ ǆ ÿ ĸ ª º ² the, the. the!! ,the ..."])]
    folder, manifest = tf.write_tokens(documents(spark, rows))
    assert got(tf.read_tokens(folder, manifest)) == expected(rows)
    if file_ids == 50:
        assert manifest.count() > 3


@pytest.mark.parametrize("ids", [[*range(1, 200), 10**15, -(2**62), 2**63 - 1], [None] * 200, [7] * 150 + [8] * 9],
                         ids=["far", "none", "one"])
def test_any_ids_spread_over_many_tasks(spark, monkeypatch, ids):
    monkeypatch.setattr(shards, "SHARD_BYTES", 400)
    monkeypatch.setattr(shards, "KEY_RANGES", 1024)
    rows = [(i, f"text {k} " + "word " * (k % 20)) for k, i in enumerate(ids)]
    folder, manifest = tf.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    held = {}
    for r in manifest.collect():
        held[r.shard] = held.get(r.shard, 0) + r.records
    assert len(held) > 15 and max(held.values()) < 40
    found = [tuple(r) for r in tf.read_tokens(folder, manifest).collect()]
    found.sort(key=lambda r: r[1])
    assert [r[0] for r in found] == sorted(ids, key=lambda i: (i is not None, i))
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in expected(rows))
    starts = [r[1] for r in found]
    assert starts[0] == 0 and all(b - a == r[2] for a, b, r in zip(starts, starts[1:], found))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_CHUNKS", 2)
    chunks = tf.Chunks(tf.tokenizer_text())
    plain_ids = Tokenizer.from_str(tf.tokenizer_text())
    for text in ["a b c d e", "a b f g", "f g h a", " x  y\tz"]:
        assert np.frombuffer(chunks.encode_all([text])[0], np.uint32).tolist() == plain_ids.encode(
            text, add_special_tokens=False).ids


def test_every_latin_letter(spark):
    chunks, plain_ids = tf.Chunks(tf.tokenizer_text()), Tokenizer.from_str(tf.tokenizer_text())
    letters = [chr(c) for c in range(32, 0x260) if not chr(c).isspace()]
    texts = [f"{c} a{c}b {c}{c}, {c}." for c in letters]
    for text, ids in zip(texts, chunks.encode_all(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == plain_ids.encode(text, add_special_tokens=False).ids, text


def test_empty_table(spark):
    assert plain(tf.read_tokens(*tf.write_tokens(empty(spark)))).empty


@pytest.mark.parametrize("text", ["it's 'Sam (don't)", "<|endoftext|> x<|endoftext|> |endoftext|>", "<startoftext ''ve a'll 's",
                                  '"quoted" $word### \u00c9*** _re_ --x-- [a] {b}~ `c`', "a\u0338 =\u0338 <\u0338"])
def test_marks_around_letters(text):
    chunks = tf.Chunks(tf.tokenizer_text())
    want = chunks.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(chunks.encode_all([text])[0], np.uint32).tolist() == want


def test_marks_behind_words_are_chunks_of_their_own():
    """Words were looked up, encoded and remembered once more for each mark behind them."""
    rng = random.Random(4)
    texts = ["A. b, it's, 1,234. 5! x.. \u0130. \xd7. \xf7; \xe9? \u01c5: don\u2019t. \u7684. \xdf, <s>.", "", None, " . ", "a\x1fb, c."]
    texts += ["".join(rng.choices("aZ9\xe9\xd7\xf7\u0130\xdf.,;:!?'\"<> \n\x1d\u0301\u2019\u01c5\u7684s", k=rng.randint(1, 60)))
              for _ in range(3000)]
    chunks, library = tf.Chunks(tf.tokenizer_text()), Tokenizer.from_str(tf.tokenizer_text())
    for text, ids in zip(texts, chunks.encode_all(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode(text or "", add_special_tokens=False).ids
    chunks = tf.Chunks(tf.tokenizer_text())
    chunks.encode_all(["word word. word, \xfcber \xfcber! 12 12;"])
    assert not {"word.", "word,", "\xfcber!", "12;"} & set(chunks.known)


def test_sliced_and_grouped_texts(monkeypatch):
    monkeypatch.setattr(tf, "GROUP_BYTES", 5)
    texts = tf.pa.array(["cut off", "one, two", None, "", "a\x1cb c", "three four. five", "cut off"])
    want = tf.Chunks(tf.tokenizer_text())
    want = [want.plain(x or "").tobytes() for x in texts.to_pylist()]
    assert tf.Chunks(tf.tokenizer_text()).encode_all(texts[1:6]) == want[1:6]
    assert tf.Chunks(tf.tokenizer_text()).encode_all(texts[:0]) == []
