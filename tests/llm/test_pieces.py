import random

import numpy as np

import pytest
import sentencepiece
from conftest import SF
from odd import TEXTS, documents, empty, plain

from topicloom.llm import pieces
from topicloom.llm.registry import QUERIES


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.model_bytes())


ODD = ["", " ", "   ", "a", " a  b ", "a\nb\t c", "▁x ▁▁ y", "\x00 \x01", "é́ ﬁ Ａ", "<s> hi</s> <0x0A>",
       "a" * 300, "=" * 200, "你好吗 한국어 ไทย", "http://www.example.com/x?y=1&z=2", "def f(x):\n        return x"]


def test_ids_are_the_librarys(spark, library, vocabulary):
    texts = ODD + [t for _, t in TEXTS if t] + [r.text for r in spark.read.parquet(
        f"{SF}/documents.parquet").limit(200).collect()]
    for text in texts:
        assert vocabulary.encode(text) == library.encode(text), text[:60]


def test_random_strings(library, vocabulary):
    rng = random.Random(4)
    alphabet = "aabcdeethinor   .,\n-ßé你▁0"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    assert [x.tolist() for x in vocabulary.encode_all(texts)] == [library.encode(t) for t in texts]


def test_round_trip(vocabulary):
    for text in ODD + [t for _, t in TEXTS if t]:
        assert vocabulary.decode(vocabulary.encode(text)) == text.replace("▁", " ")


def test_log_probabilities_take_the_best_sum(vocabulary):
    """With scores that are no ranks the way with the highest sum wins."""
    model = pieces.Pieces(pieces.model_bytes())
    model.merges, model.known = False, {}
    rng = random.Random(2)
    for k in model.ids.values():
        model.weights[k] = -rng.random() * 9 - 1
    for word in ("▁the", "▁international", "▁aaaa", "▁nation"):
        best = {0: (0.0, ())}
        for end in range(1, len(word) + 1):
            ways = [(best[s][0] + model.weights[model.ids[word[s:end]]], best[s][1] + (model.ids[word[s:end]],))
                    for s in range(end) if word[s:end] in model.ids and s in best]
            if ways:
                best[end] = max(ways)
        got = model.viterbi([word])[0]
        assert sum(model.weights[k] for k in pieces.np.frombuffer(got, pieces.np.int32)) == pytest.approx(
            best[len(word)][0])


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_SEGMENTS", 3)
    monkeypatch.setattr(pieces, "KNOWN_PAIRS", 3)
    monkeypatch.setattr(pieces, "PORTION_CHARS", 10)
    model = pieces.Pieces(pieces.model_bytes())
    for text in ODD:
        assert model.encode(text) == library.encode(text)


def test_query_and_odd_rows(spark, library):
    got = plain(QUERIES["op2_sentencepiece"](spark, SF))
    assert got.round_trip.all() and (got.n_pieces == got.piece_ids.map(len)).all()
    df = documents(spark)
    rows = pieces.encode_and_check(df).collect()
    assert len(rows) == df.count() and all(r.round_trip for r in rows)
    ids = {r.doc_id: r.piece_ids for r in rows if r.doc_id is not None}
    assert ids[2] == [] and ids[3] == [] and ids[6] == library.encode(dict(TEXTS)[6])
    assert pieces.encode_and_check(empty(spark)).count() == 0
    assert pieces.add_ids(df, into="ids").columns.count("ids") == 1


def test_a_text_without_blanks_takes_memory_for_its_pieces_only():
    """A long blank-free text beside many new words: what is held follows the pieces, not words times length."""
    import tracemalloc

    coder = pieces.Pieces(pieces.model_bytes())
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(5000)]
    long = "".join(map(chr, rng.integers(97, 123, 20_000)))
    tracemalloc.start()
    ids = coder.encode_all([" ".join(words), long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert coder.decode(ids[1].tolist()) == long


def merged(vocabulary, text):
    """Merging by rank, written plainly: best neighbours first, leftmost of equals."""
    parts = list(text)
    while True:
        ranks = [vocabulary.scores[vocabulary.ids[x + y]] if x + y in vocabulary.ids else None
                 for x, y in zip(parts, parts[1:])]
        known = [x for x in ranks if x is not None]
        if not known:
            return parts
        at = ranks.index(max(known))
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


@pytest.mark.parametrize("levels", [None, 3, 50])
def test_pieces_stay_separate_as_when_merged(levels):
    rng, vocabulary = random.Random(levels), pieces.Pieces(pieces.model_bytes())
    if levels:  # many equal ranks
        vocabulary.scores = [float(rng.randrange(levels)) for _ in vocabulary.scores]
        vocabulary.ranks = {name: vocabulary.scores[k] for name, k in vocabulary.ids.items()}
    names, known = vocabulary.names, list(vocabulary.ids.values())
    pairs = [rng.choices(known, k=2) for _ in range(3000)]
    # Cuts within pieces are pairs that do merge, or nearly.
    pairs += [(vocabulary.ids[x], vocabulary.ids[y]) for k in rng.sample(known, 3000) for cut in range(1, len(names[k]))
              if (x := names[k][:cut]) in vocabulary.ids and (y := names[k][cut:]) in vocabulary.ids]
    found = {(a, b): vocabulary.stays_separate(a << 32 | b) for a, b in pairs}
    assert found == {(a, b): merged(vocabulary, names[a] + names[b]) == [names[a], names[b]] for a, b in pairs}
    assert any(found.values()) and not all(found.values())
    for k, (lasts, firsts) in ((k, v) for k, v in vocabulary.made.items() if v):
        assert len(lasts) == len(firsts) == len(names[k])  # a merge a character but one, and the end


def test_each_text_is_encoded_once_for_ids_and_text(spark):
    df = documents(spark)
    both = pieces.add_ids_and_text(df)
    plan = pieces.encode_and_check(df)._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan
    apart = pieces.add_text(pieces.add_ids(df))
    assert both.schema == apart.schema
    assert sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [354, 355])], "doc_id int, piece_ids array<int>")
    got = {r.doc_id: r.decoded for r in pieces.add_text(rows).collect()}
    assert got == {1: "", 2: "", 3: pieces.Pieces(pieces.model_bytes()).decode([354, 355])}


def test_remembering_less_takes_less_memory_and_changes_nothing(library):
    """The last stage of the pipeline was stopped for its memory."""
    import tracemalloc

    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(30_000)]
    texts = [" ".join(words[k:k + 100]) for k in range(0, len(words), 100)]
    peaks, found = [], []
    for remember in (None, 2000):
        coder = pieces.Pieces(pieces.model_bytes(), remember)
        tracemalloc.start()
        found.append([x.tolist() for x in coder.encode_all(texts)])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert found[0] == found[1] == [library.encode(t) for t in texts]
    assert peaks[1] < peaks[0] / 2
