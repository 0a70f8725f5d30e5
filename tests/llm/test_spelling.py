"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import odd
import pytest

from topicloom.llm import spelling as sp


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + 1:] == b[same + 1:] if len(a) == len(b) else a[same:] == b[same + 1:]


def groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        form[word] = best if best and counts[best] >= 2 * counts[word] else None

    def root(word):
        while form[word]:
            word = form[word]
        return word

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def run(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = sp.spelling_groups(words)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice("abñÿ×") for _ in range(rng.randint(5, 8)))
        for _ in range(rng.randint(1, 6)):
            counts[word] = rng.choice([3, 6, 12, 100, 2**40])
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", "a", "ÿ"]) + word[at + rng.randint(0, 1):]
            word = word if len(word) > 4 else word + "abcde"
    assert run(spark, counts) == groups(counts)


def test_hot_nodes_ties_and_long_words(spark):
    counts = {"aaaaa" + c: 5 for c in "abcdefghijklmnopqrstuvwxyz"} | {"aaaaa": 10, "aaaaaaa": 10}
    long = "x" * 40 + "".join(random.Random(1).choice("ab") for _ in range(3000))
    counts |= {long: 9, long[:-1]: 4, long[1:]: 4, long + "a": 4, long + "b": 3, "y" + long: 3,
               long[:35] + "q" + long[35:]: 3, long[:1500] + "q" + long[1501:]: 8}
    assert run(spark, counts) == groups(counts)


def test_no_words(spark):
    assert run(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]
    assert sp.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_words_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sp, "HELD_WORDS", 50)
    rng = random.Random(5)
    rows = odd.TEXTS + [(i, " ".join("".join(rng.choice("abÀÿÉeĀ") for _ in range(7)) for _ in range(60)) + " "
                         + "word’Größe×÷ naïve " * 20) for i in range(40)]
    counted = sp.word_counts(odd.documents(spark, rows), sp.planted)
    assert dict(map(tuple, counted.collect())) == words_of(rows)
    assert any(h for h in words_of(rows) if len(h) == 6)
    assert sp.word_counts(odd.empty(spark)).count() == 0


def test_every_level_is_a_join_with_the_edges(spark):
    words = spark.createDataFrame([("abcdefg",), ("abcdeff",), ("abcdef",), ("xbcdefg",)], "word string")
    edges, states = sp.trie(words)
    assert edges.where("ends IS NULL AND child IS NULL").count() == 0
    assert {r["word"] for r in states.collect()} == {"abcdefg", "abcdeff", "abcdef", "xbcdefg"}
    moved = sp._moves(states, edges).where("near IS NOT NULL").select("word", "near").distinct().collect()
    assert {tuple(r) for r in moved} <= {(a, b) for a in ("abcdefg", "abcdeff", "abcdef", "xbcdefg")
                                         for b in ("abcdefg", "abcdeff", "abcdef", "xbcdefg") if one_edit(a, b)}
