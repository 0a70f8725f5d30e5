"""Periodic runs against comparing words at every distance."""

import hashlib
import random
import zlib

import numpy as np
import odd
import pytest

from conftest import SF
from topicloom.llm import periodic_runs as pr
from topicloom.llm import recompression as rc
from topicloom.llm.common import mixed, table
from topicloom.llm.queries import QUERIES


def brute(words):
    """[start, length, period] of all runs, by start, then period."""
    found = {}
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.empty(0, int)
    for q in range(1, len(ids) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]])))
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start + q >= max(12, 2 * q):
                found.setdefault((start, end - start + q), q)
    return [[s, n, q] for q, s, n in sorted(((q, s, n) for (s, n), q in found.items()), key=lambda r: (r[1], r[0]))]


def texts(seed):
    rng = random.Random(seed)
    for _ in range(rng.randint(1, 8)):
        size, kinds = rng.choice([0, 1, 5, 12, 30, 80, 200]), rng.choice([1, 2, 3, 8, 60])
        words = [str(rng.randrange(kinds)) for _ in range(size)]
        if size > 4 and rng.random() < 0.7:
            a = rng.randrange(size)
            p = 1 + (size - a) // rng.randint(1, 9)
            words = words[:a] + [words[a + i % p] for i in range(size - a)]
            if rng.random() < 0.5:
                words[rng.randrange(size)] = "other"
        yield words


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(monkeypatch, seed):
    monkeypatch.setattr(pr, "CHUNK_PLACES", 50)
    some = list(texts(seed))
    assert [r.tolist() for r in pr.portion_runs(some)] == [brute(w) for w in some]


def test_grammar_matches_are_exact():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 2, 400)
    symbols[100:160] = symbols[20:80]
    fence = np.zeros(400, bool)
    fence[[0, 200, 399]] = True
    symbols[fence] = [-1, -2, -3]
    levels = rc.grammar(mixed(symbols.view(np.uint64)), fence)
    assert len(levels[-1].symbols) == 5
    a, b = np.triu_indices(398, 1)
    a, b = a + 1, b + 1
    keep = ~fence[a] & ~fence[b]
    a, b = a[keep], b[keep]
    for forward, turn in ((True, 1), (False, -1)):
        got = rc.extensions(levels, a, b, forward)
        for x, y, n in list(zip(a.tolist(), b.tolist(), got.tolist()))[::23]:
            want = 0
            while symbols[x + turn * want] == symbols[y + turn * want]:
                want += 1
            assert n == want


def test_joined_symbols_are_noticed(monkeypatch):
    """A grammar that takes two different words for one is not believed."""
    real = pr.grammar

    def wrong(ids, fence, seed):
        ids = ids.copy()
        if seed == 0:
            ids[19] = ids[17]
        return real(ids, fence, seed)

    monkeypatch.setattr(pr, "grammar", wrong)
    words = list("ababababababababab") + ["x"] + list("cdcdcdcdcdcdcdcd")
    assert pr.portion_runs([words])[0].tolist() == brute(words)


def test_long_texts_stay_fast():
    for words in (["na"] * 60_000, [f"w{i % 7}" for i in range(60_000)]):
        assert len(pr.portion_runs([words])[0]) == 1


def digest(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def by_text(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    docs = [r for r in docs if r[1] is None or len(r[1]) < 40_000]
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert sum(r[1] for r in got.values()) > 10
    assert [got[i] for i, _ in docs] == [digest(i, t) for i, t in docs]


def test_odd_rows_and_portions(spark, monkeypatch):
    monkeypatch.setattr(pr, "PORTION_WORDS", 7)
    rows = [r for r in odd.TEXTS if r[1] != odd.LONG] + [(9, "a b " * 30), (9, "a b " * 30), (10, "x\x1cy z \x00" * 20)]
    docs = odd.documents(spark, rows).select("doc_id", "text")
    got = docs.mapInArrow(pr._digests, pr.DIGEST_DDL).collect()
    assert by_text(map(tuple, got)) == by_text(digest(i, t) for i, t in rows)
    assert odd.empty(spark).select("doc_id", "text").mapInArrow(pr._digests, pr.DIGEST_DDL).count() == 0


def test_add_runs_keeps_columns_and_refuses_to_replace(spark):
    docs = odd.documents(spark, [(1, "a b " * 30), (2, None), (3, odd.LONG), (None, "c")])
    out = pr.add_runs(docs, into="short").collect()
    assert [r["doc_id"] for r in out] == [1, 2, 3, None]
    assert out[0]["short"] == "a b" and [tuple(x) for x in out[0]["runs"]] == [(0, 60, 2)]
    assert out[1]["runs"] == [] and out[1]["short"] == ""
    assert out[2]["short"] == odd.LONG[:odd.LONG.index(". ") + 1]
    assert out[0]["score"] == "?"
    with pytest.raises(ValueError, match="taken"):
        pr.add_runs(docs, runs="words")
