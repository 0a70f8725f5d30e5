"""Benchmark decontamination with spaced seeds.

A mask fixes which positions of a window of words are hashed and which are ignored, so a window still
matches after a substitution at an ignored position. Training and test windows are joined on (mask, hash);
around each hit the two texts are compared word by word along the hit's diagonal, and a document counts as
contaminated by an item when a stretch of at least ``WINDOW`` words of the item (all words of a shorter
item) agrees in at least ``MIN_MATCH_PERCENT`` of its positions.

Items of fewer than MIN_ITEM_WORDS words have no room for substitutions: they are found where all their words
stand in a row. In scripts written without blanks each character is a word.

The test set is taken in blocks of at most BLOCK_WORDS words, so what is broadcast stays bounded however
large the test set is; one pass over the documents serves one block.

Defined cases: null or empty documents are clean; items without a word match nothing; an empty test set leaves
all documents clean; repeated items are one item with the smallest id; of equally good stretches of an item the
first is reported; repeated documents are each judged; other columns are ignored by the search and untouched by the
filter. Very long documents are taken whole; where a seed is frequent in both texts, the diagonals on which it
meets are found at once (``_diagonals``), so text that repeats itself does not multiply pairs of places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import WordCache, alnum_words, kept, mixed, odd_keys, table
from topicloom.llm.registry import query
from topicloom.session import materialize

WINDOW = 12
MIN_MATCH_PERCENT = 75
MIN_ITEM_WORDS = 6
# 1: position is hashed, 0: position is ignored. Together they meet every window of MIN_ITEM_WORDS to
# WINDOW words that agrees in MIN_MATCH_PERCENT of its places, wherever the others are (tested).
MASKS = ("11101", "100111", "1101001")
BLOCK_WORDS = 2_000_000
BITS = 22

FEW_PAIRS = 20_000  # pairs of places of one seed that are listed

_KEYS = odd_keys(16, seed=9)
# Scripts written without blanks: Thai to Tibetan, Myanmar, Khmer, kana, Han.
_NO_BLANKS = re.compile("([\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF"
                        "\uF900-\uFAFF\U00020000-\U0003FFFF])")


def words_of(text: str | None) -> list[bytes]:
    """Words, and each character of a script written without blanks."""
    return alnum_words(_NO_BLANKS.sub(r" \1 ", text) if text and not text.isascii() else text)


def pattern_of(mask: int) -> str:
    """A mask; those behind the last one take short items of one length whole."""
    return MASKS[mask] if mask < len(MASKS) else "1" * (mask - len(MASKS) + 1)


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the kept positions of every window of a mask."""
    pattern = pattern_of(mask)
    count = len(words) - len(pattern) + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(count, mask + 1, np.uint64)
        for k, kept in enumerate(pattern):
            if kept == "1":
                total += words[k:k + count] * _KEYS[k]
        return mixed(total)


@dataclass
class Block:
    """Words and sorted seeds of some items."""

    item_ids: list[int]
    words: list[np.ndarray]
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    present: np.ndarray
    masks: list[int]


def build_block(items: list[tuple[int, np.ndarray]]) -> Block:
    hashes, owners, places, masks = [], [], [], set()
    for k, (_, words) in enumerate(items):
        own = range(len(MASKS)) if len(words) >= MIN_ITEM_WORDS else [len(MASKS) + len(words) - 1]
        masks.update(own)
        for mask in own:
            found = seeds(words, mask)
            hashes.append(found)
            owners.append(np.full(len(found), k, np.int64))
            places.append(np.arange(len(found)))
    hashes, owners, places = map(np.concatenate, (hashes, owners, places))
    order = np.argsort(hashes, kind="stable")
    present = np.zeros(1 << BITS, bool)
    present[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return Block([i for i, _ in items], [w for _, w in items], hashes[order], owners[order],
                 places[order], present, sorted(masks))


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The test set in blocks of bounded size, one at a time on the driver."""
    rows = (items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
            .filter("item_id IS NOT NULL AND text IS NOT NULL")
            .groupBy("text").agg(F.min("item_id").alias("item_id")).orderBy("item_id", "text"))
    cache, part, size = WordCache(), [], 0
    for row in rows.toLocalIterator():
        words = cache.hashes(words_of(row["text"]))
        if not len(words):
            continue
        part.append((row["item_id"], words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield build_block(part)
            part, size = [], 0
    if part:
        yield build_block(part)


def _hits(words: np.ndarray, block: Block):
    """Distinct (item, diagonal) of all windows that share a seed."""
    found = []
    shift = np.uint64(64 - BITS)
    for mask in block.masks:
        own = seeds(words, mask)
        at = np.flatnonzero(block.present[(own >> shift).astype(np.int64)])
        if not len(at):
            continue
        low = np.searchsorted(block.hashes, own[at], "left")
        times = np.searchsorted(block.hashes, own[at], "right") - low
        # Equal seeds have equal ``low``: how many pairs each seed of the item makes in the whole text.
        seed, place, often = np.unique(low, return_inverse=True, return_counts=True)
        many = (often[place] * times > FEW_PAIRS)
        few = ~many
        t = times[few]
        hit = np.repeat(low[few], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        found.append(np.column_stack((block.items[hit], np.repeat(at[few], t) - block.places[hit])))
        for k in np.unique(place[many]):
            rows = slice(seed[k], seed[k] + times[place == k][0])
            items = block.items[rows]
            for item in np.unique(items):
                diagonals = _diagonals(at[place == k], block.places[rows][items == item])
                found.append(np.column_stack((np.full(len(diagonals), item), diagonals)))
    return np.unique(np.concatenate(found), axis=0) if found else ()


def _diagonals(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """All distinct differences, by multiplying the two sets as polynomials where they are large."""
    if len(places) * len(others) <= FEW_PAIRS:
        return np.unique(np.subtract.outer(places, others))
    first, last = int(places.min()), int(others.max())
    a = np.bincount(places - first).astype(np.float64)
    b = np.bincount(last - others).astype(np.float64)
    size = len(a) + len(b) - 1
    product = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)
    return np.flatnonzero(product > 0.5) + first - last


def best_stretch(words: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first document word, words, agreeing words) of all qualifying windows on a diagonal, joined."""
    start, end = max(0, -diagonal), min(len(item), len(words) - diagonal)
    width = min(WINDOW, len(item))
    if end - start < width:
        return None
    same = words[start + diagonal:end + diagonal] == item[start:end]
    run = np.r_[0, np.cumsum(same)]
    least = MIN_MATCH_PERCENT if len(item) >= MIN_ITEM_WORDS else 100
    good = np.flatnonzero(100 * (run[width:] - run[:-width]) >= least * width)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + width
    return start + diagonal + first, last - first, int(run[last] - run[first])


def overlaps(text: str | None, block: Block, cache: WordCache) -> list[tuple[int, int, int, int]]:
    """(item_id, first word, words, agreeing words) for each item found in a text, best stretch each."""
    words = cache.hashes(words_of(text))
    best: dict[int, tuple] = {}
    for k, diagonal in _hits(words, block):
        found = best_stretch(words, block.words[k], int(diagonal))
        if found and (k not in best or (-found[2], found[0]) < (-best[k][2], best[k][0])):
            best[k] = found
    return sorted((block.item_ids[k], *v) for k, v in best.items())


SCHEMA = "array<struct<item_id long, first_word long, n_words long, n_same long>>"


def finder(spark: SparkSession, block: Block):
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(SCHEMA)
    def find(texts: pd.Series) -> pd.Series:
        cache = kept("decontamination", None, WordCache)
        return pd.Series([[dict(zip(("item_id", "first_word", "n_words", "n_same"), x))
                           for x in overlaps(t, shared.value, cache)] for t in texts])

    return find


def mark(docs: DataFrame, items: DataFrame, text: str = "text", into: str = "overlaps") -> DataFrame:
    """All rows and columns plus the overlaps with the test set."""
    out = docs.withColumn(into, F.array().cast(SCHEMA))
    for k, block in enumerate(blocks(items)):
        found = finder(docs.sparkSession, block)(F.col(text).cast("string"))
        out = out.withColumn(into, F.concat(into, found))
        if k % 16 == 15:
            out = materialize(out, "decontaminated")
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without an overlap."""
    name = "__overlaps"
    return mark(docs, items, into=name).filter(F.size(name) == 0).drop(name)


@query("op9_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, and one entry per benchmark item found in the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"),
                         F.transform("overlaps", lambda x: x["item_id"]).alias("item_ids"), "overlaps")
