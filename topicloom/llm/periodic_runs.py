"""Periodic runs of words by recompression.

A run is a maximal stretch of words with smallest period q (words q apart are identical) and a length of at
least max(12, 2 q). Texts are taken in portions of about PORTION_WORDS words, fences between them; each
portion gets a run-length grammar (``recompression``). A run with period q holds two neighbouring places of
the grid 0, q, 2q, .. of its text, and at least six words around the first of them match those around the
second. So only neighbours whose three words from there on or up to there agree are candidates; the grammar gives how
far they match on either side, which is the run. The grids of a text of n words have n ln n places together.
Every run found is compared word by word; should a hash collision ever have joined different symbols, the
portion is done again with another seed.

Defined cases: null, empty or blank texts have no words and no run; rows are handled one by one, so repeated
rows repeat their result and a null ``doc_id`` is allowed; an empty table gives no rows; other columns are
ignored by the query and kept by ``add_runs``, which refuses to replace a column. A text is never cut: one
of n words takes about 400 n bytes in its task and n ln n time.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topicloom.llm.common import mixed, table
from topicloom.llm.recompression import extensions, grammar
from topicloom.llm.registry import query

SHORTEST = 12  # fixed value: words of the shortest run
PORTION_WORDS = 300_000
CHUNK_PLACES = 3_000_000  # grid places looked at together

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def candidates(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(place, period) of grid neighbours around which three words agree, in portions."""
    with np.errstate(over="ignore"):
        three = mixed(ids[:-2] * np.uint64(3) + mixed(ids[1:-1] * np.uint64(5) + mixed(ids[2:])))
    three = np.concatenate([three, mixed(np.arange(2, dtype=np.uint64))])
    most = np.where(sizes >= SHORTEST, sizes // 2, 0)
    origin = np.repeat(starts, most)
    period = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = (np.repeat(sizes, most) - 1) // np.maximum(period, 1)  # neighbours on the grid
    ends = np.cumsum(grid)
    at = 0
    while at < len(grid):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_PLACES, "right")))
        n, q = grid[at:upto], period[at:upto]
        step = np.repeat(q, n)
        nth = np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(origin[at:upto], n) + nth * step
        # The fence before each text is one word away, so looking two words back stays in the portion.
        keep = three[place] == three[place + step]
        keep |= three[np.maximum(place - 2, 0)] == three[np.maximum(place - 2, 0) + step]
        yield place[keep], step[keep]
        at = upto


def portion_runs(texts: list[list], seed: int = 0) -> list[np.ndarray]:
    """(start, length, period) rows of each text, sorted by start, then period."""
    names: dict = {}
    number = count(1)
    sizes = np.array([len(words) for words in texts], np.int64)
    # Fence, words, fence, words, .., fence.
    starts = np.cumsum(sizes + 1) - sizes
    total = int(sizes.sum()) + len(texts) + 1
    fence = np.ones(total, bool)
    own = np.empty(total, np.int64)
    for start, words in zip(starts.tolist(), texts):
        own[start:start + len(words)] = [names[w] if w in names else names.setdefault(w, next(number))
                                         for w in words]
        fence[start:start + len(words)] = False
    own[fence] = -1 - np.arange(fence.sum())
    ids = mixed(own.view(np.uint64))
    levels = None
    found = []
    for place, period in candidates(ids, starts, sizes):
        if not len(place):
            continue
        levels = levels or grammar(ids, fence, seed)
        right = extensions(levels, place, place + period, forward=True)
        left = extensions(levels, place - 1, place + period - 1, forward=False)
        length = left + right + period
        good = length >= np.maximum(SHORTEST, 2 * period)
        found.append(np.stack([(place - left)[good], length[good], period[good]], axis=1))
    if not found:
        return [np.empty((0, 3), np.int64)] * len(texts)
    runs = np.concatenate(found)
    # The same stretch is met with multiples of its period; the smallest one counts.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[:len(runs)]
    runs = runs[new]
    for start, length, period in runs.tolist():
        if (own[start:start + length - period] != own[start + period:start + length]).any():
            return portion_runs(texts, seed + 1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] -= starts[owner]
    return np.split(runs, np.searchsorted(owner, np.arange(1, len(texts))))


def dropped(size: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word lies in a run, after that run's first period."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without the repetitions."""
    if not len(runs):
        return words
    return [w for w, gone in zip(words, dropped(len(words), runs)) if not gone]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's words: in one of ten texts, the end repeats a stretch."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * -(-(n - a) // p))[:n - a]


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _portions(rows):
    """Lists of consecutive (key, words) rows of about PORTION_WORDS words together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= PORTION_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _with_runs(rows):
    """(key, words, runs) of each (key, words) row."""
    for held in _portions(rows):
        for (key, words), runs in zip(held, portion_runs([words for _, words in held])):
            yield key, words, runs


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                    ("collapsed_sha256", pa.string())])
DIGEST_DDL = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")


def _digest(doc_id, words, runs):
    rows = runs.tolist()
    longest = min(rows, key=lambda r: (-r[1], r[0], r[2])) if rows else (None,) * 3
    text = "".join(f"{s},{length},{q}\n" for s, length, q in rows)
    return (doc_id, len(rows), *longest, 1000 * longest[1] // longest[2] if rows else None,
            hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def _digests(batches):
    rows = ((i, planted(_split(text.as_py()), i)) for batch in batches
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"]))
    digests = (_digest(*row) for row in _with_runs(rows))
    while part := list(islice(digests, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), DIGEST)],
                                         schema=DIGEST)


def add_runs(docs: DataFrame, text_col: str = "text", runs: str = "runs", into: str | None = None) -> DataFrame:
    """All rows with the runs of their text and, if asked for, the text without repetitions."""
    new = [runs] + ([into] if into else [])
    if taken := sorted(set(new) & set(docs.columns)):
        raise ValueError(f"columns {taken} are taken; choose other names")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{runs}` {RUNS}").fields])
    if into:
        schema = schema.add(into, "string")

    def add(batches):
        for batch in batches:
            found = list(_with_runs((None, _split(text.as_py())) for text in batch[text_col]))
            columns = [*batch.columns, pa.array(
                [[dict(zip(("start", "length", "period"), r)) for r in rows.tolist()] for _, _, rows in found],
                pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))]
            if into:
                columns.append(pa.array([b" ".join(collapsed(words, rows)).decode("utf-8", "replace")
                                         for _, words, rows in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(add, schema)


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_digests, DIGEST_DDL)
