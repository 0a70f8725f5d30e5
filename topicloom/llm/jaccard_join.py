"""N-gram Jaccard self-join by T-occurrence search, down to linked groups.

A document is the set of its distinct five-word shingles (64-bit hashes). Two documents link when
100 * |intersection| >= 80 * |union|. Steps, all exact:

1. ``describe``: one pass gives each text its set size and a 128-bit key of its set. Equal keys are one
   node from here on, so copies are never compared or paired.
2. ``rarity``: the same pass counts all shingles in a fixed number of buckets (2 ** SKETCH_BITS). The
   counts only order the shingles, rare ones first, and tell short inverted lists from long ones.
3. ``postings``: a link needs T = ceil(0.8 n) common shingles, so with the long lists set aside each
   node only enters the n - T + 1 rarest of its lists. Lists with one node are dropped.
4. ``star_pairs``: in each list every node is paired with one pivot, not with all others. A few rounds
   with different pivots join nearly all of a group; only lists that still hold several groups go on. A
   pair must meet in as many lists as a link needs (``_counted``).
5. ``short_pairs``: pairs that are left between different groups of a list of at most SHORT_LIST nodes, so
   their number is bounded by the postings.
6. ``leading``: longer lists are no join keys. A link that meets in none of the short lists in front of a node's
   first long one shares at most the shingles from there on, so few nodes can have such links. These are
   packed into blocks, and nodes outside the largest group of one of their lists query the blocks they
   share a list with (``block_links``).
7. ``verify`` and ``block_links``: T-occurrence search. The short lists of a query's shingles are merged
   with a heap, candidates with enough hits are probed in the long ones by binary search (DivideSkip), and
   those that reach the overlap are links.

Defined cases: null, empty or word-less texts have an empty set, link with nothing and are their own
component; rows without ``doc_id`` count as texts but cannot be the smallest id (a component made of such
rows has a null id); repeated rows and ties are copies; an empty table gives no rows; other columns are
ignored. Two different sets share a 64-bit node key with probability 2 ** -64 per pair.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.common import let_go, mixed, odd_keys, shingle_set, table
from topicloom.llm.registry import query
from topicloom.session import (fits_broadcast, materialize, maybe_broadcast, released_shuffles, rows_among,
                               rows_not_among)

WIDTH = 5
PERCENT = 80
SKETCH_BITS = 21
SKETCH_BLOCKS = 32
STAR_ROUNDS = (1, 4)  # pivots per list in each round
SHORT_LIST = 256  # nodes of a list whose pairs are listed
BLOCK_NODES = 2048  # nodes, and
BLOCK_SHINGLES = 1_000_000  # shingles of them, that one block search holds, about
CHUNK_SHINGLES = 1_000_000  # shingles of candidates that one search holds at a time
GROUP_BYTES = 1 << 19  # of texts whose shingles are made at a time
WINDOW_BYTES = 1 << 17  # of texts whose letters are looked up at a time, about

KEYS = odd_keys(WIDTH, seed=5)

DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()),
                       ("node2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])


_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LETTERS = odd_keys(256, seed=6)
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z are lowered
_PLACES = [odd_keys(256, seed=7)]


def _places(count: int) -> np.ndarray:
    """An odd number for each place in a word."""
    if count > len(_PLACES[0]):
        _PLACES[0] = odd_keys(2 * count, seed=7)
    return _PLACES[0]


def _windows(data: np.ndarray, cuts: np.ndarray):
    """Parts of the data of about WINDOW_BYTES that end behind a blank or a text."""
    start, end = int(cuts[0]), int(cuts[-1])
    while start < end:
        stop = min(start + WINDOW_BYTES, end)
        if stop < end:
            blank = np.flatnonzero(~_WORD[data[start:stop]])
            if len(blank):
                stop = start + int(blank[-1]) + 1
            else:  # a long word, up to the next blank or the end of its text
                last = int(cuts[np.searchsorted(cuts, stop)])
                blank = ~_WORD[data[stop:last]]
                stop = stop + int(blank.argmax()) if blank.any() else last
        yield start, stop
        start = stop


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text); text k is data[cuts[k]:cuts[k + 1]].

    A hash is the sum of products of a number for the letter and one for its place.
    """
    hashes, begins = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for start, stop in _windows(data, cuts):
        part = data[start:stop]
        inside = _WORD[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = cuts[np.searchsorted(cuts, start):np.searchsorted(cuts, stop)] - start
        first[heads] = inside[heads]
        letters = part[inside]
        if not len(letters):
            continue
        at = np.flatnonzero(first[inside])
        sizes = np.diff(at, append=len(letters))
        place = np.arange(len(letters)) - np.repeat(at, sizes)
        with np.errstate(over="ignore"):
            terms = _LETTERS[letters] * _places(int(sizes.max()))[place]
            hashes.append(mixed(np.add.reduceat(terms, at) + sizes.astype(np.uint64)))
        begins.append(np.flatnonzero(first) + start)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(begins), cuts))


def _grouped_texts(texts: pa.Array):
    """(bytes of the texts, where each begins and the last one ends), about GROUP_BYTES at a time."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    ends = np.r_[np.flatnonzero(np.diff((cuts[1:] - cuts[0]) // GROUP_BYTES)) + 1, len(texts)]
    for low, high in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
        yield data, cuts[low:high + 1]


def _shingled(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one text after the other, and where each text's begin and end."""
    hashes, words = word_hashes(data, cuts)
    ends = np.cumsum(words)
    flat, counts = np.empty(0, np.uint64), np.maximum(words - WIDTH + 1, 0)
    if counts.any():
        size = len(hashes) - WIDTH + 1
        text = np.repeat(np.arange(len(words)), words)
        with np.errstate(over="ignore"):
            total = np.full(size, WIDTH, np.uint64)
            for k in range(WIDTH):
                total += hashes[k:k + size] * KEYS[k]
        flat = mixed(total[text[:size] == text[WIDTH - 1:]])
    short = np.flatnonzero((words > 0) & (words < WIDTH))
    if len(short):
        whole = [shingle_set(hashes[ends[k] - words[k]:ends[k]], WIDTH, KEYS)[0] for k in short]
        flat = np.insert(flat, (np.cumsum(counts) - counts)[short], np.array(whole, np.uint64))
        counts[short] = 1
    stops = np.r_[0, np.cumsum(counts)]
    for low, high in zip(stops[:-1].tolist(), stops[1:].tolist()):
        flat[low:high].sort()
    distinct = np.r_[True, flat[1:] != flat[:-1]][:len(flat)]
    distinct[stops[:-1][counts > 0]] = True
    return flat[distinct], np.r_[0, np.cumsum(distinct)][stops]


def _signed_sums(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    out, some = np.zeros(len(stops) - 1, np.uint64), np.diff(stops) > 0
    if some.any():
        out[some] = np.add.reduceat(values, stops[:-1][some])
    return out.view(np.int64)


def _key(shingles: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The node of each text."""
    with np.errstate(over="ignore"):
        return _signed_sums(mixed(shingles), stops)


def _other_key(shingles: np.ndarray, stops: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _signed_sums(mixed(shingles ^ np.uint64(0x9E3779B97F4A7C15)), stops)


def _described_rows(docs: pa.Array, shingles: np.ndarray, stops: np.ndarray):
    nothing = pa.nulls(len(docs))
    return pa.RecordBatch.from_arrays([
        docs, pa.array(np.diff(stops)), pa.array(_key(shingles, stops)), pa.array(_other_key(shingles, stops)),
        nothing.cast(pa.int32()), nothing.cast(pa.binary())], schema=DESCRIBED)


def _describe(batches):
    let_go()
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    shift, used = np.uint64(64 - SKETCH_BITS), False
    for batch in batches:
        done = 0
        for data, cuts in _grouped_texts(batch["text"]):
            shingles, stops = _shingled(data, cuts)
            if len(shingles):
                places, met = np.unique((shingles >> shift).astype(np.int64), return_counts=True)
                counts[places] += met.astype(np.int32)
            used = True
            yield _described_rows(batch["doc_id"].slice(done, len(cuts) - 1), shingles, stops)
            done += len(cuts) - 1
    if used:
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SKETCH_BLOCKS)]
        none = [None] * SKETCH_BLOCKS
        yield pa.RecordBatch.from_pydict({
            "doc_id": none, "n": none, "node": none, "node2": none,
            "block": list(range(SKETCH_BLOCKS)), "counts": parts}, schema=DESCRIBED)


def _few_files(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` for narrow rows that are few next to what they come from: a file for each core, not for
    each shuffle partition. Writing nearly empty files takes longer than one more shuffle of such rows."""
    return materialize(df.repartition(df.sparkSession.sparkContext.defaultParallelism), label)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, node2) per row, and per task the bucket counts (block, counts)."""
    return materialize(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _describe, "doc_id long, n long, node long, node2 long, block int, counts binary"),
        "jaccard-sets")


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"], batch["counts"]):
            part = np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
            total[block] = total[block] + part if block in total else part
    for block, counts in total.items():
        yield pd.DataFrame({"block": [block], "counts": [counts.tobytes()]})


def rarity(described: DataFrame) -> np.ndarray:
    """Level per bucket: 0 for short lists, then one more for each doubling of the list.

    A list of SHORT_LIST nodes must be told from a short one however full the buckets are: a long list that
    stands in front of others makes all its nodes ``leading``. A short list that is taken for a longer one by
    chance only stands further behind. The driver receives the bucket counts, whose size is fixed by SKETCH_BITS.
    """
    rows = (described.filter("block IS NOT NULL").select("block", "counts")
            .repartition(SKETCH_BLOCKS, "block")
            .mapInPandas(_add_up, "block int, counts binary").collect())
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64)
                             for r in sorted(rows, key=lambda r: r["block"])])
    usual = counts.mean()
    over = np.maximum(1, (counts - usual - np.sqrt(usual)) / (SHORT_LIST / 4))
    return np.ceil(np.log2(over)).astype(np.uint8)


def needed(n: int) -> int:
    """Common shingles any link of a set of ``n`` needs at least."""
    return -(-PERCENT * n // 100)


def postings(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(shingle, node, n, pos): the lists a node must be looked up in, without lists of one node. ``pos`` is
    the shingle's place in the node's order; on the way all but the keys is packed into one number."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def rare(batches):
        done, shift = set(), np.uint64(64 - SKETCH_BITS)
        level = shared.value
        for batch in batches:
            for data, cuts in _grouped_texts(batch["text"]):
                parts = []
                shingles, stops = _shingled(data, cuts)
                levels_of = level[(shingles >> shift).astype(np.int64)]
                nodes = _key(shingles, stops).tolist()
                for node, low, high in zip(nodes, stops[:-1].tolist(), stops[1:].tolist()):
                    n = high - low
                    if not n or node in done:
                        continue
                    done.add(node)
                    heavy = levels_of[low:high]
                    # A stable sort: shingles come in order of their hashes.
                    pick = np.argsort(heavy, kind="stable")[:n - needed(n) + 1]
                    at = (n << 32) + (np.arange(len(pick)) << 1) + (heavy[pick] > 0)
                    parts.append((shingles[low + pick].view(np.int64), node, at))
                if parts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([p[0] for p in parts])),
                        pa.array(np.repeat([p[1] for p in parts], [len(p[0]) for p in parts])),
                        pa.array(np.concatenate([p[2] for p in parts]))], ["shingle", "node", "at"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(rare, "shingle long, node long, at long")
    # Short lists are bounded, so a window may see one whole; long lists are spread and kept.
    found = found.withColumn("spread", F.when(F.col("at") % 2 == 1, F.xxhash64("node")).otherwise(0))
    found.createOrReplaceTempView("jaccard_postings")
    alone = found.sparkSession.sql("""
        SELECT shingle, spread, node, at, min(node) OVER w AS least, max(node) OVER w AS most
        FROM jaccard_postings WINDOW w AS (PARTITION BY shingle, spread)""")
    # With ``spread``, which follows from the rest, copies are found where the window has put them.
    once = alone.filter("at % 2 = 1 OR least <> most").select("shingle", "spread", "node", "at").distinct()
    return materialize(once.selectExpr(
        "shingle", "node", "at DIV 4294967296 AS n", "CAST(at % 4294967296 DIV 2 AS INT) AS pos"), "jaccard-postings")


def _close(a: str, b: str):
    """Sizes that allow a link."""
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


def mixed_lists(lists: DataFrame) -> DataFrame:
    """Rows of the lists that hold nodes of two groups or more."""
    several = lists.groupBy("shingle").agg(F.min("group").alias("x"), F.max("group").alias("y"))
    return lists.join(several.filter("x <> y").select("shingle"), "shingle", "left_semi")


def _counted(pairs: DataFrame, aside: DataFrame | None = None) -> DataFrame:
    """Pairs of (pivot, node) that may still link, with the node's size ``n``, ``low`` and ``high``.

    ``pairs`` has a row for each list in which the two meet, with their sizes (pn, n) and places (pp, pos);
    ``aside`` says of a node in how many lists it is that were left out. Of two nodes' common shingles those up to the end of the
    shorter-reaching prefix lie in both prefixes, and the others among the last T - 1 of one node. So a link
    meets in alpha - max(T) + 1 lists or more, where alpha is the overlap it needs; and no more than what
    follows the first common place can be common.
    """
    size = 100 + PERCENT
    alpha = f"({PERCENT} * (less + more) + {size - 1}) DIV {size}"
    most = f"({PERCENT} * more + 99) DIV 100"
    either = F.struct("pivot", "node", "n")
    found = (pairs.groupBy(F.least("pivot", "node").alias("low"), F.greatest("pivot", "node").alias("high"))
             .agg(F.count("*").alias("met"), F.min(either).alias("x"),
                  F.max(F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("pp"))).alias("room"),
                  F.min(F.least("n", "pn")).alias("less"), F.max(F.greatest("n", "pn")).alias("more"))
             .withColumns({"alpha": F.expr(alpha), "most": F.expr(most), "left": F.lit(0)}))
    if aside is not None:
        for end in ("low", "high"):
            found = found.join(aside.select(F.col("node").alias(end), F.col("aside").alias(f"{end}_aside")), end, "left")
        found = found.withColumn("left", F.least(*[F.coalesce(f"{e}_aside", F.lit(0)) for e in ("low", "high")]))
    return (found.filter("met + left >= alpha - most + 1 AND (left > 0 OR room >= alpha)")
            .select("x.pivot", "x.node", "x.n", "low", "high"))


def centrality(lists: DataFrame) -> DataFrame:
    """(node, weight): rows of all lists a node is in. The text that others were copied from shares
    more with them than they share with each other, so it weighs most."""
    sizes = lists.groupBy("shingle").agg(F.count("*").alias("rows"))
    return lists.join(sizes, "shingle").groupBy("node").agg(F.sum("rows").alias("weight"))


def star_pairs(lists: DataFrame, pivots: int) -> DataFrame:
    """Each node of a list with the ``pivots`` nodes of the list that weigh most."""
    best = F.struct("weight", "node", "n", "pos", "group")
    if pivots == 1:
        best = lists.groupBy("shingle").agg(F.max(best).alias("p"))
    else:
        order = Window.partitionBy("shingle").orderBy(F.desc("weight"), F.desc("node"))
        best = (lists.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= pivots)
                .select("shingle", best.alias("p")))
    return _counted(lists.join(best, "shingle")
                    .filter((F.col("group") != F.col("p.group")) & _close("n", "p.n"))
                    .select(F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("pp"),
                            "node", "n", "pos"))


def long_lists(lists: DataFrame) -> DataFrame:
    """Shingles whose lists hold more than SHORT_LIST nodes."""
    return lists.groupBy("shingle").count().filter(F.col("count") > SHORT_LIST).select("shingle")


def short_pairs(lists: DataFrame, long: DataFrame) -> DataFrame:
    """All pairs of different groups in the lists that are not long; their length bounds the rows."""
    aside = lists.join(long, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("aside"))
    short = lists.join(long, "shingle", "left_anti")
    other = short.select("shingle", F.col("node").alias("pivot"), F.col("n").alias("pn"), F.col("pos").alias("pp"),
                         F.col("group").alias("pg"))
    return _counted(short.join(other, "shingle")
                    .filter((F.col("pg") != F.col("group")) & (F.col("pivot") < F.col("node")) & _close("n", "pn"))
                    .select("pivot", "pn", "pp", "node", "n", "pos"), aside)


def leading(all_lists: DataFrame, long: DataFrame) -> DataFrame:
    """(node, n, hint): nodes that may have a link which meets in none of the short lists in front of their
    first long one: what is left from there on must be enough for a link. ``long`` are lists of any group."""
    return (all_lists.join(long, "shingle", "left_semi").groupBy("node", "n")
            .agg(F.min("pos").alias("lead"), F.max("shingle").alias("hint"))
            .filter(F.expr(f"100 * (n - lead) >= {PERCENT} * n")).select("node", "n", "hint"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(node, block): nodes with one hint stay together, in as many blocks as their shingles need."""
    need = nodes.groupBy("hint").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    return nodes.join(need, "hint").select("node", F.xxhash64(
        "hint", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))


def block_links(lists: DataFrame, nodes: DataFrame, docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Links between nodes of different groups that share one of ``lists`` (the long ones, with groups).

    Of each list all groups but the largest ask, so any two groups meet. Only blocks are paired by shingle.
    """
    nodes = _few_files(nodes, "jaccard-leading")
    lists = lists.join(nodes.select("node"), "node", "left_semi")
    share = lists.groupBy("shingle", "group").agg(F.count("*").alias("rows"))
    major = share.groupBy("shingle").agg(F.max_by("group", F.struct("rows", "group")).alias("major"))
    minor = _few_files(lists.join(major, "shingle").filter("group <> major").select("node").distinct(),
                       "jaccard-asking")
    if minor.isEmpty():
        return _no_links(docs.sparkSession)
    asked = _blocks(nodes.join(minor, "node", "left_semi")).withColumnRenamed("block", "asker")
    held = _blocks(nodes)
    sets = materialize(shingle_sets(docs, nodes.select("node"), owners), "jaccard-built")
    asked, held = (materialize(x.join(sets, "node"), "jaccard-blocks") for x in (asked, held))
    at = lists.select("shingle", "node")
    meet = materialize(
        at.join(asked.select("node", "asker"), "node").select("shingle", "asker").distinct()
        .join(at.join(held.select("node", "block"), "node").select("shingle", "block").distinct(), "shingle")
        .select("asker", "block").distinct(), "jaccard-meetings")
    left = meet.join(asked, "asker").select("asker", "block", "node", "shingles")
    right = meet.join(held, "block").select(F.col("asker").alias("by"), F.col("block").alias("of"), "node", "shingles")
    return (left.groupBy("asker", "block").cogroup(right.groupBy("by", "of"))
            .applyInPandas(_block_search, "a long, b long"))


def merge_lists(lists: list[np.ndarray], floor: int) -> dict[int, int]:
    """What occurs in ``floor`` or more of the sorted lists, and in how many.

    The longest lists are set aside, the short ones are merged with a heap, and what may still reach the
    floor is probed in the long ones.
    """
    if len(lists) < floor:
        return {}
    lists = sorted(lists, key=len)
    # Few long lists when merging is cheap, many when the longest list dominates; always below floor.
    aside = min(len(lists), floor - 1, int(floor / (0.01 * np.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
    merged, long = heapq.merge(*(x.tolist() for x in short)), [x.tolist() for x in long]
    found = {}
    for owner, hits in groupby(merged):
        count = sum(1 for _ in hits)
        if count < floor - aside:
            continue
        for left, probed in zip(range(len(long), 0, -1), reversed(long)):
            if count + left < floor:
                break
            at = bisect_left(probed, owner)
            count += at < len(probed) and probed[at] == owner
        if count >= floor:
            found[owner] = count
    return found


def occurrence_search(query_set: np.ndarray, sets: list[np.ndarray], floor: int) -> dict[int, int]:
    """Index of each set sharing ``floor`` shingles or more with the query, and how many."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    place = np.searchsorted(query_set, flat)
    place[place == len(query_set)] = 0
    hit = query_set[place] == flat
    place, owners = place[hit], owners[hit]
    by_shingle = np.argsort(place, kind="stable")
    place, owners = place[by_shingle], owners[by_shingle]
    if not len(place):
        return {}
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return merge_lists(np.split(owners, starts[1:]), floor)


def _least_overlap(n: int, other: int) -> int:
    return max(1, -(-PERCENT * (n + other) // (100 + PERCENT)))


def _block_search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Links of the asking nodes with a block's nodes, from one inverted index of the block."""
    links = []
    if len(asked) and len(held):
        sets = [_array(x) for x in held["shingles"]]
        sizes = [len(x) for x in sets]
        flat, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((owners, flat))
        flat, owners = flat[order], owners[order]
        nodes = held["node"].tolist()
        for node, data in zip(asked["node"].tolist(), asked["shingles"]):
            own = _array(data)
            fits = [n for n in sizes if PERCENT * max(n, len(own)) <= 100 * min(n, len(own))]
            if not fits:
                continue
            low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            lists = [owners[x:y] for x, y in zip(low.tolist(), high.tolist()) if y > x]
            for k, common in merge_lists(lists, _least_overlap(len(own), min(fits))).items():
                if nodes[k] != node and 100 * common >= PERCENT * (len(own) + sizes[k] - common):
                    links.append((node, nodes[k]))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one pivot with a chunk of its candidates."""
    links = []
    own = group["node"] == group["pivot"]
    pivots, candidates = group[own], group[~own]
    if len(pivots) and len(candidates):
        base = _array(pivots["shingles"].iloc[0])
        sets = [_array(x) for x in candidates["shingles"]]
        least = min(map(len, sets))
        for k, common in occurrence_search(base, sets, _least_overlap(len(base), least)).items():
            if 100 * common >= PERCENT * (len(base) + len(sets[k]) - common):
                links.append((pivots["pivot"].iloc[0], candidates["node"].iloc[k]))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (pivot, node, n) that link. A pivot with many candidates is searched in several chunks."""
    load = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).alias("chunks"))
    candidates = pairs.join(load, "pivot").select(
        "pivot", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node")
    pivots = load.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
                         F.col("pivot").alias("node"))
    return (candidates.union(pivots).join(sets.select("node", "shingles"), "node")
            .groupBy("pivot", "chunk").applyInPandas(_search, "a long, b long"))


def _no_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, group): the smallest node that links reach, for nodes with a link; broadcast if measured to be small."""
    both = links.union(links.select("b", "a"))
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("group"))
    small = fits_broadcast(label)  # it keeps its nodes, so one measurement holds for every step
    few = links.sparkSession.sparkContext.defaultParallelism
    while True:
        label = F.broadcast(label) if small else label
        near = (both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node"))
                .agg(F.min("group").alias("near")))
        step = near.join(label, "node").select(
            "node", "group", F.least("group", "near").alias("best"))
        # One jump along the new label halves the way to the smallest node.
        jump = label.select(F.col("node").alias("best"), F.col("group").alias("far"))
        step = step.join(jump, "best").select("node", F.least("best", "far").alias("next"), "group")
        step = materialize(step.coalesce(few) if small else step, "jaccard-labels")
        label = step.select("node", F.col("next").alias("group"))
        if not step.filter("next <> group").limit(1).count():
            return F.broadcast(label) if small else label


def owners_of(described: DataFrame) -> DataFrame:
    """(node, doc_id): the smallest id of each node, null where no row has one."""
    return materialize(described.filter("node IS NOT NULL AND n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id")), "jaccard-owners")


def shingle_sets(docs: DataFrame, nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, n, shingles) for the listed nodes (each once), from one document of each."""

    def build(batches):
        for batch in batches:
            for data, cuts in _grouped_texts(batch["text"]):
                shingles, stops = _shingled(data, cuts)
                sets = [shingles[a:b].tobytes() for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(_key(shingles, stops)), pa.array(np.diff(stops)), pa.array(sets, pa.binary())],
                    ["node", "n", "shingles"])

    wanted = _few_files(owners.join(nodes, "node", "left_semi"), "jaccard-wanted")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    texts = rows_among(named, wanted.filter("doc_id IS NOT NULL").select("doc_id"), "doc_id").select("text")
    schema = "node long, n long, shingles binary"
    built = texts.mapInArrow(build, schema)
    if wanted.filter("doc_id IS NULL").limit(1).count():
        built = built.union(named.filter("doc_id IS NULL").select("text").mapInArrow(build, schema))
    # Repeated ids may bring other texts along, and copies without id the same text again.
    return built.join(maybe_broadcast(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"])


def _grouped(lists: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return lists.withColumn("group", F.col("node"))
    known = label.withColumnRenamed("node", "member")
    return lists.join(known, F.col("node") == F.col("member"), "left").select(
        "shingle", "node", "n", "pos", "weight", F.coalesce("group", "node").alias("group"))


def _links(docs: DataFrame, described: DataFrame) -> DataFrame | None:
    """(node, group) of all nodes with a link; None where no set can have one."""
    lists = postings(docs, rarity(described))
    label, links, tried = None, None, None
    lists = materialize(lists.join(centrality(lists), "node"), "jaccard-weighted")
    long = _few_files(long_lists(lists), "jaccard-long")
    owners = owners_of(described)

    def search(pairs: DataFrame) -> DataFrame:
        nonlocal tried
        # No pair is searched twice, whichever of the two was the pivot.
        if tried is not None:
            pairs = pairs.join(tried, ["low", "high"], "left_anti")
        pairs = _few_files(pairs, "jaccard-pairs")
        if pairs.isEmpty():
            return _no_links(docs.sparkSession)
        sets = shingle_sets(docs, pairs.select("node").union(pairs.select("pivot")), owners)
        done = pairs.select("low", "high")
        tried = done if tried is None else tried.union(done)
        return verify(pairs.select("pivot", "node", "n"), sets)

    def mixed_now() -> DataFrame:
        if label is None:  # every list holds several groups, but for some long ones that yield no pair
            return _grouped(lists, label)
        return materialize(mixed_lists(_grouped(lists, label)), "jaccard-lists")

    for pivots in (*STAR_ROUNDS, None, 0):
        left = mixed_now()
        if pivots:
            found = search(star_pairs(left, pivots))
        elif pivots is None:
            found = search(short_pairs(left, long))
        else:
            found = block_links(left.join(long, "shingle", "left_semi"), leading(lists, long), docs, owners)
        found = _few_files(found, "jaccard-found")
        links = found if links is None else links.union(found)
        if label is None or found.limit(1).count():
            label = components(links)
    return label


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, node, node2) of ``docs``, and of each class of equal sets (node, node2) the smallest id
    (class_id), the group it is linked to and that group's smallest id (component_id)."""
    with released_shuffles(docs.sparkSession):
        return _linked_classes(docs)


def _linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    described = describe(docs)
    label = _links(docs, described)
    rows = described.filter("node IS NOT NULL").select("doc_id", "n", "node", "node2")
    # Nodes are the classes of equal sets; an empty set is no class.
    classes = (rows.filter("n > 0").groupBy("node", "node2").agg(F.min("doc_id").alias("class_id"))
               .join(label.withColumnRenamed("group", "found"), "node", "left")
               .withColumn("group", F.coalesce("found", "node")))
    smallest = classes.groupBy("group").agg(F.min("class_id").alias("component_id"))
    named = materialize(classes.join(smallest, "group").select(
        "node", "node2", "class_id", "group", "component_id"), "jaccard-classes")
    docs.sparkSession.catalog.dropTempView("jaccard_postings")
    return rows, named


def linked_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest id with the same set), one row per row."""
    rows, named = linked_classes(docs)
    full = rows.filter("n > 0").join(named, ["node", "node2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"),
                                        F.col("doc_id").alias("component_id"),
                                        F.col("doc_id").alias("class_id"))
    return full.union(empty)


def set_keys(texts: pd.Series) -> pd.DataFrame:
    """The size of each text's set and the key of its class."""
    found = [np.empty((0, 3), np.int64)]
    for data, cuts in _grouped_texts(pa.array(texts, pa.large_string(), from_pandas=True)):
        shingles, stops = _shingled(data, cuts)
        found.append(np.column_stack((np.diff(stops), _key(shingles, stops), _other_key(shingles, stops))))
    return pd.DataFrame(np.concatenate(found), columns=["n", "node", "node2"])


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents, one with the smallest id.

    Rows without words stay. Decisions are made for rows, not for ids: where an id has several texts, each
    goes or stays with its own group. A group whose rows have no id keeps one of them.
    """
    rows, named = linked_classes(docs)
    rows = rows.filter("n > 0")
    with released_shuffles(docs.sparkSession):
        repeated = materialize(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count()
                               .filter("count > 1").select("doc_id"), "jaccard-repeated")
        gone = materialize(rows.join(named, ["node", "node2"]).filter("doc_id <> component_id").select("doc_id")
                           .join(maybe_broadcast(repeated), "doc_id", "left_anti"), "jaccard-gone")
    with_id = docs.filter("doc_id IS NOT NULL")
    once = rows_not_among(with_id, gone.union(repeated), "doc_id")
    odd = rows_among(with_id, repeated, "doc_id").unionByName(docs.filter("doc_id IS NULL"))
    if not odd.limit(1).count():
        return once
    # An id alone does not tell these rows apart, so they are looked up by their sets.
    key = F.pandas_udf(set_keys, "n long, node long, node2 long")
    keyed = odd.select(F.struct(*[odd[c] for c in docs.columns]).alias("row"),
                       key(F.col("text").cast("string")).alias("key")).select("row", "key.*")
    stays = keyed.filter("n = 0")
    one = (keyed.join(named, ["node", "node2"]).filter("row.doc_id <=> component_id").dropDuplicates(["group"]))
    return once.unionByName(stays.select("row.*")).unionByName(one.select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], chr(10)) AS h
      FROM w, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS u(i)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b USING (h)
      WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y
      WHERE 100 * o.n >= 80 * (p.n + q.n - o.n)),
r AS (SELECT doc_id AS root, doc_id AS node FROM documents
      UNION SELECT root, y FROM r JOIN e ON node = x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM r WHERE node = doc_id) AS component_id
FROM documents LEFT JOIN c USING (doc_id)
"""


@query("op4_ngram_jaccard_join", ORACLE)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(table(spark, sf_dir, "documents")).drop("class_id")
