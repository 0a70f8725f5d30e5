"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector becomes integers, floor(64 * x) per component, and each component is a term. Steps, all exact:

1. ``pack``: rows are packed into blocks of at most BLOCK_CELLS components, sorted by ``vec_id``, in the
   narrowest integer type that holds them. Candidates stay in the partition they were read from; queries
   are dealt into blocks of about QUERY_ROWS rows.
2. Each query block meets each slot of candidate blocks once, in one co-group of bounded size: candidate
   blocks are repeated per query block, query blocks per slot. Nothing is broadcast, and no row of the
   grid depends on what the vectors hold, so equal or frequent vectors cause no skew.
3. ``postings`` inverts a candidate block: per term the places and values of the rows that hold it. A list
   that holds over half of the rows keeps its zeros and needs no places.
4. ``accumulate``: the terms of some query rows are taken one after the other; the weight of a query row
   scatters the values of the term's list into that row's dense array of scores.
5. ``best``: partition selection of the highest scores per block (ties to the smaller id), merged over the
   blocks of a slot and, by a ranking window, over slots.

The search keeps one place more than asked for and takes the query's own row out at the end: that row has
the query's id and the score of the query with itself.

Defined cases: vectors that are null or hold a null or non-finite component take no part; an empty vector
scores 0 with all, and a shorter vector counts as padded with zeros. Rows without ``vec_id`` are no queries;
as candidates they rank behind rows with an id at equal scores. Rows that repeat an id are rows of their own:
each is a query, and finds the others. Components and scores beyond a long are clamped to it; all others are
exact. An empty table gives no rows, other columns are ignored. Very long vectors
make blocks of few rows; one vector must fit in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from topicloom.llm.common import table
from topicloom.llm.registry import query
from topicloom.session import PARTITIONS, materialize

SCALE = 64  # fixed value: a component x counts as floor(SCALE * x)
QUERY_STEP = 20  # fixed value: rows whose id it divides are queries
TOP = 20  # fixed value: rows returned for a query

BLOCK_CELLS = 1 << 18  # components in a candidate block
QUERY_ROWS = 2048  # query rows in a query block
SLOT_BLOCKS = 16  # candidate blocks that one co-group holds, about
SCORE_CELLS = 1 << 17  # scores held while terms are taken one after the other
NO_ID = 2**63 - 1  # sorts behind every id

PACKED = pa.schema([("block", pa.int32()), ("rows", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()),
                    ("named", pa.binary()), ("cells", pa.binary())])
PACKED_DDL = "block int, rows int, kind string, ids binary, named binary, cells binary"
FOUND = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("query_id", pa.int64()),
                   ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "part int, block int, place int, query_id long, own long, vec_id long, score long"


def quantised(vectors: pa.ListArray) -> list[np.ndarray]:
    """floor(SCALE * x) of each vector as longs."""
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    with np.errstate(over="ignore"):  # beyond the range of doubles is beyond a long as well
        scaled = np.floor(flat * SCALE)
    whole = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    ends = np.cumsum([len(v) for v in vectors], dtype=np.int64)
    return np.split(whole, ends[:-1]) if len(ends) else []


def narrow(cells: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        bounds = np.iinfo(kind)
        if not cells.size or (cells.min() >= bounds.min and cells.max() <= bounds.max):
            return cells.astype(kind)
    return cells


def _block(number: int, ids: list[int | None], vectors: list[np.ndarray]) -> pa.RecordBatch:
    named = np.array([i is not None for i in ids])
    keys = np.array([NO_ID if i is None else i for i in ids], np.int64)
    order = np.lexsort((~named, keys))
    cells = np.zeros((max(map(len, vectors)), len(ids)), np.int64)  # term by row
    for column, row in enumerate(order):
        cells[:len(vectors[row]), column] = vectors[row]
    cells = narrow(cells)
    return pa.RecordBatch.from_pydict({
        "block": [number], "rows": [len(ids)], "kind": [cells.dtype.str], "ids": [keys[order].tobytes()],
        "named": [named[order].tobytes()], "cells": [cells.tobytes()]}, schema=PACKED)


def _packer(most_rows: int):
    def packed(batches):
        ids, vectors, longest, number = [], [], 0, 0
        for batch in batches:
            for key, vector in zip(batch["vec_id"].to_pylist(), quantised(batch["vector"]), strict=True):
                wide = max(longest, len(vector))
                if ids and (len(ids) >= most_rows or wide * (len(ids) + 1) > BLOCK_CELLS):
                    yield _block(number, ids, vectors)
                    ids, vectors, wide, number = [], [], len(vector), number + 1
                ids.append(key)
                vectors.append(vector)
                longest = wide
        if ids:
            yield _block(number, ids, vectors)

    return packed


def pack(rows: DataFrame, most_rows: int = BLOCK_CELLS) -> DataFrame:
    """(vec_id, vector) as packed blocks, numbered within ``part``, the partition they were packed in."""
    return rows.mapInArrow(_packer(most_rows), PACKED_DDL).withColumn("part", F.spark_partition_id())


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) != F.lit(math.inf)))
    return df.where(F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast(LongType()).alias("vec_id"), F.col(vector_col).alias("vector"))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, whether there is one, and components (term by row) of a block."""
    cells = np.frombuffer(row["cells"], row["kind"])
    return (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool),
            cells.reshape(-1, row["rows"]))


def postings(cells: np.ndarray) -> list[tuple[int, np.ndarray | None, np.ndarray]]:
    """(term, places, values) of a block's rows; places are None for a list that keeps its zeros."""
    lists = []
    for term, values in enumerate(cells):
        places = np.flatnonzero(values)
        if 2 * len(places) > len(values):
            lists.append((term, None, values))
        elif len(places):
            lists.append((term, places, values[places]))
    return lists


def accumulate(weights: np.ndarray, lists: list, rows: int) -> np.ndarray:
    """Scores (query row by block row): term after term, weights times values into dense arrays."""
    scores = np.zeros((len(weights), rows), weights.dtype)
    for term, places, values in lists:
        if term >= weights.shape[1]:
            break
        weight = weights[:, term]
        holders = np.flatnonzero(weight)
        added = np.multiply.outer(weight[holders], values.astype(weights.dtype))
        if places is not None:
            scores[holders[:, None], places] += added
        elif len(holders) == len(weights):
            scores += added
        else:
            scores[holders] += added
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest scores of each row, high ones first, ties to the smaller column."""
    columns = scores.shape[1]
    if scores.dtype == object or np.abs(scores).max(initial=0) > 2**62 // max(1, columns):
        return np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]
    keys = scores.astype(np.int64) * columns - np.arange(columns)
    if k >= columns:
        return np.argsort(-keys, axis=1)
    top = np.argpartition(-keys, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(keys, top, 1), axis=1), 1)


def _type_for(weights: np.ndarray, blocks: list) -> type:
    """Integers wide enough for every score."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    bound = most(weights) * max(most(b[2]) for b in blocks) * max(1, weights.shape[1])
    return np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object


def search(weights: np.ndarray, blocks: list, k: int) -> list[list[tuple[int, int, bool]]]:
    """Per query row the best (score, id, has id) of some blocks: at most ``k``, best ones first."""
    kind = _type_for(weights, blocks)
    weights = weights.astype(kind)
    lists = [postings(cells) for _, _, cells in blocks]
    found = []
    step = max(1, SCORE_CELLS // max(len(ids) for ids, _, _ in blocks))
    for start in range(0, len(weights), step):
        part = weights[start:start + step]
        merged = [[] for _ in part]
        for (ids, named, _), own in zip(blocks, lists, strict=True):
            scores = accumulate(part, own, len(ids))
            if kind is object:
                scores = np.clip(scores, -(2**63), 2**63 - 1)
            for row, columns in enumerate(best(scores, k)):
                merged[row] += zip((-scores[row, columns]).tolist(), (~named[columns]).tolist(),
                                   ids[columns].tolist())
        for row in merged:
            row.sort()
            found.append([(-score, key, not bare) for score, bare, key in row[:k]])
    return found


def _clamped(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _meet(k: int):
    def meet(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        blocks = [_unpacked(r) for r in candidates.to_pylist()]
        out = {name: [] for name in FOUND.names}
        for row in queries.to_pylist() if blocks else ():
            ids, _, cells = _unpacked(row)
            weights = np.ascontiguousarray(cells.T)
            for place, hits in enumerate(search(weights, blocks, k + 1)):
                own = sum(x * x for x in weights[place].tolist())
                out["part"] += [row["part"]] * len(hits)
                out["block"] += [row["block"]] * len(hits)
                out["place"] += [place] * len(hits)
                out["query_id"] += [int(ids[place])] * len(hits)
                out["own"] += [_clamped(own)] * len(hits)
                out["vec_id"] += [key if named else None for _, key, named in hits]
                out["score"] += [_clamped(score) for score, _, _ in hits]
        return pa.Table.from_pydict(out, schema=FOUND)

    return meet


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (rows of ``df``) the ``k`` rows of ``df``
    with the highest integer inner product, the query's own row left out."""
    wanted = usable(queries, id_col, vector_col).where("vec_id IS NOT NULL")
    parts = max(1, math.ceil(wanted.count() / QUERY_ROWS))
    asked = materialize(pack(wanted.repartition(parts), QUERY_ROWS), "topk-queries")
    candidates = materialize(pack(usable(df, id_col, vector_col)), "topk-candidates")
    blocks = candidates.count()
    tasks = int(df.sparkSession.conf.get(PARTITIONS))
    slots = max(1, min(blocks, max(math.ceil(blocks / SLOT_BLOCKS), math.ceil(tasks / parts))))

    def each(n: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = asked.select("*", each(slots, "slot"))
    slot = F.pmod(F.col("part") + F.col("block"), F.lit(slots))
    right = candidates.withColumn("slot", slot).drop("part", "block").select("*", each(parts, "part"))
    found = left.groupBy("part", "slot").cogroup(right.groupBy("part", "slot")).applyInArrow(
        _meet(k), FOUND_DDL)
    row = Window.partitionBy("part", "block", "place")
    order = row.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    is_own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    ranked = ranked.withColumn("own_at", F.coalesce(F.min(F.when(is_own, F.col("at"))).over(row), F.lit(k + 2)))
    after = F.when(F.col("at") > F.col("own_at"), F.col("at") - 1).otherwise(F.col("at"))
    return ranked.where("at <> own_at").select("query_id", after.alias("rank"), "vec_id", "score").where(
        F.col("rank") <= k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding,
                 lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op13_exact_topk", ORACLE)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
