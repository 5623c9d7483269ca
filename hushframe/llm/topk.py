"""Exact top-k inner-product search by term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Candidates and queries that meet in one task. A score block is QUERIES_AT_ONCE x CANDIDATES longs.
CANDIDATES = 8192
QUERIES = 2048
QUERIES_AT_ONCE = 64

SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, weights): floor(scale * x) of each component as a long.

    Rows without an id, null vectors and vectors with a null or non-finite
    component are left out. Rows that share an id count once, with the
    smallest vector. A vector so long that an inner product of two such might leave
    the range of a long (2^63 or more as the sum of its squared weights) is an error.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    weights = F.transform("_x", lambda v: F.floor(v * scale))
    # inner products are at most the product of the vectors' lengths
    squares = F.aggregate("_x", F.lit(0.0), lambda total, v: total + (F.abs(v * scale) + 1) * (F.abs(v * scale) + 1))
    usable = F.col("_x").isNotNull() & F.col("_id").isNotNull() & ~F.exists(
        "_x", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)),
    )
    return (
        vectors.select(F.col(id_col).cast("long").alias("_id"), x.alias("_x"))
        .where(usable).groupBy("_id").agg(F.min("_x").alias("_x"))
        .select(F.col("_id").alias("vec_id"), F.when(squares < 2.0**63, weights).otherwise(F.raise_error(F.lit("a vector is too long for scores that are longs")).cast("array<bigint>")).alias("weights"))
    )


def _postings(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids in ascending order; row, term and weight of the non-zero weights; terms' borders."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("weights").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = np.diff(lists.offsets.to_numpy())
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    rows = np.repeat(place, lengths)
    terms = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weights = lists.flatten().to_numpy()
    keep = weights != 0
    order = np.argsort(terms[keep], kind="stable")
    rows, terms, weights = rows[keep][order], terms[keep][order], weights[keep][order]
    return np.sort(ids), rows, terms, weights, np.searchsorted(terms, np.arange(terms[-1] + 2 if len(terms) else 1))


def _scores(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates of this block for each query."""
    query_ids, q_rows, q_terms, q_weights, _ = _postings(queries)
    ids, rows, _, weights, borders = _postings(candidates)
    by_row = np.argsort(q_rows, kind="stable")
    q_rows, q_terms, q_weights = q_rows[by_row], q_terms[by_row], q_weights[by_row]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(query_ids), QUERIES_AT_ONCE):
        last = min(first + QUERIES_AT_ONCE, len(query_ids))
        scores = np.zeros((last - first, len(ids)), np.int64)
        low, high = np.searchsorted(q_rows, [first, last])
        for row, term, weight in zip(q_rows[low:high] - first, q_terms[low:high], q_weights[low:high], strict=True):
            if term + 1 < len(borders):
                a, b = borders[term], borders[term + 1]
                if b - a == len(ids):  # every candidate has this term, in id order
                    scores[row] += weight * weights[a:b]
                else:
                    scores[row, rows[a:b]] += weight * weights[a:b]
        for i in range(last - first):
            own = np.searchsorted(ids, query_ids[first + i])
            others = np.ones(len(ids), bool)
            if own < len(ids) and ids[own] == query_ids[first + i]:
                others[own] = False
            line, there = scores[i][others], ids[others]
            if len(line) > k:
                least = np.partition(line, len(line) - k)[len(line) - k]
                above = np.flatnonzero(line > least)
                best = np.r_[above, np.flatnonzero(line == least)[:k - len(above)]]  # ids ascend: ties to the smaller
            else:
                best = np.arange(len(line))
            out.append((np.full(len(best), query_ids[first + i]), there[best], line[best]))
    columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [], []))]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    Both inputs are ``quantised`` frames. Candidates are dealt by a hash of
    their id into blocks of about 8192 and queries into blocks of about 2048;
    every pair of blocks meets in one task. There the candidates become
    postings by dimension, a query's non-zero weights are scattered one
    dimension at a time into dense score rows, and the k best are found by
    partition selection; a window merges the blocks. A candidate with a
    query's own id is skipped. Ties go to the smaller id. A query with fewer
    than k candidates returns all of them; empty inputs return nothing.
    Vectors of unequal length are multiplied over the dimensions they share.
    Products are 64-bit.
    """
    n_blocks = max(1, -(-candidates.count() // CANDIDATES))
    q_blocks = max(1, -(-queries.count() // QUERIES))

    def dealt(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64("vec_id"), F.lit(own_n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other), "vec_id", "weights",
        )

    left = dealt(queries, "q", q_blocks, "c", n_blocks).groupBy("q", "c")
    right = dealt(candidates, "c", n_blocks, "q", q_blocks).groupBy("q", "c")

    def block(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return _scores(queries, candidates, k)

    best = left.cogroup(right).applyInArrow(block, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score",
    )
