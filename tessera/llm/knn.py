"""Exact top-k inner products by a block matrix join on int8 tiles.

Vectors are dealt into query blocks and candidate stripes; each (block, stripe) pair is one tile. In a tile, int8
products bound every inner product from both sides; only pairs whose upper bound reaches the query's k-th lower bound
are computed again in double precision. A query's tile lists meet in a heap.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._shared import materialize

TILE_SCHEMA = "query_id long, vec_id long, score double"
#: Dimensions whose int8 products sum exactly in float32: 127 * 127 * 1024 < 2 ** 24.
EXACT_DIMS = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of scale * codes, norms of the errors (each a little rounded up)."""
    top = np.abs(x).max(axis=1, keepdims=True)
    scale = top / 127
    codes = np.rint(np.divide(x, scale, out=np.zeros_like(x), where=scale > 0)).astype(np.int8)
    near = codes * scale
    up = 1 + 1e-12
    return codes, scale[:, 0], np.linalg.norm(near, axis=1) * up, np.linalg.norm(x - near, axis=1) * up


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMS):
        total += a[:, d : d + EXACT_DIMS].astype(np.float32) @ b[:, d : d + EXACT_DIMS].astype(np.float32).T
    return total


def tile_top(q_ids, q, c_ids, c, k: int, strip: int = 2048):
    """(query row, candidate row, score) of each query's k best in one tile, by score, then id.

    Candidates come a strip at a time. The k best lower bounds so far are each query's bar; pairs whose upper bound reaches it
    are computed in double precision and held, at most k a query from one strip to the next.
    """
    n, up = len(q), 1 + 1e-9
    qc, qs, qn, qe = quantise(q)
    bars, held = np.full((n, k), -np.inf), [(np.empty(0, np.int64), np.empty(0)) for _ in range(n)]
    for at in range(0, len(c), strip):
        ids, own = c_ids[at : at + strip], c[at : at + strip]
        cc, cs, cn, ce = quantise(own)
        dot = code_products(qc, cc) * qs[:, None] * cs[None, :]
        err = (qn[:, None] * ce + qe[:, None] * cn + qe[:, None] * ce) * up + 1e-300 + 1e-12 * (qn[:, None] * cn)
        err[q_ids[:, None] == ids[None, :]] = np.nan  # a query is no candidate of its own
        low = np.where(np.isnan(err), -np.inf, dot - err)
        best = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k :] if low.shape[1] > k else low
        bars = np.sort(np.hstack([bars, best]), axis=1)[:, -k:]
        for i, j in enumerate(dot + err >= bars[:, :1]):
            rows = np.flatnonzero(j)
            if len(rows):
                some, score = np.concatenate([held[i][0], ids[rows]]), np.concatenate([held[i][1], (own[rows] * q[i]).sum(axis=1)])
                first = np.lexsort((some, -score))[:k]
                held[i] = some[first], score[first]
    return np.repeat(q_ids, [len(h[0]) for h in held]), *(np.concatenate([h[m] for h in held]) for m in (0, 1))


def _matrix(column: pa.ChunkedArray, width: str) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), width).reshape(len(blobs), -1).astype(np.float64)


def _packed(width: str):
    """(id, v, dim) with the vector as bytes, of single precision where the table has no more: half of what the tiles exchange."""

    def run(batches):
        for b in batches:
            rows = [np.asarray(v.values, width) for v in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int32())], ["id", "v", "dim"])

    return run


def top_inner_products(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 1024, stripe_rows: int = 16_384
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, its k nearest by inner product.

    Nearest first, ties to the smaller id; all candidates where there are fewer. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do null ids. Rows that repeat an id count once (of differing vectors
    the smallest, as arrays compare), so a query never meets its own id. Vectors of different lengths aren't compared.
    A tile holds block_rows queries and stripe_rows candidates, whatever the table's size, and works on them a strip at a time;
    equal vectors spread over stripes by id. An empty table gives no rows; other columns aren't read.
    """
    v = F.col("v")
    whole = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    width = "<f4" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull) else "<f8"
    whole = materialize(whole.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_packed(width), "id long, v binary, dim int"), "vectors")
    is_query = F.col("id") % every == 0
    n, n_q = whole.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    stripes, blocks = max(1, math.ceil(n / stripe_rows)), max(1, math.ceil(n_q / block_rows))
    tile = lambda name, m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias(name)
    each = lambda name, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    queries = whole.where(is_query).select("id", "v", "dim", tile("block", blocks), each("stripe", stripes))
    own = {c: F.col(c).alias(f"c_{c}") for c in ("id", "v", "dim")}  # names of its own, as both sides come from one table
    rows = whole.select(*own.values(), each("c_block", blocks), tile("c_stripe", stripes))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        none = not left.num_rows or not right.num_rows
        q, c, s = ([], [], []) if none else tile_top(
            np.asarray(left["id"]), _matrix(left["v"], width), np.asarray(right["c_id"]), _matrix(right["c_v"], width), k
        )
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    tiles = queries.groupBy("dim", "block", "stripe").cogroup(rows.groupBy("c_dim", "c_block", "c_stripe")).applyInArrow(join, TILE_SCHEMA)

    def merge(lists: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, zip((-s for s in lists["score"].to_pylist()), lists["vec_id"].to_pylist(), strict=True))
        q = lists["query_id"][0].as_py() if best else None
        return pa.table({
            "query_id": pa.array([q] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
            "vec_id": pa.array([i for _, i in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.float64()),
        })

    return tiles.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
