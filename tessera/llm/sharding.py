"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Source cells (scan partitions) and shards meet in a matrix of exact row counts drawn once. Every cell permutes its rows
and deals them out by its row of the matrix; every shard permutes what it gets. Which rows go where is then uniform
over all ways to fill the shards, and shard sizes differ by one row at most. Only DataFrame functions touch the rows.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._shared import materialize

#: Numbers in the matrix at most, whatever the input: 32 MB to broadcast.
MATRIX_CELLS = 4_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows without replacement are good; by inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p_up = p_down = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left, up, down = rng.random() - p_up, mode, mode
    while left >= 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up, left = up + 1, left - p_up
            if left < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down, left = down - 1, left - p_down
            if left < 0:
                return down
    return mode


def communication_matrix(cells: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each cell to each shard: row sums are `cells`, column sums `shards`; a multivariate hypergeometric draw a row."""
    if sum(cells) != sum(shards):
        raise ValueError("cells and shards hold different numbers of rows")
    rng, room, matrix = random.Random(seed), list(shards), []
    for need in cells:
        rest, row = sum(room), []
        for free in room:
            rest -= free
            row.append(hypergeometric(rng, free, rest, need))
            need -= row[-1]
        room = [free - taken for free, taken in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def _matrix_table(spark: SparkSession, cells: list[int], matrix: list[list[int]], cell_name: str, upto_name: str) -> DataFrame:
    running = []
    for cell, row in zip(cells, matrix, strict=True):
        upto = [0]
        for n in row:
            upto.append(upto[-1] + n)
        running.append({cell_name: cell, upto_name: upto[1:]})
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(running)), f"array<struct<{cell_name}:int,{upto_name}:array<bigint>>>")))


def hypergeometric_shuffle(df: DataFrame, n_shards: int, seed: int = 0, bucket_rows: int = 200_000) -> DataFrame:
    """df with shard (int, from 0) and slot (long, gapless from 0 in its shard); law: counts at most one apart.

    Nulls in any column, repeated rows and empty or very long values ride along untouched: a row's place hangs on its
    position in the scan alone, so a key or text that fills a third of the table spreads like any other. An empty table
    gives no rows. Columns named shard or slot in df are replaced, all others kept, whatever their names. The same files and
    seed give the same shards. A cell is one scan partition, so a task sorts no more rows as the input grows, as long as the
    partitions are MATRIX_CELLS / n_shards at most. bucket_rows: rows that one task sorts for slots; more shards' buckets,
    not longer tasks, at scale.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):  # names that the caller's columns don't have
        mark += "_"
    cell, row, key, upto, at, bucket, before, place = (mark + x for x in ("cell", "row", "key", "upto", "at", "bucket", "before", "in"))
    kept = [f"`{c}`" for c in df.columns if c.lower() not in ("shard", "slot")]
    most_cells = max(1, MATRIX_CELLS // n_shards)
    placed = df.select(*kept, F.pmod(F.spark_partition_id(), F.lit(most_cells)).alias(cell), F.monotonically_increasing_id().alias(row))
    placed = materialize(placed, "shuffle", "zstd")
    found = sorted((r[0], r[1]) for r in placed.groupBy(cell).count().collect())  # most_cells rows at most
    n = sum(c for _, c in found)
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = _matrix_table(df.sparkSession, [c for c, _ in found], communication_matrix([c for _, c in found], sizes, seed), cell, upto)

    within = Window.partitionBy(cell).orderBy(key, row)
    dealt = (
        placed.withColumn(key, F.xxhash64(F.lit(seed), F.lit("cell"), row))
        .withColumn(at, F.row_number().over(within) - 1)
        .join(F.broadcast(matrix), cell)
        .withColumn("shard", F.size(F.filter(upto, lambda u: u <= F.col(at))))
    )
    buckets = max(1, math.ceil(n / n_shards / bucket_rows))
    dealt = dealt.select(*kept, row, "shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), row), F.lit(buckets)).alias(bucket))
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", bucket).count().select("shard", bucket, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    again = Window.partitionBy("shard", bucket).orderBy(F.xxhash64(F.lit(seed), F.lit("slot"), row), row)
    out = dealt.withColumn(place, F.row_number().over(again) - 1).join(starts, ["shard", bucket])
    return out.select(*kept, F.col("shard").cast("int"), (F.col(before) + F.col(place)).cast("long").alias("slot"))
