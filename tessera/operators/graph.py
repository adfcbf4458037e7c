"""Walks over typed edges: bounded paths, numbers of walks, transitive closure.

A graph is node tables and edge tables. A node table has a column id in its own type; an edge table leads from one node table
to another and has seq (append order over all edges), src, dst, weight and props as columns. Ids show as table:id. A hop reads
only the edge tables of its name that leave the tables reached so far, and joins on plain ids; the start is a literal that
reaches the scan. Plain DataFrames of display ids, with the edge's name as a column, are a graph of one table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieve import _own_ids

U64_MAX = 2**64 - 1


@dataclass(frozen=True)
class Step:
    name: str
    outgoing: bool = True
    where: Callable[[DataFrame], Column] | None = None


@dataclass(frozen=True)
class Edges:
    """Edges of one name between two node tables; name None: the frame has a column name, and display ids."""

    name: str | None
    src: str
    dst: str
    frame: DataFrame


Nodes = dict[str, DataFrame]


def _graph(nodes: DataFrame | Nodes, edges: DataFrame | list[Edges]) -> tuple[Nodes, list[Edges]]:
    return (nodes, edges) if isinstance(nodes, dict) else ({"": nodes}, [Edges(None, "", "", edges)])


def _shown(table: str) -> Column:
    return F.concat(F.lit(f"{table}:"), F.col("id").cast("string")) if table else F.col("id")


def _start(nodes: Nodes, start: str) -> tuple[str, Column | None]:
    """(table of the start, predicate for its id over a column id): None where no row can have it."""
    table = start.partition(":")[0] if "" not in nodes else ""
    if table not in nodes:
        return table, None
    own = [start] if not table else _own_ids(nodes[table], table, [start], "id")
    return table, F.lit(own[0]) if own else None


def _hop(edges: list[Edges], step: Step, tables: list[str], start: Column | None = None) -> list[tuple[str, str, DataFrame]]:
    """(table here, table there, edges with seq, here, there, weight) of the edge tables that a step can take from `tables`."""
    out, name = [], step.name.lstrip(":")
    for e in edges:
        here, there = (e.src, e.dst) if step.outgoing else (e.dst, e.src)
        if here not in tables or e.name is not None and e.name.lstrip(":") != name:
            continue
        a, b = ("src", "dst") if step.outgoing else ("dst", "src")
        own = e.frame if e.name is not None else e.frame.where(F.ltrim(F.col("name"), F.lit(":")) == name)
        own = own if start is None else own.where(F.col(a) == start)
        own = own if step.where is None else own.where(step.where(own))
        out.append((here, there, own.select("seq", F.col(a).alias("here"), F.col(b).alias("there"), "weight")))
    return out


def _by_table(rows: list[tuple[str, DataFrame]]) -> Nodes:
    out: Nodes = {}
    for table, frame in rows:
        out[table] = out[table].unionByName(frame) if table in out else frame
    return out


def _union(frames: list[DataFrame], like: DataFrame, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else like.sparkSession.createDataFrame([], schema)


def match(nodes: DataFrame | Nodes, edges: DataFrame | list[Edges], start: str, steps: list[Step]) -> DataFrame:
    """(id, score, seq) of the last frontier: score is the weight, or 0, of the first edge that ever reached the record.

    seq is that hop's first edge to it; the frontier's order. Targets without a record are skipped; a missing start gives no rows.
    """
    nodes, edges = _graph(nodes, edges)
    table, own = _start(nodes, start)
    any_nodes = next(iter(nodes.values()))
    frontier: Nodes = {}
    if own is not None:
        frontier[table] = nodes[table].where(F.col("id") == own).select("id", F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("score")).distinct()
    visits = {t: [f.select("id", "score", F.lit(0).alias("hop"))] for t, f in frontier.items()}
    for i, step in enumerate(steps):
        hops = _hop(edges, step, list(frontier), None if i else own)
        reached = _by_table([(there, e.join(frontier[here].select(F.col("id").alias("here")), "here", "left_semi")) for here, there, e in hops])
        frontier = {}
        for t, rows in reached.items():
            first = rows.groupBy(F.col("there").alias("id")).agg(F.min("seq").alias("seq"), F.coalesce(F.min_by("weight", "seq"), F.lit(0.0)).cast("double").alias("score"))
            known = first.join(nodes[t].select("id"), "id", "left_semi")
            if t in visits:  # a table that an earlier hop reached: its first visit has the score
                before = reduce(DataFrame.unionByName, visits[t]).groupBy("id").agg(F.min_by("score", "hop").alias("earlier"))
                known = known.join(before, "id", "left").select("id", "seq", F.coalesce("earlier", "score").alias("score"))
            visits.setdefault(t, []).append(known.select("id", "score", F.lit(i + 1).alias("hop")))
            frontier[t] = known
    last = [f.select(_shown(t).alias("id"), "score", "seq") for t, f in frontier.items()]
    return _union(last, any_nodes, "id string, score double, seq long")


def match_count(nodes: DataFrame | Nodes, edges: DataFrame | list[Edges], start: str, steps: list[Step]) -> DataFrame:
    """One row: the number of walks along the steps, parallel edges counted each; saturates at the largest 64-bit unsigned."""
    nodes, edges = _graph(nodes, edges)
    table, own = _start(nodes, start)
    cap, any_nodes = F.lit(str(U64_MAX)).cast("decimal(38,0)"), next(iter(nodes.values()))
    walks: Nodes = {}
    if own is not None:
        walks[table] = nodes[table].where(F.col("id") == own).select("id").distinct().withColumn("walks", F.lit(1).cast("decimal(38,0)"))
    for i, step in enumerate(steps):
        hops = _hop(edges, step, list(walks), None if i else own)
        reached = _by_table([(there, e.join(walks[here].withColumnRenamed("id", "here"), "here").select("there", "walks")) for here, there, e in hops])
        walks = {}
        for t, rows in reached.items():
            n = rows.groupBy(F.col("there").alias("id")).agg(F.least(F.sum("walks").cast("decimal(38,0)"), cap).alias("walks"))
            walks[t] = n.join(nodes[t].select("id"), "id", "left_semi")
    whole = _union([w.select("walks") for w in walks.values()], any_nodes, "walks decimal(38,0)")
    return whole.agg(F.least(F.coalesce(F.sum("walks"), F.lit(0)).cast("decimal(38,0)"), cap).alias("count"))


def closure(nodes: DataFrame | Nodes, edges: DataFrame | list[Edges], start: str, steps: list[Step], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, depth, visit): every record reached, the start included, each step to its fixpoint; depth counts levels over all steps.

    visit rises with the order of first visits within a level: by the parent's visit, then by edge. A later step starts from
    all visited but the start. cut ends a frame's lineage (a written table, or checkpoint); the driver sees one emptiness test
    a level, and there are as many levels as the graph has.
    """
    nodes, edges = _graph(nodes, edges)
    table, own = _start(nodes, start)
    if own is None:
        return next(iter(nodes.values())).sparkSession.createDataFrame([], "id string, depth long, visit long")
    zero = F.lit(0).cast("long")
    seen = {table: [cut(nodes[table].where(F.col("id") == own).select("id", zero.alias("depth"), zero.alias("visit")).distinct())]}
    depth = 0
    for i, step in enumerate(steps):
        all_seen = {t: reduce(DataFrame.unionByName, frames) for t, frames in seen.items()}
        frontier = all_seen if i == 0 else {t: f.where(F.col("id") != own) if t == table else f for t, f in all_seen.items()}
        while frontier:
            reached = _by_table([(there, e.join(frontier[here].select(F.col("id").alias("here"), "visit"), "here")) for here, there, e in _hop(edges, step, list(frontier))])
            frontier = {}
            for t, rows in reached.items():
                first = rows.groupBy(F.col("there").alias("id")).agg(F.min(F.struct("visit", "seq")).alias("way")).join(nodes[t].select("id"), "id", "left_semi")
                if t in seen:
                    first = first.join(reduce(DataFrame.unionByName, seen[t]).select("id"), "id", "left_anti")
                # Sorted by ranges, so that an id that rises over the partitions keeps the order and no task sorts a level.
                new = first.orderBy("way").select("id", F.lit(depth + 1).cast("long").alias("depth"), F.monotonically_increasing_id().alias("visit"))
                new = cut(new)
                if not new.isEmpty():
                    frontier[t] = new
            for t, new in frontier.items():
                seen.setdefault(t, []).append(new)
            depth += bool(frontier)
    whole = [reduce(DataFrame.unionByName, frames).select(_shown(t).alias("id"), "depth", "visit") for t, frames in seen.items()]
    return reduce(DataFrame.unionByName, whole)
