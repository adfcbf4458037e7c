"""Reads of a mutation log: state as of a logical time, deltas, compaction.

A log has ts (the logical clock), kind (CREATE, INSERT, FORGET, RELATE), an id for records, src and dst for edges.
State is the last write of each id, taken with partial maxima, so an id with very many writes costs no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HistoryPruned(ValueError):
    pass


def check_horizon(ts: int, horizon: int | None) -> None:
    """Reads below the horizon of a compacted log would be partial, so they fail."""
    if horizon is not None and ts < horizon:
        raise HistoryPruned(f"history before ts {horizon} was compacted; asked for {ts}")


def records_as_of(log: DataFrame, columns: list[str], ts: int | None = None, horizon: int | None = None) -> DataFrame:
    """id, columns and created_at of the records alive after the mutations up to ts (None: all)."""
    if ts is not None:
        check_horizon(ts, horizon)
        log = log.where(F.col("ts") <= ts)
    last = log.where("kind in ('INSERT', 'FORGET')").groupBy("id").agg(F.max_by(F.struct("kind", *columns), "ts").alias("r"), F.max("ts").alias("created_at"))
    return last.where("r.kind = 'INSERT'").select("id", *(F.col(f"r.{c}").alias(c) for c in columns), "created_at")


def edges_as_of(log: DataFrame, ts: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The RELATE rows up to ts whose ends were not forgotten later (up to ts). by: columns within which ids are told apart."""
    if ts is not None:
        log = log.where(F.col("ts") <= ts)
    gone = log.where("kind = 'FORGET'").groupBy(*by, "id").agg(F.max("ts").alias("gone"))
    edges = log.where("kind = 'RELATE'")
    for end in ("src", "dst"):
        late = gone.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("id").alias("_id"), F.col("gone").alias("_gone"))
        met = (F.col(end) == F.col("_id")) & (F.col("_gone") > F.col("ts"))
        for c in by:
            met = met & (F.col(c) == F.col(f"_{c}"))
        edges = edges.join(late, met, "left_anti")
    return edges


def history_since(log: DataFrame, ts: int, columns: list[str], horizon: int | None = None) -> DataFrame:
    """Mutations after ts: an id history:<ts>, ts, kind, columns and a score, ts in single precision."""
    check_horizon(ts, horizon)
    own = log.where((F.col("ts") > ts) & F.col("kind").isin("CREATE", "INSERT", "FORGET", "RELATE"))
    subject = [F.col(c) if c != "id" else F.col("id").alias("subject") for c in columns]
    return own.select(F.concat(F.lit("history:"), F.col("ts").cast("string")).alias("id"), "ts", "kind", *subject, F.col("ts").cast("float").alias("score"))


def compact(log: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, int | None]:
    """(the rows of log that reads at the horizon or later need, horizon): declarations, the last write of each live id and live
    edges, with all their columns and times. by: columns within which ids are told apart, such as the memory."""
    horizon = log.agg(F.max("ts")).first()[0]
    last = log.where("kind in ('INSERT', 'FORGET')").groupBy(*by, "id").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in log.columns)), "ts").alias("r"))
    kept = last.select("r.*").where("kind = 'INSERT'").unionByName(log.where("kind = 'CREATE'"))
    if {"src", "dst"} <= set(log.columns):
        kept = kept.unionByName(edges_as_of(log, None, by).select(*(f"`{c}`" for c in log.columns)))
    return kept, horizon
