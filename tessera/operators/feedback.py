"""Orders by what edges say of a record: votes, decayed feedback, salience.

Edges are pre-aggregated by target before they meet the records, so a record with very many votes costs partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def votes_of(edges: DataFrame, name: str = "voted") -> DataFrame:
    """The edges of that name, leading colons on either side aside."""
    return edges.where(F.ltrim(F.col("name"), F.lit(":")) == name.lstrip(":"))


def _joined(records: DataFrame, per_target: DataFrame) -> DataFrame:
    return records.join(per_target.withColumnRenamed("dst", "id"), "id", "left")


def laplace_score(records: DataFrame, votes: DataFrame) -> DataFrame:
    """score = (sum of weights + 1) / (votes + 2); a vote's weight, else its value, else 1."""
    w = F.coalesce("weight", "value", F.lit(1.0)).cast("double")
    per = votes.groupBy("dst").agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_n"))
    return _joined(records, per).withColumn("score", (F.coalesce("_w", F.lit(0.0)) + 1) / (F.coalesce("_n", F.lit(0)) + 2)).drop("_w", "_n")


def net_votes(records: DataFrame, votes: DataFrame) -> DataFrame:
    """score = votes of value 1 less votes of value -1; others don't count."""
    per = votes.groupBy("dst").agg((F.count_if(F.col("value") == 1) - F.count_if(F.col("value") == -1)).alias("_net"))
    return _joined(records, per).withColumn("score", F.coalesce("_net", F.lit(0)).cast("double")).drop("_net")


def decayed_feedback(records: DataFrame, votes: DataFrame) -> DataFrame:
    """score = sum of signs over 1 + age, age being counted from the newest vote of the whole store."""
    newest = votes.agg(F.max("created_at")).first()[0]
    if newest is None:
        return records.withColumn("score", F.lit(0.0))
    sign = F.when(F.col("value") == 1, 1.0).when(F.col("value") == -1, -1.0).otherwise(0.0)
    age = F.greatest(F.lit(0), F.lit(newest) - F.col("created_at"))
    per = votes.groupBy("dst").agg(F.sum(sign / (1 + age)).alias("_f"))
    return _joined(records, per).withColumn("score", F.coalesce("_f", F.lit(0.0))).drop("_f")


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def strength(records: DataFrame, ends: DataFrame, clock: int) -> DataFrame:
    """records with strength: half recency, half frequency over incident edges. ends: a column id, a row an edge and end (a self-loop one)."""
    per = ends.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    n, age = F.coalesce("_n", F.lit(0)), F.greatest(F.lit(0), F.lit(clock) - F.col("created_at"))
    return records.join(per, "id", "left").withColumn("strength", 0.5 / (1 + age) + 0.5 * n / (n + 1)).drop("_n")


def incident(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))


def salience(records: DataFrame, votes: DataFrame, weights: tuple[float, float, float, float] | None = None, ends: DataFrame | None = None, clock: int = 0) -> DataFrame:
    """records may hold similarity and importance. Without weights 0.7 similarity + 0.3 score, or the score alone without similarity."""
    scored = laplace_score(records, votes)
    has = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in records.columns else F.lit(0.0)
    if weights is None:
        total = 0.7 * F.col("similarity") + 0.3 * _clamp(F.col("score")) if "similarity" in records.columns else _clamp(F.col("score"))
        return scored.withColumn("score", total)
    a, b, c, d = weights
    if ends is not None:
        scored = strength(scored, ends, clock)
    else:
        scored = scored.withColumn("strength", F.lit(0.0))
    return scored.withColumn("score", a * has("similarity") + b * F.col("strength") + c * _clamp(has("importance")) + d * _clamp(F.col("score"))).drop("strength")
