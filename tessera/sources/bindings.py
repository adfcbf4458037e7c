"""The test tables seen as records, edges, votes and mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import Edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars", (F.col("doc_id") + 1).alias("created_at"))


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), "label", "embedding", (F.col("vec_id") + 1).alias("created_at"))


def nodes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The records of the commerce graph by table, with their numeric ids, and the conversation turns."""
    of = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}
    frames = {t: table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in of.items()}
    return frames | {"turn": table(spark, sf_dir, "conversations").select(F.format_string("c%d_t%d", "conv_id", "turn").alias("id"))}


def edges(spark: SparkSession, sf_dir: str) -> list[Edges]:
    """in_region, in_nation, placed, contains and follows_from, with seq as append order."""
    step = 10**13

    def edge(name: str, src: str, dst: str, frame: DataFrame, base: int, seq: Column, a: Column, b: Column, **props: Column) -> Edges:
        props = {"weight": F.lit(None).cast("double")} | props
        return Edges(name, src, dst, frame.select((F.lit(base) + seq).cast("long").alias("seq"), a.alias("src"), b.alias("dst"), *(c.alias(n) for n, c in props.items())))

    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    return [
        edge("in_region", "nation", "region", t("nation"), 0, c("n_nationkey"), c("n_nationkey"), c("n_regionkey")),
        edge("in_nation", "customer", "nation", t("customer"), step, c("c_custkey"), c("c_custkey"), c("c_nationkey")),
        edge("placed", "customer", "orders", t("orders"), 2 * step, c("o_orderkey"), c("o_custkey"), c("o_orderkey")),
        edge("contains", "orders", "part", t("lineitem"), 3 * step, c("l_orderkey") * 10 + c("l_linenumber"), c("l_orderkey"), c("l_partkey"),
             weight=c("l_discount"), quantity=c("l_quantity"), returnflag=c("l_returnflag")),
        edge("follows_from", "turn", "turn", t("conversations").where("turn > 0"), 4 * step, c("conv_id") * 1000 + c("turn"),
             F.format_string("c%d_t%d", "conv_id", "turn"), F.format_string("c%d_t%d", c("conv_id"), c("turn") - 1)),
    ]


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voted edges to documents: value 1 or -1 by quality; weight 0.5 where toxic."""
    v = table(spark, sf_dir, "labels")
    value = F.when(F.col("quality") == 1, 1.0).otherwise(-1.0)
    return v.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("dst"), value.alias("value"), F.when(F.col("toxic") == 1, 0.5).alias("weight"), (F.col("doc_id") + 1).alias("created_at"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a log: an error forgets its user, anything else writes the user's record."""
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select((F.col("event_id") + 1).alias("ts"), F.when(gone, "FORGET").otherwise("INSERT").alias("kind"), F.col("user_id").alias("id"), F.when(~gone, F.col("event_type")).alias("event_type"), F.when(~gone, F.col("value")).alias("value"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("mem"))
