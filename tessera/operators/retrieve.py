"""SELECT as a pipeline over one table: filter, score, order, offset and limit, projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import RRF, bm25_of_counts, corpus_statistics, cosine, query_terms, term_counts
from tessera.functions.values import DocField, Field
from tessera.operators import feedback
from tessera.stored import stored


class UnknownSortField(ValueError):
    pass


def field(df: DataFrame, name: str) -> Field:
    """A typed predicate builder; a key the table doesn't have never matches."""
    return Field(name, df.schema[name].dataType)


def has_embedding(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def display_id(table: str, col: str = "id") -> Column:
    return F.concat(F.lit(f"{table}:"), F.col(col).cast("string"))


def parse_id(text: str) -> tuple[str, int | str] | None:
    """(table, id) of a display form: digits that fit 64 bits unsigned are a number, all else a string; None if a part is empty."""
    table, colon, own = text.partition(":")
    if not colon or not table or not own:
        return None
    digits = own.isascii() and own.isdigit()
    return table, int(own) if digits and len(own.lstrip("0")) <= 20 and int(own) < 2**64 else own


def _own_ids(df: DataFrame, table: str, ids: list[str], col: str) -> list:
    """The ids of this table that its column can hold, in the column's type: display forms are compared, so 007 is not 7."""
    prefix, kind = f"{table}:", df.schema[col].dataType.simpleString()
    own = [i[len(prefix) :] for i in ids if i.startswith(prefix)]
    if kind not in ("bigint", "int"):
        return own
    most = 2**63 if kind == "bigint" else 2**31
    plain = [i for i in own if i.removeprefix("-").isascii() and i.removeprefix("-").isdigit() and len(i) <= 20]
    return [int(i) for i in plain if str(int(i)) == i and -most <= int(i) < most]


def id_in(df: DataFrame, table: str, ids: list[str], col: str = "id") -> DataFrame:
    """Rows whose display form is one of ids; = is a list of one. Numeric ids become a predicate on the column itself, so that it
    reaches the scan; an id beyond the column's range is none of them."""
    own = _own_ids(df, table, ids, col)
    return df.where(F.col(col).isin(own)) if own else df.limit(0)


def id_not(df: DataFrame, table: str, id_: str, col: str = "id") -> DataFrame:
    """Rows whose display form is another."""
    own = _own_ids(df, table, [id_], col)
    return df.where(F.col(col) != own[0]) if own else df


def count_rows(df: DataFrame) -> DataFrame:
    """One row; scores, orders and limits never change it."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def order_by_field(df: DataFrame, name: str, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Absent values lowest; ties by ascending id in both directions."""
    if name not in df.columns:
        raise UnknownSortField(name)
    return page(df, [field(df, name).order(descending), F.col("id").asc()], offset, limit)


def project_body(df: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Document rows with the listed keys of their bodies; a key that a body lacks is left out."""
    return df.withColumn(body, F.map_filter(body, lambda k, _: k.isin(keys)))


def order_by_key(df: DataFrame, table: DataFrame, key: str, descending: bool = False, offset: int = 0, limit: int | None = None, body: str = "body") -> DataFrame:
    """Document rows by a key of their bodies, absent values lowest, ties by ascending id. A key that no record of the whole table
    has is an error, unless there are no rows."""
    if not df.isEmpty() and table.where(F.map_contains_key(F.col(body), F.lit(key))).isEmpty():
        raise UnknownSortField(key)
    return page(df, [DocField(key, body).order(descending), F.col("id").asc()], offset, limit)


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def recency(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    return page(df, [F.col("created_at").desc(), F.col("id").asc()], offset, limit)


def similarity(df: DataFrame, query: list[float], column: str = "embedding", score: str = "score", exact32: bool = False) -> DataFrame:
    """Rows without an embedding score 0 and stay."""
    return df.withColumn(score, cosine(F.col(column), query, exact32))


def top(df: DataFrame, k: int, score: str = "score", offset: int = 0, limit: int | None = None) -> DataFrame:
    """The k best by score, ties by id; the smaller of k and limit counts, after the offset."""
    return page(df, [F.col(score).desc(), F.col("id").asc()], offset, k if limit is None else min(k, limit))


def knn(df: DataFrame, query: list[float], k: int, **paging) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    return top(similarity(df, query), k, **paging)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions, before work that takes far longer than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lexical_scores(df: DataFrame, text: str, query: str, keep: list[str | Column]) -> DataFrame:
    """keep and score, for every row. The texts are read once, into a stored table of token counts; statistics and scores come
    from that."""
    terms = query_terms(query)
    if not terms:
        return df.select(*keep, F.lit(0.0).alias("score"))
    held = df.select(*keep, F.col(f"`{text}`").alias("_text"))
    counts = stored(term_counts(spread(held), "_text", terms, [f"`{c}`" for c in held.columns[:-1]]), "counts")
    return counts.select(*(f"`{c}`" for c in counts.columns[: len(counts.columns) - 1 - len(terms)]), bm25_of_counts(corpus_statistics(counts, len(terms))).alias("score"))


def lexical(df: DataFrame, text: str, query: str, k: int, keep: tuple[str, ...] = (), **paging) -> DataFrame:
    """id, keep and score of the k best by BM25; fetch() adds other columns."""
    return top(lexical_scores(df, text, query, ["id", *keep]), k, **paging)


def fetch(df: DataFrame, hits: DataFrame, columns: list[str]) -> DataFrame:
    """hits, few rows, with columns of df by id."""
    return F.broadcast(hits).join(df.select("id", *columns), "id")


#: Narrow rows that one task ranks; more are cut into ranges.
ROWS_A_TASK = 1_000_000


def ranks(df: DataFrame, score: str, rank: str, parts: int | None = None) -> DataFrame:
    """df with the 1-based rank of each row by score descending, then id.

    More than ROWS_A_TASK rows are cut into ranges of (score, id) at quantiles of the scores, so that no task holds them all; a
    range's rank starts after all rows of those before it. Rows of one score that fill more than a range are cut by id. df is
    read several times: a stored, narrow table.
    """
    spark = df.sparkSession
    if parts is None:
        n = df.count()
        parts = 1 if n <= ROWS_A_TASK else max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_TASK))
    if parts <= 1:
        return df.withColumn(rank, F.row_number().over(Window.orderBy(F.col(score).desc(), F.col("id").asc())).cast("long"))
    at = [i / parts for i in range(1, parts)]
    cuts, ids = df.agg(F.percentile_approx(score, at, 1000), F.percentile_approx("id", at, 1000)).first()
    cuts, ids = sorted(set(cuts or [])), sorted(set(ids or []))
    count_over = lambda col, values: F.size(F.filter(F.array(*map(F.lit, values)), lambda c: c < col)) if values else F.lit(0)
    # Scores equal to a cut are ranges of their own, so only they can be cut by id.
    is_cut = F.col(score).isin(cuts) if cuts else F.lit(False)
    coarse = 2 * count_over(F.col(score), cuts) + is_cut.cast("int")
    fine = F.when(is_cut, count_over(F.col("id"), ids)).otherwise(0)
    cut = df.withColumn("_coarse", -coarse).withColumn("_fine", fine)
    before = Window.orderBy("_coarse", "_fine").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_coarse", "_fine").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # a row a range
    within = Window.partitionBy("_coarse", "_fine").orderBy(F.col(score).desc(), F.col("id").asc())
    ranked = cut.withColumn("_in", F.row_number().over(within)).join(F.broadcast(starts), ["_coarse", "_fine"])
    return ranked.withColumn(rank, (F.col("_before") + F.col("_in")).cast("long")).drop("_coarse", "_fine", "_before", "_in")


def fused_scores(df: DataFrame, text: str, query: str, vector: list[float], keep: list[str | Column]) -> DataFrame:
    """keep, lexical, semantic, rank_lex, rank_vec and score: reciprocal-rank fusion of the lexical and the vector ranking over all
    rows, those that score 0 included. Texts and vectors are read once; the rest works on a narrow stored table."""
    both = stored(lexical_scores(similarity(df, vector, score="semantic"), text, query, [*keep, "semantic"]).withColumnRenamed("score", "lexical"), "scores")
    ranked = ranks(ranks(both, "lexical", "rank_lex"), "semantic", "rank_vec")
    return ranked.withColumn("score", 1 / (RRF + F.col("rank_lex")) + 1 / (RRF + F.col("rank_vec")))


def hybrid(df: DataFrame, text: str, query: str, vector: list[float], k: int, keep: tuple[str, ...] = (), **paging) -> DataFrame:
    """id, keep, ranks and score of the k best by reciprocal-rank fusion; fetch() adds other columns."""
    return top(fused_scores(df, text, query, vector, ["id", *keep]), k, **paging)


@dataclass(frozen=True)
class Order:
    """ORDER BY: field (with a name), recency, similarity, score, votes, feedback or salience (with four weights or none)."""

    by: str
    name: str = ""
    descending: bool = False
    weights: tuple[float, float, float, float] | None = None


def select(
    df: DataFrame, text: tuple[str, str, int | None] | None = None, near: tuple[list[float], int] | None = None, order: Order | None = None,
    offset: int = 0, limit: int | None = None, keep: tuple[str, ...] = (), votes: DataFrame | None = None, ends: DataFrame | None = None, clock: int = 0,
) -> DataFrame:
    """id, keep and score of a SELECT in any mode and order. text: (column, query, k or None), near: (vector, k); both are hybrid.

    A row shows the fused score, else the lexical one, else that of a score order, else its similarity, else 0. Field and
    recency orders hold in every mode; score orders only where there is no text query; without any order rows come by score,
    and by id in a plain scan. Ties go by id. The least of all k and limit caps the rows, after the offset.
    """
    if near is not None and near[1] <= 0:
        raise ValueError("k must be positive")
    by = order.by if order else None
    if by == "similarity" and near is None:
        raise ValueError("an order by similarity needs a vector")
    if by == "field" and order.name not in df.columns:
        raise UnknownSortField(order.name)
    sorted_by = {"field": order.name if order else "", "recency": "created_at"}.get(by)
    carried = list(dict.fromkeys(["id", *keep, *([sorted_by] if sorted_by else [])]))
    if text and near:
        rows = fused_scores(df, text[0], text[1], near[0], carried).select(*carried, "score")
    elif text:
        rows = lexical_scores(df, text[0], text[1], carried)
    else:
        rows = similarity(df, near[0], score="similarity") if near else df
        if by in ("score", "votes", "feedback", "salience"):
            if votes is None:
                raise ValueError(f"an order by {by} needs the votes")
            scored = {"score": feedback.laplace_score, "votes": feedback.net_votes, "feedback": feedback.decayed_feedback}.get(by)
            rows = scored(rows, votes) if scored else feedback.salience(rows, votes, order.weights, ends, clock)
        else:
            rows = rows.withColumn("score", F.col("similarity") if near else F.lit(0.0))
        rows = rows.select(*carried, "score")
    caps = [k for k in (near and near[1], text and text[2], limit) if k is not None]
    if sorted_by:
        keys = [field(df, order.name).order(order.descending)] if by == "field" else [F.col("created_at").desc()]
    else:
        keys = [F.col("score").desc()] if order or text or near else []
    out = page(rows, [*keys, F.col("id").asc()], offset, min(caps) if caps else None)
    return out.select("id", *keep, "score")
