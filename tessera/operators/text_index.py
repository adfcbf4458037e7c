"""An inverted index of a text column, written once per version of its table and read by the terms of a query.

Tokens are counted where their texts are read, so that of a term only lists of the rows that hold it move. Postings lie in
folders by a hash of their term, so a query reads the folders of its own terms and no text. Statistics and lengths are stored
with them. A version is the table's clock, or any number that changes when the table does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scores import bm25_of_counts, n_tokens, query_terms, spaced
from tessera.operators.retrieve import spread, top

#: Characters of text that a task counts at a time, and postings that it holds before it passes their lists on.
SLICE_CHARS, HELD_POSTINGS = 4_000_000, 1_000_000


def _counted(ids: pa.Array, n: pa.Array, words: pa.Array) -> pa.Table:
    """term, id, n, tf of texts of spaced() tokens that have any."""
    lists = pc.split_pattern(pc.utf8_trim(words, " "), "  ")
    terms = lists.flatten().dictionary_encode()
    row = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    pairs, tf = np.unique(row * len(terms.dictionary) + np.asarray(terms.indices), return_counts=True)
    row, term = np.divmod(pairs, len(terms.dictionary))
    return pa.table({"term": terms.dictionary.take(pa.array(term)), "id": ids.take(pa.array(row)), "n": n.take(pa.array(row)), "tf": pa.array(tf, pa.int32())})


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term of some of a task's texts one row of lists: ids, lengths and counts."""

    def passed_on(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        every = pa.concat_tables(held).combine_chunks()
        coded = every["term"].combine_chunks().dictionary_encode()
        order = np.argsort(np.asarray(coded.indices), kind="stable")
        starts = np.searchsorted(np.asarray(coded.indices)[order], np.arange(len(coded.dictionary) + 1))
        sorted_ = every.take(pa.array(order))
        of = lambda c: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), sorted_[c].combine_chunks())
        yield from pa.table({"term": coded.dictionary, "ids": of("id"), "ns": of("n"), "tfs": of("tf")}).to_batches(max_chunksize=10_000)

    held: list[pa.Table] = []
    for batch in batches:
        batch = batch.filter(pc.greater(pc.fill_null(batch.column("n"), 0), 0))  # here, as a filter in front would take the texts apart once more
        sizes, start = np.asarray(pc.binary_length(batch.column("words"))), 0
        while start < batch.num_rows:
            some = batch.slice(start, max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_CHARS))))
            held.append(_counted(some.column("id"), some.column("n"), some.column("words")))
            start += some.num_rows
            if sum(t.num_rows for t in held) >= HELD_POSTINGS:
                yield from passed_on(held)
                held = []
    if held:
        yield from passed_on(held)


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    @staticmethod
    def _folder(path: str, text: str, version: int) -> str:
        return f"{path.rstrip('/')}/{text}-{version}"

    @classmethod
    def of(cls, df: DataFrame, text: str, path: str, version: int, buckets: int = 64) -> TextIndex:
        """The index of df's text column, by id: the one under path if it was written for this version, else written now.

        Ids tell rows apart; a null text counts as no document, an empty one as a document of no tokens. The statistics are
        written last and mark the index complete.
        """
        spark, folder = df.sparkSession, cls._folder(path, text, version)
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/statistics/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            rows = spread(df.select("id", F.col(f"`{text}`").alias("text"))).select("id", spaced(F.col("text")).alias("words")).withColumn("n", n_tokens(F.col("words")))
            kind = df.schema["id"].dataType.simpleString()
            lists = rows.mapInArrow(_lists, f"term string, ids array<{kind}>, ns array<int>, tfs array<int>")
            bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
            by_bucket = lists.select("term", "ids", "ns", "tfs", bucket).repartition("bucket", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(8)))  # a common term is in several files
            by_bucket.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
            rows.select("id", "n").write.mode("overwrite").parquet(f"{folder}/lengths")
            lengths = spark.read.parquet(f"{folder}/lengths").where("n is not null")
            lengths.agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("tokens")).write.mode("overwrite").parquet(f"{folder}/statistics")
        return cls(spark, folder, buckets)

    def matches(self, query: str) -> DataFrame:
        """id and score of the rows that hold any of the query's terms."""
        terms = query_terms(query)
        if not terms:
            return self.spark.read.parquet(f"{self.folder}/lengths").select("id", F.lit(0.0).alias("score")).limit(0)
        n_texts, n_words = self.spark.read.parquet(f"{self.folder}/statistics").first()
        hashes = self.spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms)).first()
        own = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("bucket").isin(sorted(set(hashes))) & F.col("term").isin(terms))
        holding = {r.term: r.n for r in own.groupBy("term").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row a term of the query
        held = own.select("term", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("ns").alias("n"), F.col("tfs").alias("tf"))).alias("p"))
        counts = held.select("term", "p.*").groupBy("id", "n").agg(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf_{k}") for k, t in enumerate(terms)))
        statistics = n_texts, max(1.0, (n_words or 0) / max(1, n_texts)), [holding.get(t, 0) for t in terms]
        return counts.select("id", bm25_of_counts(statistics).alias("score"))

    def scores(self, query: str) -> DataFrame:
        """id and score of every row; rows that don't match have 0."""
        rows = self.spark.read.parquet(f"{self.folder}/lengths").select("id")
        return rows.join(self.matches(query), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def top(self, query: str, k: int, **paging) -> DataFrame:
        return top(self.scores(query), k, **paging)
