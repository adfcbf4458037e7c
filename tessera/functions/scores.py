"""Similarity and relevance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual constants of BM25 and of reciprocal-rank fusion.
K1, B, RRF = 1.2, 0.75, 60
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_TOKEN = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def cosine(vector: Column, query: list[float], exact32: bool = False) -> Column:
    """Cosine over the shared dimensions; 0 for a missing vector or a zero norm. exact32 sums in float32, in order."""
    kind = "float" if exact32 else "double"
    zero, q = F.lit(0.0).cast(kind), F.array(*(F.lit(float(x)) for x in query)).cast(f"array<{kind}>")
    n = F.least(F.size(vector), F.lit(len(query)))
    a, b = F.slice(vector.cast(f"array<{kind}>"), 1, n), F.slice(q, 1, n)
    fold = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), zero, lambda s, t: s + t)
    norm = F.sqrt(fold(a, a)).cast(kind) * F.sqrt(fold(b, b)).cast(kind)
    return F.coalesce(F.when(norm != 0, (fold(a, b) / norm).cast(kind)), zero)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits or of non-ASCII characters; only A to Z are lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), NOT_A_TOKEN), lambda t: t != "")


#: What lies between tokens, as the ASCII characters that it is.
BETWEEN = r"[\x00-/:-@\[-`{-\x7f]+"
#: The letters beyond ASCII whose lower case holds an ASCII letter.
FOLD_TO_ASCII = "\u0130\u212a"


def spaced(text: Column, ascii_terms: bool = False) -> Column:
    """The tokens of a text with two spaces between them and one at either end, so that each has spaces of its own.

    ascii_terms: only ASCII terms will be looked for, so letters beyond ASCII may be folded too, which is far cheaper.
    """
    low = F.translate(text, UPPER, LOWER)
    if ascii_terms:
        for letter in FOLD_TO_ASCII:
            text = F.replace(text, F.lit(letter), F.lit("\x80"))
        low = F.lower(text)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, BETWEEN, "  ")), F.lit(" "))


def n_tokens(words: Column) -> Column:
    """Of a text of spaced() tokens; two spaces alone are none."""
    length = F.char_length(words)
    return ((length - F.char_length(F.replace(words, F.lit(" "), F.lit("")))) / 2).cast("int") - (length == 2).cast("int")


def occurrences(words: Column, term: str) -> Column:
    """How often a token is in a text of spaced() tokens: plain string functions, which stay in generated code."""
    gone = F.char_length(F.replace(words, F.lit(f" {term} "), F.lit("")))
    return ((F.char_length(words) - gone) / (len(term) + 2)).cast("int")


def query_terms(query: str) -> list[str]:
    """Distinct tokens of the query in their order."""
    import re

    return list(dict.fromkeys(t for t in re.split("[^0-9a-z\x80-\U0010ffff]+", query.translate(str.maketrans(UPPER, LOWER))) if t))


def term_counts(df: DataFrame, text: str, terms: list[str], keep: list[str | Column]) -> DataFrame:
    """keep, n (tokens; null without a text) and tf_0, tf_1 ... of the terms: one pass over the texts."""
    words = df.select(*keep, spaced(F.col(f"`{text}`"), all(t.isascii() for t in terms)).alias("_words"))
    kept = words.columns[:-1]
    return words.select(*(F.col(f"`{c}`") for c in kept), n_tokens(F.col("_words")).alias("n"), *(occurrences(F.col("_words"), t).alias(f"tf_{k}") for k, t in enumerate(terms)))


def corpus_statistics(counts: DataFrame, n_terms: int) -> tuple[int, float, list[int]]:
    """(texts, mean length, texts with each term) of a frame of term counts: one aggregate."""
    got = counts.where("n is not null").agg(F.count(F.lit(1)), F.sum("n"), *(F.count_if(F.col(f"tf_{k}") > 0) for k in range(n_terms))).first()
    return got[0], max(1.0, (got[1] or 0) / max(1, got[0])), list(got[2:])


def bm25_of_counts(statistics: tuple[int, float, list[int]]) -> Column:
    """The score as a column over n and tf_0, tf_1 ..., terms in their order; 0 without a text."""
    n, average, holding = statistics
    total, length = F.lit(0.0), 1 - B + B * F.col("n") / average
    for k, df_term in enumerate(holding):
        df_term, tf = max(1, df_term), F.col(f"tf_{k}")
        idf = F.log(F.lit(1 + (n - df_term + 0.5) / (df_term + 0.5)))
        total = total + F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * length)).otherwise(0.0)
    return F.coalesce(total, F.lit(0.0))


def bm25(df: DataFrame, text: str, query: str, score: str = "score") -> DataFrame:
    """df with a double column score: BM25 of its text column; rows that don't match, and those without text, have 0.

    Texts are read for the corpus statistics and again for the scores; retrieve.lexical reads them once.
    """
    terms = query_terms(query)
    if not terms:
        return df.withColumn(score, F.lit(0.0))
    statistics = corpus_statistics(term_counts(df, text, terms, []), len(terms))
    counted = term_counts(df, text, terms, [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")])
    return counted.select("_row.*", bm25_of_counts(statistics).alias(score))


def four_decimals(score: Column) -> Column:
    """The text of a score: four decimals, exact ties to even, no thousands signs."""
    return F.when(F.isnan(score.cast("double")), F.lit("NaN")).otherwise(F.replace(F.format_number(score.cast("double"), 4), F.lit(","), F.lit("")))
