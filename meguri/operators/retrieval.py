"""Lexical, vector and fused retrieval over tables of documents and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from meguri.functions.text import query_terms, term_count, token_count, tokens

#: BM25's saturation and length weight, and the constant of reciprocal-rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, term, tf, dl)``: how often each term stands in each document, and the document's length in tokens."""
    tokenised = docs.select(F.col(key), tokens(text).alias("toks")).withColumn("dl", F.size("toks"))
    return tokenised.select(key, "dl", F.explode("toks").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row ``(n_docs, avg_length)``."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(token_count(text)), F.lit(0.0)).alias("avg_length"))


def bm25(docs: DataFrame, key: str, text: Column, query: str, k: int) -> DataFrame:
    """The ``k`` documents that score highest for a query, ``(key, score)``; ties by key.

    A query's terms are counted in place by native expressions, so nothing is
    exploded: one pass aggregates corpus size, mean length and document
    frequencies to a single row, which is broadcast, the other scores and takes
    the top. For many queries over one corpus, build :func:`postings` instead.
    """
    terms = query_terms(query)
    tf = [f"tf{i}" for i in range(len(terms))]
    counted = docs.select(F.col(key), token_count(text).alias("dl"), *[term_count(text, t).alias(c) for c, t in zip(tf, terms, strict=True)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(f"df{i}") for i, c in enumerate(tf)])
    norm = (1 - B) + B * (F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    score = F.lit(0.0)
    for i, c in enumerate(tf):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * (F.col(c) * (K1 + 1)) / (F.col(c) + K1 * norm)
    found = F.greatest(*[F.col(c) for c in tf], F.lit(0), F.lit(0)) > 0
    scored = counted.filter(found).crossJoin(F.broadcast(stats))
    return scored.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(k)


def dot(a: Column, b: Column) -> Column:
    """The inner product of two float arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest_vectors(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` vectors with the largest inner product with one query vector, ``(key, score)``; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(key), F.round(dot(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(k)


def fuse(first: DataFrame, second: DataFrame, key: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists ``(key, rank)``: ``(key, score, rank_a, rank_b)``, the best ``k``."""
    both = first.select(key, F.col("rank").alias("rank_a")).join(second.select(key, F.col("rank").alias("rank_b")), key, "full_outer")
    share = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return both.withColumn("score", F.round(share("rank_a") + share("rank_b"), 5)).select(key, "score", "rank_a", "rank_b").orderBy(F.desc("score"), F.asc(key)).limit(k)


def ranked(scored: DataFrame, key: str) -> DataFrame:
    """A bounded top-k list with its ranks from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))).cast("bigint"))


def hybrid(docs: DataFrame, key: str, text: Column, vectors: DataFrame, vector: str, query: str, query_vector: list[float], k: int) -> DataFrame:
    """Lexical and vector retrieval with a beam of ``max(4k, 50)`` each, fused by reciprocal ranks."""
    beam = max(4 * k, 50)
    return fuse(ranked(bm25(docs, key, text, query, beam), key), ranked(nearest_vectors(vectors, key, vector, query_vector, beam), key), key, k)


def half_to_float(bits: Column) -> Column:
    """IEEE half-precision bit patterns (ints) as floats."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy(np.uint16).view(np.float16).astype(np.float32), index=x.index)

    return F.pandas_udf(run, T.FloatType())(bits)
