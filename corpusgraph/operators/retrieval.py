"""Lexical and vector retrieval, fusion, reranking and diversification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as t
from corpusgraph.functions import vectors as v
from corpusgraph.operators import expansion
from corpusgraph.operators.relational import prefer, top_per_group
from corpusgraph.sources.tables import stored

#: Rows of query vectors that may be broadcast.
MOST_QUERIES = 1000


def match_all(tokens: Column, terms: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, terms)), tokens)) == 0


def proximity(tokens: Column, first: str, second: str, distance: int) -> Column:
    """*second* stands exactly *distance* tokens after *first* somewhere."""
    ahead = F.zip_with(
        tokens, F.slice(tokens, distance + 1, F.size(tokens)), lambda a, b: F.coalesce((a == first) & (b == second), F.lit(False))
    )
    return F.when(F.size(tokens) > distance, F.exists(ahead, lambda x: x)).otherwise(False)


def near_in_text(text: Column | str, first: str, second: str, distance: int) -> Column:
    """:func:`proximity` of a text's tokens, which are made once, and only of texts that have both terms in them."""
    held = t.bound(F.lower(text), lambda x: F.contains(x, F.lit(first)) & F.contains(x, F.lit(second)))
    return F.when(held, t.bound(t.tokens(text), lambda x: proximity(x, first, second, distance))).otherwise(F.lit(False))


def all_in_text(text: Column | str, terms: list[str]) -> Column:
    """All *terms* are tokens of a text; tokens are made only of texts in which all can be found as they are."""
    held = t.bound(F.lower(text), lambda x: reduce(Column.__and__, [F.contains(x, F.lit(term)) for term in terms]))
    return F.when(held, match_all(t.tokens(text), terms)).otherwise(F.lit(False))


def any_in_text(text: Column | str, terms: list[str]) -> Column:
    """Some of *terms* is a token of a text; tokens are made only of texts in which one can be found as it is."""
    held = t.bound(F.lower(text), lambda x: reduce(Column.__or__, [F.contains(x, F.lit(term)) for term in terms]))
    return F.when(held, F.arrays_overlap(t.tokens(text), F.array(*map(F.lit, terms)))).otherwise(F.lit(False))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """An inverted index: ``term``, *key*, ``tf`` and the text's number of tokens ``dl``."""
    toks = docs.select(key, t.tokens(text).alias("ts"))
    return toks.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("term", key, "dl").agg(
        F.count("*").alias("tf")
    )


def bm25(
    docs: DataFrame, key: str, text: str, terms: list[str | list[str]], k1: float = 1.2, b: float = 0.75,
    phrase: str | None = None, boost: float = 1.5,
) -> DataFrame:
    """*key* and ``bm25`` of texts that hold all *terms* (few, distinct); a list of terms counts as one, and any of it will do.

    Counts are taken in place, by text, which is split once in a pass: one pass for the corpus's statistics, one row, and one for
    the scores, over texts in which all terms can be found, without a shuffle of texts.  *phrase*, where the text has it as it is, multiplies by *boost*.
    """

    groups = [[term] if isinstance(term, str) else term for term in terms]

    def times(ts: Column, group: list[str]) -> Column:
        return F.size(F.filter(ts, lambda x: x.isin(*group)))

    def some(lowered: Column, group: list[str]) -> Column:
        return reduce(Column.__or__, [F.contains(lowered, F.lit(term)) for term in group])

    def counts(ts: Column) -> Column:
        return F.struct(F.size(ts).alias("dl"), *[times(ts, group).alias(f"tf{i}") for i, group in enumerate(groups)])

    def counted_in(rows: DataFrame) -> DataFrame:
        # Conditions on what a generator makes are not copied below it, so texts are not split again for them.
        return rows.select(key, text, F.inline(F.array(t.bound(t.tokens(text), counts))))

    held = t.bound(F.lower(text), lambda x: reduce(Column.__and__, [some(x, group) for group in groups]))
    stats = counted_in(docs).agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"),
        *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))],
    )
    hits = counted_in(docs.where(held)).where(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    if phrase is not None:
        score = score * F.when(F.contains(F.lower(text), F.lit(phrase.lower())), boost).otherwise(1.0)
    return hits.select(key, score.alias("bm25"))


def knn(vectors: DataFrame, key: str, column: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The *k* nearest by cosine: *key* and ``similarity``; filters apply before the cut."""
    rows = vectors if where is None else vectors.where(where)
    similarity = v.cosine(v.doubles(column), v.literal(query))
    return rows.select(key, similarity.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def knn_join(queries: DataFrame, query_key: str, vectors: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """The *k* nearest vectors of each query vector, by similarity to 12 digits; ties by *key*.

    Queries of up to MOST_QUERIES go to every task, each of which keeps its own best *k*, by matrix products over
    batches; only those are shuffled.  More are answered by an index of the vectors (:mod:`~corpusgraph.operators.nearest`), exactly too.
    """
    kinds = {**dict(queries.dtypes), **dict(vectors.dtypes)}
    schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, similarity double, _rounded double"

    def best(ids: list, q: np.ndarray, keys: np.ndarray, x: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.argsort(keys, kind="stable")
        keys, x = keys[order], x[order]
        size = np.linalg.norm(x, axis=1)
        scores = (x @ q.T) / np.where(size == 0, np.inf, size)[:, None]
        rounded = np.nan_to_num(np.round(scores, 12), nan=-np.inf)
        for j, i in enumerate(ids):
            own = rounded[:, j]
            near = np.flatnonzero(own >= np.partition(own, -k)[-k]) if len(own) > k else np.arange(len(own))
            top = near[np.argsort(-own[near], kind="stable")[:k]]
            yield pd.DataFrame({query_key: i, key: keys[top], "similarity": scores[top, j], "_rounded": own[top]})

    def unit(rows: list) -> np.ndarray:
        q = np.array(rows, dtype=float)
        return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    few = queries.select(query_key, column).limit(MOST_QUERIES + 1).collect()
    if not few:
        return vectors.sparkSession.createDataFrame([], schema).drop("_rounded")
    if len(few) <= MOST_QUERIES:
        ids, q = [r[0] for r in few], unit([r[1] for r in few])

        def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield from best(ids, q, frame[key].to_numpy(), np.array(frame[column].tolist(), dtype=float))

        found = vectors.select(key, column).mapInPandas(met, schema)
    else:
        from corpusgraph.operators import nearest

        return nearest.search_exactly(nearest.build(vectors, key, column), queries, query_key, column, k)
    return top_per_group(found, [query_key], [F.desc("_rounded"), F.asc(key)], k).drop("_rounded")


def ranked(hits: DataFrame, score: str, key: str, rank: str) -> DataFrame:
    """Hits (a top list, not a corpus) with their places from 1 on."""
    return hits.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), key)))


def rrf(lexical: DataFrame, vector: DataFrame, key: str, k: int = 60, alpha: float = 0.7) -> DataFrame:
    """Reciprocal-rank fusion of two top lists with ``bm25_rank`` and ``vector_rank``.

    ``final_score`` is scaled so that first in both is 1; ties keep the lexical and then the vector order.
    """
    both = lexical.join(vector, key, "full_outer")
    part = lambda weight, rank: F.coalesce(weight / (k + F.col(rank)), F.lit(0.0))
    scored = both.withColumn("rrf_score", part(F.lit(alpha), "bm25_rank") + part(F.lit(1 - alpha), "vector_rank"))
    source = F.when(F.col("vector_rank").isNull(), "bm25_only").when(F.col("bm25_rank").isNull(), "vector_only").otherwise("both")
    return scored.withColumns({"final_score": F.col("rrf_score") * (k + 1), "match_source": source})


def fused_order() -> list[Column]:
    return [F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank")]


def with_rows(hits: DataFrame, key: str, rows: DataFrame, add) -> DataFrame:
    """Each hit of a top list with what *add* makes of its row in *rows*, or nulls.

    The list is written first, as it is read twice: its keys, few by contract, go to the rows, so that only the rows of hits
    are looked at and none are shuffled; and the hits meet those.
    """
    hits = stored(hits)
    return hits.join(add(rows.join(F.broadcast(hits.select(key)), key)), key, "left")


def rerank(hits: DataFrame, key: str, score: str, vectors: DataFrame, column: str, query: list[float], k: int) -> DataFrame:
    """Hits in the order of their larger vectors' similarity (their old score without one), with ``shift``."""
    near = v.cosine(v.doubles(column), v.literal(query)).alias("near")
    joined = with_rows(hits, key, vectors, lambda rows: rows.select(key, near)).withColumn("rerank_score", F.coalesce("near", score))
    old = F.row_number().over(Window.orderBy(F.desc(score), key))
    new = F.row_number().over(Window.orderBy(F.desc(F.round("rerank_score", 12)), key))
    placed = joined.withColumns({"original_rank": old, "new_rank": new}).where(F.col("new_rank") <= k)
    return placed.withColumn("shift", F.col("original_rank") - F.col("new_rank")).drop("near")


def keep_best(hits: DataFrame, canonical: str, score: str, order: Column) -> DataFrame:
    """The best hit of each canonical unit; of equal scores the earliest."""
    return top_per_group(hits, [canonical], [F.desc(score), order])


def prefer_versions(
    hits: DataFrame, canonical: str, version: str, preference: list[str], score: str, listed: str | None = None, tie: list[Column] | None = None,
) -> DataFrame:
    """The hit of the preferred version of each canonical unit, and the versions of all its hits.

    Of hits of equal preference that with the highest *score* is taken, and of these the first by *tie*.  Versions are in the order of preference, then
    of *listed* (the score, if not given) from high to low, nulls last, then of their names.
    """
    place = F.array_position(F.array(*map(F.lit, preference)), F.col(version))
    rank, by = F.when(place > 0, place).otherwise(999), F.col(listed or score)
    order = F.struct(rank.alias("r"), by.isNull().alias("u"), (-by).alias("s"), F.col(version).alias("v"))
    versions = hits.groupBy(canonical).agg(F.sort_array(F.collect_list(order)).alias("l")).select(canonical, F.col("l.v").alias("versions"))
    return prefer(hits, [canonical], version, preference, [F.desc(score), *(tie or [])]).join(versions, canonical)


def diversify(hits: DataFrame, book: str, order: list[Column], k: int) -> DataFrame:
    """*k* hits of a top list: the first k div 2, then the first of books not seen yet, then others in order."""
    place = F.row_number().over(Window.orderBy(*order))
    placed = hits.withColumn("place", place)
    first = F.row_number().over(Window.partitionBy(book).orderBy("place")) == 1
    taken = placed.withColumn("taken", (F.col("place") <= k // 2) | first)
    return taken.orderBy(F.desc("taken"), "place").limit(k)


def mmr(pools: DataFrame, query_key: str, key: str, vector: str, score: str, k: int, weight: float | str = 0.7) -> DataFrame:
    """Maximal marginal relevance over each query's pool (a few hundred rows, which is the contract).

    The first is the top hit; each next one maximises weight * score - (1 - weight) * its greatest
    similarity to what is chosen; of equal ones the earliest wins.  ``place`` counts from 1.  *weight* may be a column, one number a query.
    """
    kinds = dict(pools.dtypes)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([score, key], ascending=[False, True], ignore_index=True)
        x = np.array(frame[vector].tolist(), dtype=float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        relevance, near = frame[score].to_numpy(float), np.full(len(frame), -np.inf)
        chosen: list[int] = []
        share = float(frame[weight].iloc[0]) if isinstance(weight, str) else weight
        while len(chosen) < min(k, len(frame)):
            gain = share * relevance - (1 - share) * near if chosen else relevance.copy()
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
            near = np.maximum(near, x @ x[chosen[-1]])
        return pd.DataFrame({query_key: frame[query_key].iloc[chosen], key: frame[key].iloc[chosen], "place": range(1, len(chosen) + 1)})

    schema = f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, place int"
    return pools.groupBy(query_key).applyInPandas(choose, schema)


def hybrid(
    docs: DataFrame, vectors: DataFrame, key: str, text: str, column: str, terms: list[str], query: list[float],
    canonical: str | None = None, pool: int = 100, k: int = 10, alpha: float = 0.7,
) -> DataFrame:
    """Lexical and vector top lists, fused, the best of each canonical unit, and the first *k* with ``place``."""
    lexical = bm25(docs, key, text, terms).orderBy(F.desc(F.round("bm25", 9)), key).limit(pool)
    lexical = lexical.withColumn("bm25_rank", F.row_number().over(Window.orderBy(F.desc(F.round("bm25", 9)), key)))
    near = ranked(knn(vectors, key, column, query, pool), "similarity", key, "vector_rank")
    hits = rrf(lexical, near, key, alpha=alpha)
    if canonical is not None:
        hits = hits.join(docs.select(key, canonical), key)
        hits = top_per_group(hits, [canonical], fused_order())
    place = F.row_number().over(Window.orderBy(*fused_order()))
    return hits.withColumn("place", place).where(F.col("place") <= k)


def search(
    docs: DataFrame, vectors: DataFrame, key: str, text: str, column: str, wish: str, query: list[float], synonyms: DataFrame,
    canonical: Column, version: str, preference: list[str], pool: int = 100, k: int = 10,
) -> DataFrame:
    """The whole way from a *wish* in words and its vector to the first *k* hits: ``score`` and ``place``.

    The wish's tokens are expanded by *synonyms* (three each) and its kind sets the lexical share; lexical and vector
    lists of *pool* hits are fused, the first 3 k are ranked anew by their vectors, and of each canonical unit the preferred
    version stays, or of equal ones the best.
    """
    spark = docs.sparkSession
    one = spark.createDataFrame([(wish,)], "wish string").select(expansion.query_type(F.col("wish")).alias("kind"), t.tokens("wish").alias("ts"))
    kind, tokens = one.first()
    terms = list(dict.fromkeys(tokens))
    groups = expansion.alternatives(synonyms, terms, 3)
    order = [F.desc(F.round("bm25", 9)), F.asc(key)]
    lexical = bm25(docs, key, text, groups).orderBy(*order).limit(pool)
    lexical = lexical.withColumn("bm25_rank", F.row_number().over(Window.orderBy(*order)))
    near = ranked(knn(vectors, key, column, query, pool), "similarity", key, "vector_rank")
    hits = rrf(lexical, near, key, alpha=expansion.ALPHA.get(kind, 0.5)).orderBy(*fused_order()).limit(3 * k)
    again = rerank(hits, key, "final_score", vectors, column, query, 3 * k)
    known = with_rows(again, key, docs, lambda rows: rows.select(key, version)).withColumn("_unit", canonical)
    best = prefer(known, ["_unit"], version, preference, [F.desc(F.round("rerank_score", 12)), F.asc(key)])
    place = F.row_number().over(Window.orderBy(F.desc(F.round("rerank_score", 12)), key))
    return best.select(key, F.col("rerank_score").alias("score"), place.alias("place")).where(F.col("place") <= k)
