"""Hybrid search for tables of wishes: each names a query and how it is to be answered, and what wishes have in common is done once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as t
from corpusgraph.functions import vectors as v
from corpusgraph.operators import lexical, nearest, retrieval
from corpusgraph.operators.relational import at_most, top_per_group
from corpusgraph.sources.tables import stored

#: Columns of a wish beside its key and that of its query: the lexical share, whether the query is expanded, whether hits are ranked anew by
#: their vectors, whose vectors are searched, and the weight of relevance against variety (null: no matter).
WISH = ("alpha", "expand", "rerank", "source", "mmr")
#: Configurations that every query may be asked with.
MOST_CONFIGURATIONS = 1000


def grid(configurations: DataFrame, queries: DataFrame, query_key: str) -> DataFrame:
    """A wish for every configuration (``config`` and WISH, MOST_CONFIGURATIONS at most) and query: ``wish``, ``config``, *query_key* and WISH."""
    few = at_most(configurations.select("config", *WISH), MOST_CONFIGURATIONS)
    both = queries.select(query_key).crossJoin(F.broadcast(few))
    return both.select(F.concat_ws("/", "config", query_key).alias("wish"), "config", query_key, *WISH)


def lexical_lists(index: lexical.LexicalIndex, wishes: DataFrame, queries: DataFrame, query_key: str, text: str, more: str, pool: int) -> DataFrame:
    """The best *pool* texts of every query as it is (*text*) and expanded (with *more* after it), as far as wishes ask for it, in one search.

    ``expand``, *query_key*, the index's key, ``bm25`` and ``bm25_rank``; a written table.
    """
    words = F.when(F.col("expand"), F.concat_ws(" ", text, more)).otherwise(F.col(text))
    forms = wishes.select(query_key, "expand").distinct().join(queries.select(query_key, text, more), query_key)
    asked = stored(forms.select(query_key, "expand", F.concat_ws("/", query_key, "expand").alias("_form"), words.alias("_words")))
    found = lexical.top_k(index, asked, "_form", "_words", pool)
    return stored(found.join(asked.drop("_words"), "_form").select("expand", query_key, index.key, "bm25", F.col("place").alias("bm25_rank")))


def phrase_boosted(lists: DataFrame, query_key: str, docs: DataFrame, key: str, body: str, queries: DataFrame, text: str, boost: str) -> DataFrame:
    """Lexical lists in which texts that have the query as it is, in any case, count *boost* times as much, placed anew; a written table.

    Only the texts of the lists are looked at.
    """
    wanted = docs.join(lists.select(key).distinct(), key, "left_semi").select(key, F.lower(body).alias("_body"))
    met = lists.join(wanted, key).join(queries.select(query_key, F.lower(text).alias("_phrase"), F.col(boost).alias("_boost")), query_key)
    score = F.col("bm25") * F.when((F.col("_phrase") != "") & F.contains("_body", F.col("_phrase")), F.col("_boost")).otherwise(1.0)
    order = Window.partitionBy(query_key, "expand").orderBy(F.desc(F.round("bm25", lexical.DIGITS)), key)
    scored = met.select("expand", query_key, key, score.alias("bm25"))
    return stored(scored.withColumn("bm25_rank", F.row_number().over(order)))


def vector_lists(sources: dict[str, tuple[nearest.VectorIndex, DataFrame]], query_key: str, column: str, pool: int) -> DataFrame:
    """The nearest *pool* vectors of every query in each source (an index, and the queries' vectors): ``source``, *query_key*, the key and
    ``vector_rank``; a written table."""
    out = None
    for source, (index, queries) in sources.items():
        order = Window.partitionBy(query_key).orderBy(F.desc(F.round("similarity", 12)), index.key)
        found = nearest.search_exactly(index, queries, query_key, column, pool).withColumn("vector_rank", F.row_number().over(order))
        rows = found.select(F.lit(source).alias("source"), query_key, index.key, "vector_rank")
        out = rows if out is None else out.unionByName(rows)
    return stored(out)


def answers(
    wishes: DataFrame, query_key: str, key: str, texts: DataFrame, near: DataFrame, vectors: DataFrame, column: str, queries: DataFrame, k: int,
) -> DataFrame:
    """The first *k* hits of every wish: ``wish``, *key*, ``score`` and ``place``.

    The lists *texts* and *near* (:func:`lexical_lists`, :func:`vector_lists`) are fused with each wish's share; of the first 3 *k* those that are to be
    ranked anew get the similarity of their vector in *vectors* to the query's in *queries* (both in *column*) for a score, and those for
    variety are chosen by it.  All wishes go through the same joins; a wish's hits are few by contract.
    """
    wishes = stored(wishes.select("wish", query_key, *WISH))
    found = wishes.join(texts, [query_key, "expand"]).select("wish", key, "bm25_rank")
    close = wishes.join(near, [query_key, "source"]).select("wish", key, "vector_rank")
    both = found.join(close, ["wish", key], "full_outer").join(wishes, "wish")
    part = lambda weight, rank: F.coalesce(weight / (60 + F.col(rank)), F.lit(0.0))
    fused = both.withColumn("rrf_score", part(F.col("alpha"), "bm25_rank") + part(1 - F.col("alpha"), "vector_rank"))
    order = Window.partitionBy("wish").orderBy(*retrieval.fused_order(), key)
    hits = stored(fused.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= 3 * k).select("wish", query_key, key, "rrf_score", "rerank", "mmr", "_p"))

    wanted = vectors.join(hits.where("rerank OR mmr IS NOT NULL").select(key).distinct(), key, "left_semi").select(key, F.col(column).alias("_v"))
    own = queries.select(query_key, F.col(column).alias("_q"))
    met = hits.join(wanted, key, "left").join(own, query_key, "left")
    similarity = F.when(F.col("rerank") & F.col("_v").isNotNull() & F.col("_q").isNotNull(), v.cosine(v.doubles("_v"), v.doubles("_q")))
    scored = met.withColumn("score", F.coalesce(similarity, F.col("rrf_score") * 61))
    by_score = Window.partitionBy("wish").orderBy(F.desc(F.round("score", 12)), "_p")
    plain = scored.where("mmr IS NULL").withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k)
    pools = scored.where("mmr IS NOT NULL AND _v IS NOT NULL").select("wish", key, "_v", F.round("score", 12).alias("score"), "mmr")
    varied = retrieval.mmr(pools, "wish", key, "_v", "score", k, "mmr").join(pools.select("wish", key, "score"), ["wish", key])
    return plain.select("wish", key, "score", "place").unionByName(varied.select("wish", key, "score", "place"))


def best_of_units(hits: DataFrame, units: DataFrame, key: str, unit: str, k: int) -> DataFrame:
    """Of each wish the best hit of every *unit*, placed anew, and the first *k*."""
    known = hits.join(units.select(key, unit), key)
    best = top_per_group(known, ["wish", unit], [F.asc("place")])
    return best.withColumn("place", F.row_number().over(Window.partitionBy("wish").orderBy("place"))).where(F.col("place") <= k)


#: The most hits that a request may ask for.
MOST_HITS = 50


def requested(requests: DataFrame, query_key: str, text: str) -> DataFrame:
    """Requests as wishes: *query_key*, ``wish``, WISH, ``k`` (from 1 to MOST_HITS) and ``least``, the score that a hit must have.

    A request has a ``mode`` (``vector``, ``lexical``, or ``hybrid`` with its ``alpha``, 0.5 where there is none), ``k`` (10 where there is none), ``expand``,
    ``rerank``, ``source``, ``mmr`` and ``min_score``, of which any may be null.  A request without words is none.
    """
    share = F.when(F.col("mode") == "vector", 0.0).when(F.col("mode") == "lexical", 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("alpha", F.lit(0.5)))))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return requests.where(F.trim(text) != "").select(
        query_key, F.col(query_key).cast("string").alias("wish"), share.alias("alpha"), no("expand"), no("rerank"), "source", "mmr",
        F.greatest(F.lit(1), F.least(F.lit(MOST_HITS), F.coalesce("k", F.lit(10)))).alias("k"), F.coalesce("min_score", F.lit(0.0)).alias("least"),
    )


def served(hits: DataFrame, wishes: DataFrame, docs: DataFrame, key: str, body: str, fields: list[str], queries: DataFrame, query_key: str, text: str) -> DataFrame:
    """What a service answers: each request's hits of at least its score, as many as it asked for, with *fields* of their documents.

    ``score`` has four digits; ``contains`` says whether the text has the query, in any case and without accents.  Hits are few by contract: their
    keys go to the documents.
    """
    kept = hits.join(wishes.select("wish", query_key, "k", "least"), "wish").where((F.round("score", 4) >= F.col("least")) & (F.col("place") <= F.col("k")))
    asked = kept.join(queries.select(query_key, t.fold(text).alias("_wish")), query_key)
    known = retrieval.with_rows(asked, key, docs, lambda rows: rows.select(key, *fields, t.fold(body).alias("_body")).dropDuplicates([key]))
    return known.select(query_key, "place", key, F.round("score", 4).alias("score"), *fields, F.coalesce(F.contains("_body", F.col("_wish")), F.lit(False)).alias("contains"))
