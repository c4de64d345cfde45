"""Retrieval queries: lexical, vector, fused, reranked, diversified, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as t
from corpusgraph.functions import vectors as v
from corpusgraph.operators import expansion, retrieval
from corpusgraph.operators.analytics import exclusive_percentiles, fusion_quality
from corpusgraph.operators.evaluation import ir_metrics
from corpusgraph.plans.registry import query, table

#: A fixed query vector of 64 dimensions, by a rule that SQL can follow.
QUERY = [((i * 37) % 19 - 9) / 10 for i in range(1, 65)]
_Q = "(SELECT list((((i * 37) % 19 - 9) / 10.0)::DOUBLE ORDER BY i) FROM range(1, 65) r(i))"
_SIM = "coalesce(list_cosine_similarity(embedding::DOUBLE[], " + _Q + "), 0)"
TERMS = ["the", "and", "with"]

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
_BM25 = f"""tk AS (SELECT doc_id, source, {_TOKENS} AS ts FROM documents),
    c AS (SELECT doc_id, source, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'the')) AS t0, len(list_filter(ts, lambda x: x = 'and')) AS t1,
      len(list_filter(ts, lambda x: x = 'with')) AS t2 FROM tk),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1, count(*) FILTER (WHERE t2 > 0) AS d2 FROM c),
    lex AS (SELECT doc_id, ln((n - d0 + 0.5) / (d0 + 0.5) + 1) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
      + ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl))
      + ln((n - d2 + 0.5) / (d2 + 0.5) + 1) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS bm25
      FROM c, st WHERE t0 > 0 AND t1 > 0 AND t2 > 0)"""
_KNN = f"vec AS (SELECT vec_id AS doc_id, {_SIM} AS similarity FROM embeddings)"
_FUSED = f"""{_BM25}, {_KNN}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rb FROM lex QUALIFY rb <= 100),
    b AS (SELECT doc_id, row_number() OVER (ORDER BY similarity DESC, doc_id) AS rv FROM vec QUALIFY rv <= 100),
    f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, rb, rv, coalesce(0.7 / (60 + rb), 0) + coalesce(0.3 / (60 + rv), 0) AS rrf FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def _docs(spark, d):
    return table(spark, d, "documents")


def _vectors(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")


def _lists(spark, d, pool=100):
    order = [F.desc(F.round("bm25", 9)), F.asc("doc_id")]
    lexical = retrieval.bm25(_docs(spark, d), "doc_id", "text", TERMS).orderBy(*order).limit(pool)
    lexical = lexical.withColumn("bm25_rank", F.row_number().over(Window.orderBy(*order)))
    near = retrieval.knn(_vectors(spark, d), "doc_id", "embedding", QUERY, pool)
    return lexical, retrieval.ranked(near, "similarity", "doc_id", "vector_rank")


@query(
    "v01_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def v01(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", v.doubles("embedding").alias("x"))
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(following, "vec_id").select("vec_id", F.round(v.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("v02_knn", f"WITH {_KNN} SELECT doc_id, round(similarity, 6) AS similarity FROM vec ORDER BY vec.similarity DESC, doc_id LIMIT 20")
def v02(spark, d):
    near = retrieval.knn(_vectors(spark, d), "doc_id", "embedding", QUERY, 20)
    return near.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(
    "v03_knn_split_id",
    f"""WITH {_KNN} SELECT split_part(id, '.', 1) AS book, split_part(id, '.', 2)::INT AS chapter, round(similarity, 6) AS similarity
    FROM (SELECT 'B' || doc_id % 9 || '.' || doc_id // 9 AS id, similarity, doc_id FROM vec ORDER BY similarity DESC, doc_id LIMIT 15)""",
)
def v03(spark, d):
    near = retrieval.knn(_vectors(spark, d), "doc_id", "embedding", QUERY, 15)
    id_ = F.concat(F.lit("B"), F.col("doc_id") % 9, F.lit("."), F.floor(F.col("doc_id") / 9))
    parts = F.split(id_, r"\.")
    return near.select(parts[0].alias("book"), parts[1].cast("int").alias("chapter"), F.round("similarity", 6).alias("similarity"))


@query(
    "v04_retrieve_filtered",
    f"""SELECT vec_id AS doc_id, round({_SIM}, 6) AS similarity FROM embeddings WHERE label BETWEEN 2 AND 6 ORDER BY {_SIM} DESC, vec_id LIMIT 12""",
)
def v04(spark, d):
    near = retrieval.knn(_vectors(spark, d), "doc_id", "embedding", QUERY, 12, F.col("label").between(2, 6))
    return near.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("v05_bm25", f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM lex")
def v05(spark, d):
    return retrieval.bm25(_docs(spark, d), "doc_id", "text", TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(
    "v05_phrase_boost",
    f"WITH {_BM25} SELECT doc_id, round(bm25 * CASE WHEN contains(lower(text), 'and the') THEN 1.5 ELSE 1.0 END, 6) AS bm25 FROM lex JOIN documents USING (doc_id)",
)
def v05_boost(spark, d):
    hits = retrieval.bm25(_docs(spark, d), "doc_id", "text", TERMS, phrase="and the")
    return hits.select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(
    "v05_postings",
    f"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term""",
)
def v05_postings(spark, d):
    index = retrieval.postings(_docs(spark, d), "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    "v06_rrf",
    f"""WITH {_FUSED} SELECT doc_id, round(rrf * 61, 6) AS final_score, CASE WHEN rv IS NULL THEN 'bm25_only' WHEN rb IS NULL THEN 'vector_only' ELSE 'both' END AS match_source FROM f""",
)
def v06(spark, d):
    hits = retrieval.rrf(*_lists(spark, d), "doc_id")
    return hits.select("doc_id", F.round("final_score", 6).alias("final_score"), "match_source")


@query(
    "v07_hybrid",
    f"""WITH {_FUSED}, g AS (SELECT f.doc_id, rrf, rb, rv, source FROM f JOIN documents USING (doc_id)
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(rrf, 12) DESC, rb NULLS LAST, rv NULLS LAST) = 1)
    SELECT doc_id, round(rrf * 61, 6) AS final_score, row_number() OVER (ORDER BY round(rrf, 12) DESC, rb NULLS LAST, rv NULLS LAST) AS place FROM g QUALIFY place <= 10""",
)
def v07(spark, d):
    hits = retrieval.hybrid(_docs(spark, d), _vectors(spark, d), "doc_id", "text", "embedding", TERMS, QUERY, "source")
    return hits.select("doc_id", F.round("final_score", 6).alias("final_score"), F.col("place").cast("long").alias("place"))


@query(
    "v07_search",
    f"""WITH tk AS (SELECT doc_id, {_TOKENS} AS ts FROM documents),
    c AS (SELECT doc_id, len(ts) AS dl, len(list_filter(ts, lambda x: x IN ('the', 'of', 'de', 'la'))) AS t0, len(list_filter(ts, lambda x: x IN ('and', 'que'))) AS t1 FROM tk),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM c),
    lex AS (SELECT doc_id, ln((n - d0 + 0.5) / (d0 + 0.5) + 1) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
      + ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS bm25 FROM c, st WHERE t0 > 0 AND t1 > 0), {_KNN},
    a AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rb FROM lex QUALIFY rb <= 100),
    b AS (SELECT doc_id, row_number() OVER (ORDER BY similarity DESC, doc_id) AS rv FROM vec QUALIFY rv <= 100),
    f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, rb, rv, coalesce(0.6 / (60 + rb), 0) + coalesce(0.4 / (60 + rv), 0) AS rrf FROM a FULL JOIN b ON a.doc_id = b.doc_id),
    h AS (SELECT doc_id, rrf FROM f ORDER BY round(rrf, 12) DESC, rb NULLS LAST, rv NULLS LAST LIMIT 30),
    j AS (SELECT h.doc_id, coalesce(similarity, rrf * 61) AS s, lang FROM h LEFT JOIN vec USING (doc_id) LEFT JOIN documents USING (doc_id)),
    p AS (SELECT doc_id, s FROM j QUALIFY row_number() OVER (PARTITION BY doc_id % 12 ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 9 END, round(s, 12) DESC, doc_id) = 1)
    SELECT doc_id, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 12) DESC, doc_id) AS place FROM p QUALIFY place <= 10""",
)
def v07_search(spark, d):
    """All stages of the hybrid search; 'the and' is a phrase, of which 'the' has four synonyms and takes three."""
    synonyms = expansion.synonym_table(spark, {"the": ["of", "de", "la", "der"], "and": ["que"], "unused": ["word"]})
    hits = retrieval.search(
        _docs(spark, d), _vectors(spark, d), "doc_id", "text", "embedding", "the and", QUERY, synonyms, F.col("doc_id") % 12, "lang", ["fr", "en"]
    )
    return hits.select("doc_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(
    "v08_rerank",
    f"""WITH {_KNN}, h AS (SELECT doc_id, 1 - (doc_id % 97) / 97.0::DOUBLE AS score FROM documents ORDER BY score DESC, doc_id LIMIT 60),
    j AS (SELECT h.doc_id, score, coalesce(similarity, score) AS s FROM h LEFT JOIN vec USING (doc_id))
    SELECT doc_id, row_number() OVER (ORDER BY round(s, 12) DESC, doc_id) AS new_rank, row_number() OVER (ORDER BY score DESC, doc_id) AS original_rank FROM j QUALIFY new_rank <= 10""",
)
def v08(spark, d):
    score = (1 - (F.col("doc_id") % 97) / F.lit(97.0)).alias("score")
    hits = _docs(spark, d).select("doc_id", score).orderBy(F.desc("score"), "doc_id").limit(60)
    out = retrieval.rerank(hits, "doc_id", "score", _vectors(spark, d), "embedding", QUERY, 10)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("new_rank", "original_rank")])


@query(
    "v09_mmr_canonical",
    f"""WITH {_KNN}, h AS (SELECT doc_id, similarity, row_number() OVER (ORDER BY similarity DESC, doc_id) AS p FROM vec QUALIFY p <= 80)
    SELECT doc_id % 25 AS unit, doc_id FROM h QUALIFY row_number() OVER (PARTITION BY doc_id % 25 ORDER BY similarity DESC, p) = 1""",
)
def v09(spark, d):
    near = retrieval.ranked(retrieval.knn(_vectors(spark, d), "doc_id", "embedding", QUERY, 80), "similarity", "doc_id", "p")
    best = retrieval.keep_best(near.withColumn("unit", F.col("doc_id") % 25), "unit", "similarity", F.asc("p"))
    return best.select("unit", "doc_id")


@query("v10_mmr_lambda")
def v10(spark, d):
    near = retrieval.knn(_vectors(spark, d), "doc_id", "embedding", QUERY, 100)
    pool = near.join(_vectors(spark, d).select("doc_id", "embedding"), "doc_id").withColumn("query_id", F.lit(1))
    return retrieval.mmr(pool, "query_id", "doc_id", "embedding", "similarity", 10)


@query(
    "v11_version_dedup",
    """WITH h AS (SELECT doc_id % 40 AS unit, lang, doc_id, n_chars FROM documents) SELECT unit, doc_id FROM h
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 9 END, n_chars DESC, doc_id) = 1""",
)
def v11(spark, d):
    from corpusgraph.operators.relational import prefer

    hits = _docs(spark, d).select((F.col("doc_id") % 40).alias("unit"), "lang", "doc_id", "n_chars")
    return prefer(hits, ["unit"], "lang", ["fr", "en"], [F.desc("n_chars"), F.asc("doc_id")]).select("unit", "doc_id")


@query(
    "v12_similar_docs",
    """SELECT b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id = 7 AND b.vec_id <> 7 AND a.label <> b.label
    ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 5""",
)
def v12(spark, d):
    e = _vectors(spark, d)
    one = F.broadcast(e.where("doc_id = 7").select(v.doubles("embedding").alias("q"), F.col("label").alias("own")))
    near = e.join(one, (F.col("doc_id") != 7) & (F.col("label") != F.col("own")))
    scored = near.select("doc_id", v.cosine(v.doubles("embedding"), F.col("q")).alias("s")).orderBy(F.desc("s"), "doc_id").limit(5)
    return scored.select("doc_id", F.round("s", 6).alias("similarity"))


@query(
    "v12_knn_join",
    """SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) <= 5""",
)
def v12_join(spark, d):
    e = _vectors(spark, d)
    queries = e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    found = retrieval.knn_join(queries, "query_id", e, "doc_id", "embedding", 5)
    return found.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@query(
    "v13_search_service",
    f"""WITH {_KNN} SELECT v.doc_id, round(similarity, 4) AS score, coalesce(lang, 'none') AS lang FROM vec v LEFT JOIN documents USING (doc_id)
    WHERE round(similarity, 4) >= 0.1 ORDER BY similarity DESC, v.doc_id LIMIT 25""",
)
def v13(spark, d):
    near = retrieval.knn(_vectors(spark, d), "doc_id", "embedding", QUERY, 25).where(F.round("similarity", 4) >= 0.1)
    named = retrieval.with_rows(near, "doc_id", _docs(spark, d), lambda rows: rows.select("doc_id", "lang"))
    return named.select("doc_id", F.round("similarity", 4).alias("score"), F.coalesce("lang", F.lit("none")).alias("lang"))


STOP = ("the", "and", "of", "to", "in")


@query(
    "v14_content_tokens",
    f"""SELECT doc_id, len(list_filter({_TOKENS}, lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'of', 'to', 'in'))) AS n,
    array_to_string(list_slice(list_filter({_TOKENS}, lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'of', 'to', 'in')), 1, 5), ' ') AS head FROM documents""",
)
def v14(spark, d):
    toks = _docs(spark, d).select("doc_id", t.content_tokens("text", STOP).alias("ts"))
    return toks.select("doc_id", F.size("ts").cast("long").alias("n"), F.array_join(F.slice("ts", 1, 5), " ").alias("head"))


_PAIRS = "(VALUES ('click', 'tap', 1), ('click', 'press', 2), ('click', 'hit', 3), ('click', 'push', 4), ('view', 'see', 1), ('view', 'watch', 2)) s(term, synonym, pri)"


@query(
    "v15_expansion",
    f"""WITH q AS (SELECT DISTINCT event_type AS term FROM events) SELECT term, coalesce((SELECT string_agg(synonym, ',' ORDER BY pri) FROM {_PAIRS} WHERE s.term = q.term AND pri <= 3), '') AS more FROM q""",
)
def v15(spark, d):
    terms = table(spark, d, "events").select(F.col("event_type").alias("term")).distinct()
    return expansion.expand(terms, "term", expansion.synonym_table(spark, {"click": ["tap", "press", "hit", "push"], "view": ["see", "watch"]}), 3)


#: Synonyms by the first words of benchmark texts: the second and third word of a text, in this order, for its first.
_SYNONYMS = f"""sy AS (SELECT term, synonym, row_number() OVER (PARTITION BY term ORDER BY best, synonym) AS priority FROM (SELECT ts[1] AS term, s.synonym, min(item_id * 2 + s.i) AS best
      FROM (SELECT item_id, {_TOKENS} AS ts FROM benchmark), LATERAL (SELECT unnest(ts[2:3]) AS synonym, generate_subscripts(ts[2:3], 1) AS i) s WHERE len(ts) > 2 AND ts[1] <> s.synonym GROUP BY 1, 2))"""


def _synonyms(spark, d):
    ts = t.tokens("text")
    rows = table(spark, d, "benchmark").where(F.size(ts) > 2).select("item_id", F.get(ts, F.lit(0)).alias("term"), F.posexplode(F.slice(ts, 2, 2)).alias("i", "synonym"))
    best = rows.where("term <> synonym").groupBy("term", "synonym").agg(F.min(F.col("item_id") * 2 + F.col("i") + 1).alias("best"))
    return best.select("term", "synonym", F.row_number().over(Window.partitionBy("term").orderBy("best", "synonym")).alias("priority"))


@query("v16_inverse_synonyms", f"WITH {_SYNONYMS} SELECT synonym AS term, string_agg(DISTINCT term, ',' ORDER BY term) AS heads FROM sy GROUP BY 1")
def v16(spark, d):
    return expansion.inverse(_synonyms(spark, d))


@query(
    "v17_expansion_text",
    f"""WITH {_SYNONYMS}, q AS (SELECT item_id, array_to_string(ts[1:4], ' ') AS text, ts[1:4] AS ts FROM (SELECT item_id, {_TOKENS} AS ts FROM benchmark)),
    w AS (SELECT item_id, i, word, list(synonym ORDER BY priority) FILTER (WHERE priority <= 2) AS s FROM (SELECT item_id, unnest(ts) AS word, generate_subscripts(ts, 1) AS i FROM q) LEFT JOIN sy ON term = word GROUP BY 1, 2, 3),
    u AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item_id, word ORDER BY i) = 1)
    SELECT item_id, text || coalesce((SELECT ' ' || string_agg(array_to_string(s, ' '), ' ' ORDER BY i) FROM u WHERE u.item_id = q.item_id AND s IS NOT NULL), '') AS concatenated,
    coalesce((SELECT string_agg(CASE WHEN s IS NULL THEN word ELSE word || ' ' || s[1] END, ' ' ORDER BY i) FROM w WHERE w.item_id = q.item_id), '') AS replaced,
    text || coalesce((SELECT ' (' || string_agg(s[1], ', ' ORDER BY i) || ')' FROM u WHERE u.item_id = q.item_id AND s IS NOT NULL), '') AS augmented FROM q""",
)
def v17(spark, d):
    """What the first words of benchmark texts become to be embedded, in three ways."""
    words = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(t.tokens("text"), 1, 4), " ").alias("text"))
    return expansion.texts(words, "item_id", "text", _synonyms(spark, d), 2).select("item_id", "concatenated", "replaced", "augmented")


@query(
    "v19_query_typing",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '[0-9]+:[0-9]+') THEN 'reference' WHEN contains(text, '?') THEN 'question'
    WHEN len(string_split(trim(text), ' ')) = 1 THEN 'keyword' WHEN len(string_split(trim(text), ' ')) <= 6 THEN 'phrase' ELSE 'concept' END AS kind FROM conversations) GROUP BY 1""",
)
def v19(spark, d):
    kinds = table(spark, d, "conversations").select(expansion.query_type(F.col("text")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "v20_ngrams",
    """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS ts FROM benchmark)
    SELECT gram, count(*) AS n FROM (SELECT ts[i] || '_' || ts[i + 1] AS gram FROM (SELECT ts, unnest(range(1, len(ts))) AS i FROM w)) GROUP BY 1""",
)
def v20(spark, d):
    grams = table(spark, d, "benchmark").select(F.explode(t.ngrams(t.tokens("text"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


ANALYSED = """WITH g AS (SELECT name, max(boost) AS boost FROM (SELECT CASE WHEN item_id % 2 = 0 THEN ts[1] ELSE ts[1] || '_' || ts[2] END AS name, CASE WHEN item_id % 3 = 0 THEN 3.0 ELSE 2.0 END AS boost
      FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS ts FROM benchmark)) WHERE name IS NOT NULL GROUP BY 1),
    q AS (SELECT text, md5(text) AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS every FROM (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL)),
    o AS (SELECT *, list_filter(every, lambda x: x NOT IN ('the', 'and', 'of', 'to', 'in')) AS ts FROM q),
    m AS (SELECT id, max(boost) AS best, count(*) AS entities FROM (SELECT DISTINCT id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1]))) AS name FROM o) JOIN g USING (name) GROUP BY 1),
    k AS (SELECT o.*, best, coalesce(entities, 0) AS entities, CASE WHEN regexp_matches(text, '(?i)\\b\\d?\\s*[a-z]+\\s+\\d+[:.]\\d+\\b') THEN 'reference' WHEN best >= 2.5 THEN 'entity'
      WHEN ends_with(rtrim(text), '?') OR coalesce(ts[1] IN ('what', 'who', 'how'), false) THEN 'question' WHEN len(ts) >= 2 THEN 'phrase' WHEN coalesce(ts[1] IN ('thanks'), false) THEN 'concept'
      WHEN len(ts) = 1 AND best IS NOT NULL THEN 'entity' ELSE 'keyword' END AS kind FROM o LEFT JOIN m USING (id)),
    a AS (SELECT id, kind, len(every) - len(ts) + 1 AS distance, entities, CASE kind WHEN 'reference' THEN 0.8::DOUBLE WHEN 'entity' THEN 0.7 WHEN 'phrase' THEN 0.6 WHEN 'concept' THEN 0.4 WHEN 'question' THEN 0.3 ELSE 0.5 END AS alpha,
      CASE kind WHEN 'entity' THEN best::DOUBLE WHEN 'reference' THEN 3.0 WHEN 'phrase' THEN 2.0 WHEN 'keyword' THEN 1.5 ELSE 1.0 END AS boost,
      CASE WHEN kind IN ('reference', 'entity') THEN false WHEN kind = 'keyword' THEN len(ts) = 1 ELSE true END AS expand FROM k)"""


def gazetteer(spark, d):
    """Names of one or two words, from benchmark texts, with boosts."""
    words = table(spark, d, "benchmark").select("item_id", t.tokens("text").alias("ts"))
    two = F.concat(F.get("ts", F.lit(0)), F.lit("_"), F.get("ts", F.lit(1)))
    name = F.when(F.col("item_id") % 2 == 0, F.get("ts", F.lit(0))).otherwise(two)
    return words.select(name.alias("name"), F.when(F.col("item_id") % 3 == 0, 3.0).otherwise(2.0).alias("boost")).where("name IS NOT NULL")


def _analysed(spark, d):
    names = gazetteer(spark, d)
    asked = table(spark, d, "conversations").select("text").where("text IS NOT NULL").distinct().select(F.md5("text").alias("id"), "text")
    return expansion.analysed(asked, "id", "text", names, STOP, ("what", "who", "how"), ("thanks",))


@query("v19_query_analysis", ANALYSED + " SELECT id, kind, alpha, distance, boost, expand, entities FROM a")
def v19_analysis(spark, d):
    return _analysed(spark, d)


@query("v21_alpha_by_type", ANALYSED + " SELECT kind, alpha, count(*) AS n FROM a GROUP BY ALL")
def v21(spark, d):
    return _analysed(spark, d).groupBy("kind", "alpha").agg(F.count("*").alias("n"))


@query(
    "v22_formatted_hits",
    f"""WITH {_KNN}, h AS (SELECT doc_id, similarity FROM vec ORDER BY similarity DESC, doc_id LIMIT 30)
    SELECT doc_id, round(1 - similarity, 6) AS distance, contains(strip_accents(lower(text)), 'the') AS contains_query FROM h JOIN documents USING (doc_id)""",
)
def v22(spark, d):
    near = retrieval.knn(_vectors(spark, d), "doc_id", "embedding", QUERY, 30).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return near.select("doc_id", F.round(1 - F.col("similarity"), 6).alias("distance"), t.fold("text").contains("the").alias("contains_query"))


_IR = """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS doc, (a.label = b.label)::INT AS gain, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
      FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 12) DESC, doc) AS rank FROM s QUALIFY rank <= 10),
    p AS (SELECT *, sum(gain) OVER (PARTITION BY q ORDER BY rank)::DOUBLE / rank AS prec, row_number() OVER (PARTITION BY q ORDER BY gain DESC, rank) AS ideal FROM r),
    m AS (SELECT q, sum(gain)::BIGINT AS hits, sum(prec * gain) AS ap, sum(gain / log2(rank + 1)) AS dcg, sum(gain / log2(ideal + 1)) AS best FROM p GROUP BY q),
    n AS (SELECT q, sum(gain)::BIGINT AS relevant FROM s GROUP BY q)"""


@query(
    "v23_ir_metrics",
    f"""{_IR} SELECT q, round(hits / 10, 6) AS precision, round(CASE WHEN relevant = 0 THEN 0 ELSE hits / relevant END, 6) AS recall,
    round(CASE WHEN hits = 0 THEN 0 ELSE ap / hits END, 6) AS average_precision, round(CASE WHEN best = 0 THEN 0 ELSE dcg / best END, 6) AS ndcg FROM m JOIN n USING (q)""",
)
def v23(spark, d):
    out = _metrics(spark, d, 10)
    return out.select("q", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "average_precision", "ndcg")])


def _judged(spark, d, k):
    """The *k* nearest others of every row whose id is divisible by 100, with rank and gain."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding"))
    found = retrieval.knn_join(queries, "q", e, "vec_id", "embedding", k + 1).where("q <> vec_id")
    own, other = e.select(F.col("vec_id").alias("q"), F.col("label").alias("wanted")), e.select("vec_id", "label")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 12)), "vec_id"))
    return found.join(own, "q").join(other, "vec_id").select("q", rank.alias("rank"), (F.col("label") == F.col("wanted")).cast("int").alias("gain"))


def _metrics(spark, d, k):
    e = table(spark, d, "embeddings")
    own = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("wanted"))
    sizes = e.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("relevant"))
    return ir_metrics(_judged(spark, d, k), "q", "rank", "gain", own.join(sizes, "wanted").select("q", "relevant"), k)


@query(
    "v24_experiment_grid",
    f"""{_IR} SELECT k, round(avg(h), 6) AS precision FROM (SELECT k, q, sum(gain) / k::DOUBLE AS h FROM r JOIN (VALUES (1), (3), (5), (10)) g(k) ON rank <= k GROUP BY k, q) GROUP BY 1""",
)
def v24(spark, d):
    depths = F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("k")
    hits = _judged(spark, d, 10).select("q", "rank", "gain", depths).where("rank <= k").groupBy("k", "q").agg((F.sum("gain") / F.col("k")).alias("h"))
    return hits.groupBy("k").agg(F.round(F.avg("h"), 6).alias("precision"))


@query(
    "v25_eval_coverage",
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS xs, count(*) AS queries, count(*) FILTER (WHERE value > 20) AS found, median(value) AS p50 FROM events GROUP BY 1),
    p AS (SELECT *, least(greatest(0.95 * (len(xs) + 1), 1), len(xs))::DOUBLE AS pos FROM s)
    SELECT event_type, queries, round(found / queries::DOUBLE, 6) AS coverage, round(p50, 6) AS p50,
    round(xs[floor(pos)::INT] + (xs[least(floor(pos)::INT + 1, len(xs))] - xs[floor(pos)::INT]) * (pos - floor(pos)), 6) AS p95 FROM p""",
)
def v25(spark, d):
    events = table(spark, d, "events")
    counts = events.groupBy("event_type").agg(F.count("*").alias("queries"), F.round(F.count_if(F.col("value") > 20) / F.count("*"), 6).alias("coverage"))
    times = exclusive_percentiles(events, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return counts.join(times, "event_type").select("event_type", "queries", "coverage", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("v26_cache_key", "SELECT item_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) || ':small') AS key FROM benchmark")
def v26(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(F.concat(t.one_spaced("text"), F.lit(":small"))).alias("key"))


@query(
    "v27_changed_texts",
    """SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents WHERE sha256(text) <> sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) OR doc_id % 17 = 0""",
)
def v27(spark, d):
    docs = _docs(spark, d)
    before = docs.where("doc_id % 17 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("old"))
    now = docs.select("doc_id", F.sha2("text", 256).alias("new"), F.floor(F.length("text") / 4).alias("tokens"))
    return now.join(before, "doc_id", "left").where(~F.col("new").eqNullSafe(F.col("old"))).select("doc_id", "tokens")


@query(
    "v28_version_fusion",
    """WITH g AS (SELECT vec_id % 50 AS unit, vec_id // 50 % 4 AS version, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT unit FROM g GROUP BY 1 HAVING count(DISTINCT version) = 4),
    e AS (SELECT unit, 1 + version AS w, generate_subscripts(x, 1) AS p, unnest(x) AS y FROM g JOIN f USING (unit)),
    t AS (SELECT unit, sum(m) AS total FROM (SELECT unit, p, sum(w * y) / sum(w) AS m FROM e GROUP BY ALL) GROUP BY 1),
    v AS (SELECT unit, 1 + version AS w FROM g JOIN f USING (unit) GROUP BY ALL), q AS (SELECT unit, w / sum(w) OVER (PARTITION BY unit) AS w FROM v)
    SELECT unit, round(any_value(total), 6) AS total, round(0.7 + 0.3 * sum(-w * ln(w + 1e-10)) / ln(4), 6) AS quality FROM t JOIN q USING (unit) GROUP BY 1""",
)
def v28(spark, d):
    from corpusgraph.operators.relational import contained_in_all

    version = (F.floor(F.col("vec_id") / 50) % 4).alias("version")
    g = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("unit"), version, v.doubles("embedding").alias("x"))
    g = g.join(contained_in_all(g, "unit", "version", g), "unit", "left_semi").withColumn("w", 1 + F.col("version"))
    e = g.select("unit", "w", F.posexplode("x").alias("p", "y"))
    means = e.groupBy("unit", "p").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    quality = g.groupBy("unit").agg(F.collect_set("w").alias("ws"))
    total = F.aggregate("ws", F.lit(0).cast("long"), lambda s, w: s + w)
    quality = quality.select("unit", F.round(fusion_quality(F.transform("ws", lambda w: w / total), 4, 4), 6).alias("quality"))
    return means.groupBy("unit").agg(F.round(F.sum("m"), 6).alias("total")).join(quality, "unit")


@query(
    "v29_reference_patterns",
    """SELECT page_id FROM pages WHERE contains(lower(html), '<p') AND (regexp_matches(html, '[0-9]+:[0-9]+') OR regexp_matches(lower(html), '[a-z] ?[0-9]+'))
    QUALIFY row_number() OVER (PARTITION BY substr(html, 1, 100) ORDER BY length(html) DESC, page_id) = 1""",
)
def v29(spark, d):
    from corpusgraph.operators.relational import top_per_group

    hit = F.col("html").rlike("[0-9]+:[0-9]+") | F.lower("html").rlike("[a-z] ?[0-9]+")
    pages = table(spark, d, "pages").where(t.contains("html", "<p") & hit)
    pages = pages.select("page_id", F.substring("html", 1, 100).alias("prefix"), F.length("html").alias("n"))
    return top_per_group(pages, ["prefix"], [F.desc("n"), F.asc("page_id")]).select("page_id")


@query(
    "v30_candidates",
    """SELECT doc_id, max(linked)::INT AS linked FROM (SELECT doc_id, 1 AS linked FROM labels WHERE quality = 0 UNION ALL
    (SELECT doc_id, 0 FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)) GROUP BY 1""",
)
def v30(spark, d):
    linked = table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit(1).alias("linked"))
    top = _docs(spark, d).orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id", F.lit(0).alias("linked"))
    return linked.union(top).groupBy("doc_id").agg(F.max("linked").alias("linked"))


@query(
    "v30_annotations",
    """WITH f AS (SELECT doc_id, max(n_chars % 100 / 100::DOUBLE) AS relevance FROM documents WHERE n_chars % 100 >= 50 GROUP BY 1), e AS (SELECT doc_id, quality::DOUBLE AS relevance, toxic = 1 AS is_primary FROM labels)
    SELECT doc_id, coalesce(f.relevance, e.relevance) AS relevance, CASE WHEN f.relevance IS NOT NULL THEN f.relevance >= 0.8 ELSE is_primary END AS is_primary FROM e FULL JOIN f USING (doc_id)""",
)
def v30_annotations(spark, d):
    from corpusgraph.operators.etl import annotate

    known = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("relevance"), (F.col("toxic") == 1).alias("is_primary"))
    found = _docs(spark, d).select("doc_id", (F.col("n_chars") % 100 / F.lit(100.0)).alias("relevance"))
    return annotate(known, found, "doc_id", "relevance")
