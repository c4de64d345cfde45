"""Queries that prepare a whole table (an index, a vocabulary, a table of names) and then answer many questions with it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgraph.functions import stems
from corpusgraph.functions import text as t
from corpusgraph.operators import evaluation, experiments, expansion, lexical, matching, morphology, nearest, scanner
from corpusgraph.plans.registry import query, table
from corpusgraph.plans.search import ANALYSED, STOP, gazetteer

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
#: Exhaustive scores of all documents for all benchmark texts: ``lex`` with ``item_id``, ``doc_id``, ``bm25`` and the numbers of terms met and asked for.
_LEXICAL = f"""dt AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM dt),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM dt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    qt AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark), qn AS (SELECT item_id, count(*) AS asked FROM qt GROUP BY 1),
    lex AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS bm25, count(*) AS met, any_value(asked) AS asked
      FROM qt JOIN qn USING (item_id) JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


def _index(spark, d):
    return lexical.build(table(spark, d, "documents"), "doc_id", "text", like=("lang",))


@query(
    "v05_index_topk",
    f"""WITH {_LEXICAL} SELECT item_id, doc_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) AS place FROM lex QUALIFY place <= 100""",
)
def v05_index_topk(spark, d):
    """The best 100 documents of every benchmark text, by the index."""
    found = lexical.top_k(_index(spark, d), table(spark, d, "benchmark"), "item_id", "text", 100)
    return found.select("item_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.col("place").cast("long").alias("place"))


#: Three words of a text, in order, as another table of queries.
_HEAD = "(SELECT item_id, array_to_string(list_slice(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''), 1, 3), ' ') AS text FROM benchmark)"


@query(
    "v05_index_every",
    f"""WITH {_LEXICAL.replace("FROM benchmark)", f"FROM {_HEAD})")} SELECT item_id, doc_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) AS place
    FROM lex WHERE met = asked QUALIFY place <= 20""",
)
def v05_index_every(spark, d):
    """The best 20 documents that have all of the first three words of a benchmark text."""
    heads = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(t.tokens("text"), 1, 3), " ").alias("text"))
    found = lexical.top_k(_index(spark, d), heads, "item_id", "text", 20, every=True)
    return found.select("item_id", "doc_id", F.round("bm25", 6).alias("bm25"), F.col("place").cast("long").alias("place"))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(
    "v02_ivf_exact",
    """SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) <= 10""",
)
def v02_ivf_exact(spark, d):
    """The ten nearest of every id divisible by 100, by bounds on the lists' angles."""
    e, queries = _vectors(spark, d)
    found = nearest.search_exactly(nearest.build(e, "vec_id", "embedding"), queries, "query_id", "embedding", 10)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("v02_ivf_recall")
def v02_ivf_recall(spark, d):
    """The share of the ten nearest of every id divisible by 100 that probing finds, against a comparison with all vectors."""
    from corpusgraph.operators import retrieval

    e, queries = _vectors(spark, d)
    found = nearest.search(nearest.build(e, "vec_id", "embedding"), queries, "query_id", "embedding", 10)
    return nearest.recall(found, retrieval.knn_join(queries, "query_id", e, "vec_id", "embedding", 10), "query_id", "vec_id")


#: Two neighbouring words of each benchmark text, of which every second is taken for Portuguese.
_PAIRS = f"""pair AS (SELECT item_id, ts[3] || ' ' || ts[4] AS text, CASE WHEN item_id % 2 = 1 THEN 'pt' ELSE 'en' END AS config
      FROM (SELECT item_id, {_TOKENS} AS ts FROM benchmark) WHERE len(ts) >= 4)"""
_WORDS = f"""dt AS (SELECT doc_id, {_TOKENS} AS ts FROM documents),
    vocabulary AS (SELECT DISTINCT token FROM (SELECT unnest(ts) AS token FROM dt) UNION SELECT DISTINCT unnest({_TOKENS}) FROM benchmark),
    stemmed AS (SELECT 'en' AS config, token, stem FROM ({stems.stem_sql("vocabulary", "token", "en")}) UNION ALL SELECT 'pt', token, stem FROM ({stems.stem_sql("vocabulary", "token", "pt")})),
    wanted AS (SELECT item_id, config, stem, row_number() OVER (PARTITION BY item_id ORDER BY stem) - 1 AS i, count(*) OVER (PARTITION BY item_id) AS n
      FROM (SELECT DISTINCT item_id, config, stem FROM (SELECT item_id, config, unnest(string_split(text, ' ')) AS token FROM pair) JOIN stemmed USING (config, token)))"""


def _pairs(spark, d):
    ts = t.tokens("text")
    pair = table(spark, d, "benchmark").where(F.size(ts) >= 4).select("item_id", F.array_join(F.slice(ts, 3, 2), " ").alias("text"))
    return pair.withColumn("lang", F.when(F.col("item_id") % 2 == 1, "pt-BR").otherwise("en"))


@query(
    "f17_stemmed_match",
    f"""WITH {_PAIRS}, {_WORDS}, met AS (SELECT item_id, doc_id, n, count(DISTINCT i) AS m FROM (SELECT doc_id, unnest(list_distinct(ts)) AS token FROM dt) JOIN stemmed USING (token)
      JOIN wanted USING (config, stem) GROUP BY 1, 2, 3)
    SELECT item_id, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM met WHERE m = n GROUP BY 1""",
)
def f17_stemmed_match(spark, d):
    """How many documents have all stems of two words of each benchmark text, in the text's language."""
    docs = table(spark, d, "documents")
    found = matching.match_all(docs, "doc_id", "text", matching.lexemes(_pairs(spark, d), "item_id", "text", "lang"), "item_id")
    return found.groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(
    "v05_cover_density",
    f"""WITH {_PAIRS}, {_WORDS}, e AS (SELECT item_id, doc_id, n, i, spot FROM (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS spot FROM dt) JOIN stemmed USING (token) JOIN wanted USING (config, stem)),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY spot) AS j FROM e),
    l AS (SELECT item_id, doc_id, n, j, spot, min(last) AS lft, count(last) AS met FROM (SELECT k.*, g.i AS term, max(CASE WHEN k.i = g.i THEN k.j END) OVER (PARTITION BY k.item_id, k.doc_id, g.i ORDER BY k.j) AS last
      FROM k, generate_series(0, 1) g(i) WHERE g.i < k.n) GROUP BY ALL),
    c AS (SELECT *, lag(CASE WHEN met = n THEN lft END) OVER (PARTITION BY item_id, doc_id ORDER BY j) AS before FROM l),
    r AS (SELECT c.item_id, c.doc_id, sum(0.1 / (1 + c.spot - f.spot - (c.j - c.lft))) AS rank, count(*) AS covers FROM c JOIN k f ON f.item_id = c.item_id AND f.doc_id = c.doc_id AND f.j = c.lft
      WHERE met = c.n AND (before IS NULL OR c.lft > before) GROUP BY 1, 2)
    SELECT item_id, doc_id, round(rank, 6) AS rank, covers, row_number() OVER (PARTITION BY item_id ORDER BY round(rank, 9) DESC, doc_id) AS place FROM r QUALIFY place <= 20""",
)
def v05_cover_density(spark, d):
    """The 20 documents in which two words of a benchmark text, by their stems, stand closest and most often."""
    docs = table(spark, d, "documents")
    found = matching.cover_density(docs, "doc_id", "text", matching.lexemes(_pairs(spark, d), "item_id", "text", "lang"), "item_id")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.round("rank", 9)), "doc_id"))
    best = found.withColumn("place", place).where("place <= 20")
    return best.select("item_id", "doc_id", F.round("rank", 6).alias("rank"), F.col("covers").cast("long").alias("covers"), F.col("place").cast("long").alias("place"))


@query(
    "f18_chains",
    f"""WITH q AS (SELECT item_id, {_TOKENS} AS ts FROM benchmark), dt AS (SELECT doc_id, {_TOKENS} AS ts FROM documents),
    w AS (SELECT doc_id, unnest(ts) AS word, generate_subscripts(ts, 1) AS spot FROM dt),
    m AS (SELECT item_id, 0 AS part, a.doc_id, a.spot - 1 AS spot FROM q JOIN w a ON a.word = ts[1] JOIN w b ON b.doc_id = a.doc_id AND b.spot = a.spot + 2 AND b.word = ts[3] JOIN w c ON c.doc_id = a.doc_id AND c.spot = a.spot + 4 AND c.word = ts[5] WHERE len(ts) >= 6
      UNION ALL SELECT item_id, 1, a.doc_id, a.spot - 1 FROM q JOIN w a ON a.word = ts[5] JOIN w b ON b.doc_id = a.doc_id AND b.spot = a.spot + 1 AND b.word = ts[6] WHERE len(ts) >= 6
      UNION ALL SELECT item_id, 2, a.doc_id, a.spot - 1 FROM q JOIN w a ON a.word = ts[2] WHERE len(ts) >= 6)
    SELECT item_id, part, count(*) AS places, count(DISTINCT doc_id) AS docs, min(spot) AS earliest FROM m GROUP BY 1, 2""",
)
def f18_chains(spark, d):
    """Queries of three parts: words 1, 3 and 5 of a text two apart, 5 and 6 next to each other, or word 2."""
    ts = t.tokens("text")
    word = lambda i: F.get(ts, F.lit(i - 1))
    wish = F.concat(F.lit("("), word(1), F.lit(" <2> "), word(3), F.lit(" <2> "), word(5), F.lit(") | "), word(5), F.lit(" <-> "), word(6), F.lit(" | "), word(2))
    wanted = matching.chains(table(spark, d, "benchmark").where(F.size(ts) >= 6).select("item_id", wish.alias("wish")), "item_id", "wish")
    found = matching.match_chains(table(spark, d, "documents"), "doc_id", "text", wanted, "item_id")
    by_doc = found.groupBy("item_id", "part", "doc_id").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return by_doc.groupBy("item_id", "part").agg(F.sum("n").alias("places"), F.count("*").alias("docs"), F.min("at").alias("earliest"))


#: All matches of names that stand before a number, then those that a reader finds from left to right.
_SCAN = """tk AS (SELECT page_id, regexp_extract_all(lower(html), '\\p{L}+|[0-9]+|\\S') AS ts FROM pages),
    np AS (SELECT page_id, ts, p FROM (SELECT page_id, ts, unnest(range(2, len(ts) + 1)) AS p FROM tk) WHERE regexp_full_match(ts[p], '[0-9]{1,3}')),
    ne AS (SELECT *, CASE WHEN regexp_full_match(ts[p - 1], '\\p{L}+') THEN p - 1 WHEN p > 2 AND ts[p - 1] = '.' AND regexp_full_match(ts[p - 2], '\\p{L}+') THEN p - 2 END AS e FROM np),
    nv AS (SELECT *, CASE WHEN ts[p + 1] IN (':', '.') AND regexp_full_match(ts[p + 2], '[0-9]{1,3}') THEN ts[p + 2]::INT END AS verse FROM ne WHERE e IS NOT NULL),
    nw AS (SELECT *, CASE WHEN verse IS NOT NULL AND ts[p + 3] IN ('-', '–') AND regexp_full_match(ts[p + 4], '[0-9]{1,3}') THEN ts[p + 4]::INT END AS ending FROM nv),
    rn AS (SELECT page_id, e - n AS start, n, ts[p]::INT AS chapter, verse, coalesce(ending, verse) AS end_verse, p - 1 + CASE WHEN ending IS NOT NULL THEN 4 WHEN verse IS NOT NULL THEN 2 ELSE 0 END AS last,
      ts[e - n + 1:e] AS run FROM nw, (VALUES (1), (2)) w(n) WHERE e >= n),
    ck AS (SELECT *, regexp_replace(translate(array_to_string(run, ''), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]', '', 'g') AS key FROM rn
      WHERE len(list_filter(run, lambda x: NOT regexp_full_match(x, '\\p{L}+|[0-9]+'))) = 0),
    al AS (SELECT key, 'B' || min(length(key)) AS book FROM ck WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT page_id) >= 2)"""


@query(
    "v29_scan",
    f"""WITH RECURSIVE {_SCAN}, m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY start, n DESC) AS k FROM ck JOIN al USING (key)),
    g AS (SELECT page_id, k, true AS taken, last AS upto FROM m WHERE k = 1
      UNION ALL SELECT m.page_id, m.k, m.start > upto, CASE WHEN m.start > upto THEN m.last ELSE upto END FROM g JOIN m ON m.page_id = g.page_id AND m.k = g.k + 1)
    SELECT m.page_id, m.start::INT AS start, book, chapter, verse, end_verse FROM m JOIN g ON g.page_id = m.page_id AND g.k = m.k AND taken""",
)
def v29_scan(spark, d):
    """References in whole pages; the names are runs of one or two words that stand before numbers in two pages or more."""
    pages = table(spark, d, "pages")
    runs = scanner.candidates(pages, "page_id", "html", 2).where("key <> ''")
    names = runs.groupBy("key").agg(F.count_distinct("page_id").alias("n")).where("n >= 2")
    names = names.select("key", F.concat(F.lit("B"), F.length("key")).alias("book"))
    return scanner.scan(pages, "page_id", "html", names, 2)


#: Twelve ways to answer a query: lexical share, expanded, ranked anew, vectors searched, weight of relevance against variety.
CONFIGURATIONS = [
    ("balanced", 0.5, False, False, "whole", None), ("lexical", 1.0, False, False, "whole", None), ("semantic", 0.0, False, False, "whole", None),
    ("expanded", 0.5, True, False, "whole", None), ("reranked", 0.5, False, True, "whole", None), ("relevant", 0.5, False, False, "whole", 0.8),
    ("even", 0.5, False, False, "whole", 0.5), ("varied", 0.5, False, False, "whole", 0.2), ("short", 0.5, False, False, "half", None),
    ("all", 0.5, True, True, "whole", 0.5), ("expanded_reranked", 0.5, True, True, "whole", None), ("short_reranked", 0.5, False, True, "half", None),
]


def _questions(spark, d):
    """Four words of each benchmark text that has a vector, two more to expand it, and that vector."""
    ts = t.tokens("text")
    words = table(spark, d, "benchmark").where(F.size(ts) >= 6).select(
        F.col("item_id").alias("q"), F.array_join(F.slice(ts, 1, 4), " ").alias("text"), F.array_join(F.slice(ts, 5, 2), " ").alias("more")
    )
    return words.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), "embedding", "label"), "q")


def _experiments(spark, d, configurations):
    """Precision, recall and nDCG of the first ten by configuration and query; relevant is what has the query's label."""
    schema = "config string, alpha double, expand boolean, rerank boolean, source string, mmr double"
    questions, e = _questions(spark, d), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    wishes = experiments.grid(spark.createDataFrame(configurations, schema), questions, "q")
    texts = experiments.lexical_lists(_index(spark, d), wishes, questions, "q", "text", "more", 50)
    half = lambda rows: rows.withColumn("embedding", F.slice("embedding", 1, 32))
    sources = {"whole": (nearest.build(e, "doc_id", "embedding"), questions), "half": (nearest.build(half(e), "doc_id", "embedding"), half(questions))}
    near = experiments.vector_lists(sources, "q", "embedding", 50)
    found = experiments.answers(wishes, "q", "doc_id", texts, near, e, "embedding", questions, 10)
    labels = e.select("doc_id", F.col("label").alias("_label"))
    judged = found.join(wishes.select("wish", "config", "q"), "wish").join(questions.select("q", "label"), "q").join(labels, "doc_id", "left")
    judged = judged.select("wish", "config", "q", "place", F.coalesce((F.col("label") == F.col("_label")).cast("int"), F.lit(0)).alias("gain"))
    sizes = questions.join(e.groupBy("label").agg(F.count("*").alias("relevant")), "label").select("q", "relevant")
    relevant = wishes.select("wish", "q").join(sizes, "q").select("wish", "relevant")
    metrics = evaluation.ir_metrics(judged, "wish", "place", "gain", relevant, 10)
    return metrics.join(wishes.select("wish", "config", "q"), "wish").select("config", "q", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


@query("v24_experiments")
def v24_experiments(spark, d):
    """Twelve configurations over all questions."""
    return _experiments(spark, d, CONFIGURATIONS)


_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    "v24_experiments_fused",
    f"""WITH q AS (SELECT item_id AS q, ts, embedding, label FROM (SELECT item_id, {_TOKENS} AS ts FROM benchmark) JOIN embeddings ON vec_id = item_id WHERE len(ts) >= 6),
    asked AS (SELECT 2 * q AS item_id, array_to_string(ts[1:4], ' ') AS text FROM q UNION ALL SELECT 2 * q + 1, array_to_string(ts[1:6], ' ') FROM q),
    {_LEXICAL.replace("FROM benchmark)", "FROM asked)")},
    tl AS (SELECT item_id // 2 AS q, item_id % 2 = 1 AS expand, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) AS rb FROM lex QUALIFY rb <= 50),
    vl AS (SELECT 'whole' AS source, a.q, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.q ORDER BY round({_COSINE}, 12) DESC, b.vec_id) AS rv FROM q a, embeddings b QUALIFY rv <= 50
      UNION ALL SELECT 'half', a.q, b.vec_id, row_number() OVER (PARTITION BY a.q ORDER BY round({_COSINE.replace("::DOUBLE[]", "[1:32]::DOUBLE[]")}, 12) DESC, b.vec_id) AS rv FROM q a, embeddings b QUALIFY rv <= 50),
    cf(config, alpha, expand, rerank, source) AS (VALUES {", ".join(f"('{c}', {a}::DOUBLE, {x}, {r}, '{s}')" for c, a, x, r, s, m in CONFIGURATIONS if m is None)}),
    f AS (SELECT coalesce(l.config, w.config) AS config, coalesce(l.q, w.q) AS q, coalesce(l.doc_id, w.doc_id) AS doc_id, rb, rv, coalesce(l.rerank, w.rerank) AS rerank,
      coalesce(l.alpha / (60 + rb), 0) + coalesce((1 - w.alpha) / (60 + rv), 0) AS rrf FROM (SELECT * FROM cf JOIN tl USING (expand)) l
      FULL JOIN (SELECT * FROM cf JOIN vl USING (source)) w ON l.config = w.config AND l.q = w.q AND l.doc_id = w.doc_id),
    h AS (SELECT *, row_number() OVER (PARTITION BY config, q ORDER BY round(rrf, 12) DESC, rb NULLS LAST, rv NULLS LAST, doc_id) AS p FROM f QUALIFY p <= 30),
    s AS (SELECT h.config, h.q, h.doc_id, p, CASE WHEN rerank AND b.embedding IS NOT NULL THEN {_COSINE} ELSE rrf * 61 END AS score, coalesce(a.label = b.label, false)::INT AS gain, a.label
      FROM h JOIN q a ON a.q = h.q LEFT JOIN embeddings b ON b.vec_id = h.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY config, q ORDER BY round(score, 12) DESC, p) AS place FROM s QUALIFY place <= 10),
    i AS (SELECT *, row_number() OVER (PARTITION BY config, q ORDER BY gain DESC, place) AS ideal FROM r),
    m AS (SELECT config, q, label, sum(gain) AS hits, sum(gain / log2(place + 1)) AS dcg, sum(gain / log2(ideal + 1)) AS best FROM i GROUP BY 1, 2, 3)
    SELECT config, q, round(hits / 10, 6) AS precision, round(hits / n, 6) AS recall, round(CASE WHEN best = 0 THEN 0 ELSE dcg / best END, 6) AS ndcg
    FROM m JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label)""",
)
def v24_experiments_fused(spark, d):
    """Those of the configurations that do not choose for variety."""
    return _experiments(spark, d, [c for c in CONFIGURATIONS if c[-1] is None])


@query(
    "v07_search_many",
    f"""WITH qq AS (SELECT item_id AS q, ts, array_to_string(ts[1:4], ' ') AS text, embedding FROM (SELECT item_id, {_TOKENS} AS ts FROM benchmark) JOIN embeddings ON vec_id = item_id WHERE len(ts) >= 6),
    {ANALYSED.removeprefix("WITH ").replace("FROM conversations WHERE text IS NOT NULL", "FROM qq")},
    kq AS (SELECT qq.q, qq.text, ts, embedding, a.alpha, a.boost, a.expand FROM qq JOIN a ON a.id = md5(qq.text)),
    asked AS (SELECT q AS item_id, array_to_string(ts[1:CASE WHEN expand THEN 6 ELSE 4 END], ' ') AS text FROM kq),
    {_LEXICAL.replace("FROM benchmark)", "FROM asked)").replace("qt AS", "qt_ AS").replace("FROM qt", "FROM qt_")},
    tp AS (SELECT item_id AS q, doc_id, bm25 FROM lex QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) <= 100),
    tb AS (SELECT kq.q, doc_id, tp.bm25 * CASE WHEN contains(lower(documents.text), kq.text) THEN boost ELSE 1 END AS bm25 FROM tp JOIN kq USING (q) JOIN documents USING (doc_id)),
    tl AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, doc_id) AS rb FROM tb),
    vl AS (SELECT a.q, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.q ORDER BY round({_COSINE}, 12) DESC, b.vec_id) AS rv FROM kq a, embeddings b QUALIFY rv <= 100),
    f AS (SELECT coalesce(tl.q, vl.q) AS q, coalesce(tl.doc_id, vl.doc_id) AS doc_id, rb, rv FROM tl FULL JOIN vl ON tl.q = vl.q AND tl.doc_id = vl.doc_id),
    g2 AS (SELECT f.*, kq.embedding AS own, coalesce(alpha / (60 + rb), 0) + coalesce((1 - alpha) / (60 + rv), 0) AS rrf FROM f JOIN kq USING (q)),
    h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 12) DESC, rb NULLS LAST, rv NULLS LAST, doc_id) AS p FROM g2 QUALIFY p <= 90),
    s AS (SELECT q, h.doc_id, p, CASE WHEN embedding IS NOT NULL THEN list_cosine_similarity(own::DOUBLE[], embedding::DOUBLE[]) ELSE rrf * 61 END AS score FROM h LEFT JOIN embeddings ON vec_id = h.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, p) AS place FROM s QUALIFY place <= 30),
    u AS (SELECT q, doc_id, score, place FROM r QUALIFY row_number() OVER (PARTITION BY q, doc_id % 12 ORDER BY place) = 1)
    SELECT q, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY place) AS place FROM u QUALIFY row_number() OVER (PARTITION BY q ORDER BY place) <= 10""",
)
def v07_search_many(spark, d):
    """The whole hybrid search for a table of questions: what each is sets its lexical share, boost and expansion."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    questions = _questions(spark, d).drop("label")
    read = expansion.analysed(questions, "q", "text", gazetteer(spark, d), STOP, ("what", "who", "how"), ("thanks",))
    questions = questions.join(read.select("q", "alpha", "boost", "expand"), "q")
    rest = {"wish": F.col("q").cast("string"), "rerank": F.lit(True), "source": F.lit("all"), "mmr": F.lit(None).cast("double")}
    wishes = questions.select("q", "alpha", "expand").withColumns(rest)
    texts = experiments.lexical_lists(_index(spark, d), wishes, questions, "q", "text", "more", 100)
    texts = experiments.phrase_boosted(texts, "q", docs, "doc_id", "text", questions, "text", "boost")
    near = experiments.vector_lists({"all": (nearest.build(e, "doc_id", "embedding"), questions)}, "q", "embedding", 100)
    hits = experiments.answers(wishes, "q", "doc_id", texts, near, e, "embedding", questions, 30)
    units = hits.select("doc_id").distinct().withColumn("unit", F.col("doc_id") % 12)
    best = experiments.best_of_units(hits, units, "doc_id", "unit", 10)
    return best.select(F.col("wish").cast("long").alias("q"), "doc_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(
    "v15_morphology",
    f"""WITH dt AS (SELECT CASE WHEN lower(lang) LIKE 'pt%' OR lang IN ('es') THEN 'pt' ELSE 'en' END AS config, {_TOKENS} AS ts FROM documents),
    pairs AS (SELECT DISTINCT config, ts[i] AS a, ts[i + 1] AS b FROM (SELECT config, ts, unnest(range(1, len(ts))) AS i FROM dt)),
    near AS (SELECT config, a AS token, 'after' AS side, b AS neighbour FROM pairs UNION ALL SELECT config, b, 'before', a FROM pairs),
    vocabulary AS (SELECT DISTINCT config, token FROM near),
    classed AS (SELECT config, token, stem FROM ({stems.stem_sql("(SELECT * FROM vocabulary WHERE config = 'en')", "token", "en")}) UNION ALL
      SELECT config, token, stem FROM ({stems.stem_sql("(SELECT * FROM vocabulary WHERE config = 'pt')", "token", "pt")})),
    rows_ AS (SELECT * FROM near JOIN classed USING (config, token)),
    met AS (SELECT x.config, x.token, y.token AS variant, count(*) AS shared FROM rows_ x JOIN rows_ y ON x.config = y.config AND x.stem = y.stem AND x.side = y.side AND x.neighbour = y.neighbour AND x.token <> y.token GROUP BY 1, 2, 3)
    SELECT config, token, variant, shared FROM met QUALIFY row_number() OVER (PARTITION BY config, token ORDER BY shared DESC, variant) <= 3""",
)
def v15_morphology(spark, d):
    """Up to three forms of each word of the documents; Spanish is read by the Portuguese rules, its nearest."""
    docs = table(spark, d, "documents").select("text", F.when(F.col("lang") == "es", "pt").otherwise(F.col("lang")).alias("lang"))
    return morphology.variants(docs, "text", "lang")


@query(
    "v13_service_requests",
    f"""WITH q AS (SELECT item_id AS q, ts, embedding, CASE item_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 ELSE 0.6 END AS alpha, item_id % 2 = 0 AS expand, item_id % 5 = 0 AS rerank,
      greatest(1, least(50, item_id * 3 - 4)) AS k, (item_id % 4) / 10.0::DOUBLE AS least_score FROM (SELECT item_id, {_TOKENS} AS ts FROM benchmark) JOIN embeddings ON vec_id = item_id WHERE len(ts) >= 6),
    asked AS (SELECT q AS item_id, array_to_string(ts[1:CASE WHEN expand THEN 6 ELSE 4 END], ' ') AS text FROM q),
    {_LEXICAL.replace("FROM benchmark)", "FROM asked)")},
    tl AS (SELECT item_id AS q, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) AS rb FROM lex QUALIFY rb <= 150),
    vl AS (SELECT a.q, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.q ORDER BY round({_COSINE}, 12) DESC, b.vec_id) AS rv FROM q a, embeddings b QUALIFY rv <= 150),
    f AS (SELECT coalesce(tl.q, vl.q) AS q, coalesce(tl.doc_id, vl.doc_id) AS doc_id, rb, rv FROM tl FULL JOIN vl ON tl.q = vl.q AND tl.doc_id = vl.doc_id),
    g AS (SELECT f.*, coalesce(alpha / (60 + rb), 0) + coalesce((1 - alpha) / (60 + rv), 0) AS rrf FROM f JOIN q USING (q)),
    h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 12) DESC, rb NULLS LAST, rv NULLS LAST, doc_id) AS p FROM g QUALIFY p <= 150),
    s AS (SELECT h.q, h.doc_id, p, k, least_score, CASE WHEN rerank AND b.embedding IS NOT NULL THEN {_COSINE} ELSE rrf * 61 END AS score, array_to_string(ts[1:4], ' ') AS wish
      FROM h JOIN q a ON a.q = h.q LEFT JOIN embeddings b ON b.vec_id = h.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, p) AS place FROM s QUALIFY place <= 50)
    SELECT q, place, r.doc_id, round(score, 4) AS score, lang, coalesce(contains(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), translate(lower(wish), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')), false) AS contains
    FROM r LEFT JOIN documents ON documents.doc_id = r.doc_id WHERE place <= k AND round(score, 4) >= least_score""",
)
def v13_service_requests(spark, d):
    """Requests of all modes, some of them for too few or too many hits."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    questions, n = _questions(spark, d).drop("label"), F.col("q")
    asked = questions.select(
        "q", "text", F.when(n % 3 == 0, "vector").when(n % 3 == 1, "lexical").otherwise("hybrid").alias("mode"), F.lit(0.6).alias("alpha"), (n * 3 - 4).alias("k"), (n % 2 == 0).alias("expand"),
        (n % 5 == 0).alias("rerank"), F.lit("all").alias("source"), F.lit(None).cast("double").alias("mmr"), (n % 4 / F.lit(10.0)).alias("min_score"),
    )
    wishes = experiments.requested(asked, "q", "text")
    texts = experiments.lexical_lists(_index(spark, d), wishes, questions, "q", "text", "more", 150)
    near = experiments.vector_lists({"all": (nearest.build(e, "doc_id", "embedding"), questions)}, "q", "embedding", 150)
    hits = experiments.answers(wishes, "q", "doc_id", texts, near, e, "embedding", questions, experiments.MOST_HITS)
    out = experiments.served(hits, wishes, docs, "doc_id", "text", ["lang"], questions, "q", "text")
    return out.withColumn("place", F.col("place").cast("long"))
