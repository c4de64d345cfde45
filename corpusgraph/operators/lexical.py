"""A stored lexical index, and the best texts by BM25 for a table of queries, without reading what cannot be among them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as t
from corpusgraph.sources.tables import stored, workspace

#: Scores are compared by so many digits after the point; bounds are held against them with room for more.
DIGITS = 9
_ROOM = 1e-8
#: Words whose postings a task that builds an index gathers together, about.
TOKENS = 1 << 21
#: Postings that a task is to add up, about.
ROWS = 1 << 20


@dataclass(frozen=True)
class LexicalIndex:
    """Postings by term and range of documents, each range of a term with what bounds the part of a score that it can give.

    ``blocks`` is a folder of Parquet: ``bucket`` (of terms, a folder each), ``term``, ``range``, ``most`` and ``share`` (the term's largest number in
    a text, and of a text's tokens), ``words`` (its number in all), ``n`` and ``postings`` (key, the term's number in the text and the text's tokens),
    sorted by term and range for every TOKENS words of text.
    """

    spark: SparkSession
    path: str
    key: str
    key_type: str
    buckets: int
    documents: int
    mean: float
    range_docs: int
    k1: float
    b: float

    @property
    def blocks(self) -> DataFrame:
        postings = f"array<struct<{self.key}: {self.key_type}, tf: int, dl: int>>"
        schema = f"term string, range long, most int, share double, words int, n int, postings {postings}, bucket int"
        return self.spark.read.schema(schema).parquet(self.path)

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def part(self, tf: Column, dl: Column) -> Column:
        """What a term gives to a text's score, before the term's weight."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / F.lit(self.mean)))

    def top(self, most: Column, share: Column) -> Column:
        """What no text's :meth:`part` is above, by the largest number and share of the term: that part itself, if one text has both."""
        return (self.k1 + 1) / (1 + self.k1 * ((1 - self.b) / most + self.b / F.lit(self.mean) / share))


def _gatherer(index_key: str, range_docs: int):
    """Turns rows of key, class and tokens into blocks of ranges of one class each, some TOKENS of text at a time."""
    names = ["term", "range", "most", "share", "words", "n", "postings"]

    def blocks(rows: pa.RecordBatch, place: int) -> tuple[pa.RecordBatch, int]:
        """The rows' blocks by term and range, and the number of ranges; *place* is the first one's."""
        lengths, kinds = rows.column(2).value_lengths().to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(kinds, kind="stable")
        changes = np.diff(kinds[order], prepend=kinds[order[0]]) != 0
        within = np.arange(len(order)) - np.maximum.accumulate(np.where(changes, np.arange(len(order)), 0))
        ranges = np.cumsum(changes | (within % range_docs == 0)) - 1
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        words = rows.column(2).flatten().dictionary_encode()
        by_name = pc.array_sort_indices(words.dictionary).to_numpy()
        name = np.empty(len(by_name), np.int64)
        name[by_name] = np.arange(len(by_name))
        pairs, tf = np.unique(name[words.indices.to_numpy()] * len(order) + np.repeat(at, lengths), return_counts=True)
        term, doc = np.divmod(pairs, len(order))
        starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(ranges[doc], prepend=-1) != 0))
        tf, dl = tf.astype(np.int32), lengths[order][doc].astype(np.int32)
        each = [(np.maximum, tf), (np.maximum, tf / dl), (np.add, tf)]
        most, share, total = (pa.array(of.reduceat(x, starts, dtype=x.dtype) if len(starts) else x[:0]) for of, x in each)
        ends = np.append(starts, len(pairs)).astype(np.int32)
        kind = rows.schema.field(0).type
        fields = [pa.field(index_key, kind), pa.field("tf", pa.int32()), pa.field("dl", pa.int32())]
        postings = pa.StructArray.from_arrays([rows.column(0).take(pa.array(order[doc])), pa.array(tf), pa.array(dl)], fields=fields)
        terms = words.dictionary.take(pa.array(by_name[term[starts]]))
        columns = [terms, pa.array(place + ranges[doc[starts]]), most, share, total, pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), postings)]
        return pa.RecordBatch.from_arrays(columns, names), int(ranges[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // TOKENS)) + 1
            for first, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if end == first:
                    continue
                held.append(batch.slice(first, end - first))
                size += int(lengths[first:end].sum())
                if size >= TOKENS:
                    out, n = blocks(pa.concat_batches(held), place)
                    place, held, size = place + n, [], 0
                    yield out
        if held:
            yield blocks(pa.concat_batches(held), place)[0]

    return run


def build(
    docs: DataFrame, key: str, text: str, path: str | None = None, like: tuple[str, ...] = (), k1: float = 1.2, b: float = 0.75,
    range_docs: int = 32, buckets: int = 16,
) -> LexicalIndex:
    """Write the index of *docs* (*key* is unique; a null text is an empty one) to *path*, or a new folder that executors share.

    A range is *range_docs* documents at most that a task has read.  The more alike they are, the closer its bounds, so only those
    of one class share one: of like length (to a power of two) and the same in the columns *like* (language, say).  Texts are neither shuffled nor sorted: each
    task gathers the postings of some TOKENS words at a time, so that a term of all documents is spread as they are, and a large part of the table takes
    no more memory than a small one.  Texts are split into words once: their mean length is that of the postings written.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    index = LexicalIndex(docs.sparkSession, path or workspace(docs.sparkSession), key, dict(docs.dtypes)[key], buckets, docs.count(), 1.0, range_docs, k1, b)
    kind = F.xxhash64(*like, F.length(F.bin(F.length(whole))))
    own = docs.select(F.col(key), kind.alias("kind"), t.tokens(whole))
    postings = f"array<struct<{key}: {index.key_type}, tf: int, dl: int>>"
    blocks = own.mapInArrow(_gatherer(key, range_docs), f"term string, range long, most int, share double, words int, n int, postings {postings}")
    stored(blocks.withColumn("bucket", index.bucket(F.col("term"))), index.path, by="bucket", folders=buckets)
    words = index.blocks.agg(F.sum("words")).first()[0]
    return replace(index, mean=words / index.documents) if words else index


@dataclass(frozen=True)
class Asked:
    """What queries ask of an index: their terms with weights (a written table), and the bounds by range, with the postings behind them (another)."""

    index: LexicalIndex
    terms: DataFrame
    bounds: DataFrame
    blocks: DataFrame


def ask(index: LexicalIndex, queries: DataFrame, query_key: str, text: str, every: bool = False) -> Asked:
    """Bounds of the scores that documents of each range can have for each query, from block maxima alone.

    With *every*, only ranges in which all the query's terms occur are left.  Only the folders of the queries' terms are read (the
    numbers of buckets asked for are collected, at most all).
    """
    wanted = queries.select(query_key, F.explode(F.array_distinct(t.tokens(text))).alias("term"))
    wanted = stored(wanted.withColumns({"bucket": index.bucket(F.col("term")), "asked": F.count("*").over(Window.partitionBy(query_key))}))
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]
    blocks = index.blocks.where(F.col("bucket").isin(buckets))
    of_asked = blocks.join(wanted.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    maxima = stored(of_asked.select("bucket", "term", "range", index.top(F.col("most"), F.col("share")).alias("top"), "n"))
    df = F.col("df")
    idf = F.log((index.documents - df + 0.5) / (df + 0.5) + 1)
    known = maxima.groupBy("bucket", "term").agg(F.sum("n").alias("df")).select("bucket", "term", idf.alias("weight"))
    terms = stored(wanted.join(known, ["bucket", "term"]))
    # Ranges are put together before their terms meet queries, so that sums are whole where they are made.
    bounds = maxima.repartition("range").join(terms, ["bucket", "term"]).groupBy(query_key, "range").agg(
        F.sum(F.col("weight") * F.col("top")).alias("bound"), F.sum("n").alias("rows"), F.count("*").alias("_terms"), F.first("asked").alias("_asked")
    )
    if every:
        bounds = bounds.where("_terms = _asked")
    return Asked(index, terms, stored(bounds.select(query_key, "range", "bound", "rows")), blocks)


def scores(asked: Asked, query_key: str, chosen: DataFrame, every: bool = False) -> DataFrame:
    """Exact scores (``bm25``) of the documents in the *chosen* pairs of query and range.

    The blocks of the terms and ranges that are wanted are put together by range; there they meet the list of queries that want
    it and the terms' weights, and sums are whole where they are made.  There are as many tasks as leave some ROWS postings to each.
    """
    index = asked.index
    wished = stored(chosen.groupBy("range").agg(F.collect_list(query_key).alias("_queries"), F.sum("rows").alias("_rows")))
    tasks = max(index.spark.sparkContext.defaultParallelism, -(-(wished.agg(F.sum("_rows")).first()[0] or 0) // ROWS))
    blocks = asked.blocks.select("bucket", "term", "range", "postings").join(asked.terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    together = blocks.join(wished.select("range"), "range", "left_semi").repartition(tasks, "range")
    met = together.join(wished.drop("_rows"), "range").join(asked.terms, ["bucket", "term"])
    parts = met.where(F.array_contains("_queries", F.col(query_key))).select("range", query_key, "weight", "asked", F.inline("postings"))
    found = parts.groupBy("range", query_key, index.key).agg(
        F.sum(F.col("weight") * index.part(F.col("tf"), F.col("dl"))).alias("bm25"), F.count("*").alias("_n"), F.first("asked").alias("_asked")
    )
    return (found.where("_n = _asked") if every else found).select(query_key, index.key, "bm25")


def _best(found: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("bm25", DIGITS)), F.asc(key))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def promising(asked: Asked, query_key: str, k: int, every: bool = False) -> DataFrame:
    """The pairs of query and range that may hold one of the query's best *k*.

    The ranges with the largest bounds, with some *k* documents, are scored first.  Their k-th score is one that the best *k* of all reach,
    so ranges whose bound is below it are left out, and nothing else is.
    """
    index = asked.index
    order = Window.partitionBy(query_key).orderBy(F.desc("bound"), "range")
    first = asked.bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(4, -(-4 * k // index.range_docs)))
    reached = _best(scores(asked, query_key, first, every), query_key, index.key, k).where(F.col("place") == k)
    least = reached.select(query_key, F.col("bm25").alias("_least"))
    return asked.bounds.join(least, query_key, "left").where(F.col("bound") >= F.coalesce(F.col("_least"), F.lit(0.0)) - _ROOM).drop("_least")


def top_k(index: LexicalIndex, queries: DataFrame, query_key: str, text: str, k: int, every: bool = False) -> DataFrame:
    """*query_key*, the index's key, ``bm25`` and ``place`` of the best *k* texts of each query: those of an exhaustive search.

    A text scores by the query's terms that it has (with *every*: it must have all).  Ties are in the order of the key.
    """
    asked = ask(index, queries, query_key, text, every)
    return _best(scores(asked, query_key, promising(asked, query_key, k, every), every), query_key, index.key, k)
