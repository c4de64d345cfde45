"""Similarity self-join of documents on word n-grams, by signature trees."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import cut, documents, remove, to_all
from corpusgraph.llm.components import components
from corpusgraph.llm.rolling import mix, shingles
from corpusgraph.llm.signature_tree import linked

#: Sets, and their shingles, that one task compares with those of one other block, and with each other.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19


def factors(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(x: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of *rows* minimum hashes of a set of hashes."""
    times = factors(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 8192):
        np.minimum(low, (x[i : i + 8192, None] * times).min(axis=0), out=low)
    keys = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        keys = mix(keys ^ column)
    return keys


def _signatures(docs: DataFrame, k: int, bucket_keys: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``doc_id``, the size of the set, 128 bits that name it, and the keys of its buckets."""
    names = ["doc_id", "n", "a", "b", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                x = shingles(text, k)
                digest = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(x))
                a.append(digest[0])
                b.append(digest[1])
                keys.append(bucket_keys(x).view(np.int64) if len(x) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], names
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, a long, b long, bands array<long>"
    )


def stars_of(sets: DataFrame) -> DataFrame:
    """``hub``, ``set_id`` and ``n``: the sets that share a bucket with a hub, the smallest id in it, and the hubs too.

    However many buckets two sets share, they are one row; any two sets of a bucket are in its hub's star.
    """
    placed = sets.select("set_id", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.min("set_id").alias("hub")).where("m > 1").select("bucket", "hub")
    # A table by itself, so that the join is no part of the count and Spark can split a frequent bucket.
    shared = cut(shared)
    return cut(placed.join(to_all(shared), "bucket").groupBy("hub", "set_id").agg(F.first("n").alias("n")), discard=(shared,))


def _first_tasks(stars: DataFrame, large: DataFrame) -> DataFrame:
    """``task``, ``set_id`` and ``component``: each star is a task, a *large* one several, each of which has the hub.

    Sets of no star but of hubs' own never need a task.
    """
    split = stars.join(large, "hub", "left")
    part = F.pmod(F.xxhash64("set_id"), F.coalesce("parts", F.lit(1)))
    own = split.select("hub", "set_id", F.when(F.col("set_id") != F.col("hub"), part).alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"))
    every = F.when(F.col("part").isNull(), F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).otherwise(F.array("part"))
    dealt = own.select("hub", "set_id", F.explode(every).alias("part"))
    return dealt.select(F.xxhash64("hub", "part").alias("task"), "set_id", F.col("set_id").alias("component"))


def _still_apart(stars: DataFrame, large: DataFrame, parts: DataFrame) -> DataFrame:
    """``bucket``, ``set_id``, ``n`` and ``component`` of the large stars that hold more than one component."""
    named = parts.select(F.col("node").alias("set_id"), "component")
    rows = stars.join(large.select("hub"), "hub", "left_semi").join(named, "set_id", "left")
    rows = cut(rows.select(F.col("hub").alias("bucket"), "set_id", "n", F.coalesce("component", "set_id").alias("component")))
    several = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return rows.join(several.select("bucket"), "bucket", "left_semi")


def _blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of (bucket, set_id, n, component) dealt to ``task``: every pair of sets of a bucket that may
    link and isn't joined meets in one.

    A bucket's sets are put in blocks of about BLOCK, alike in size and, where a component is large,
    of one component; pairs of blocks whose sizes rule a link out, or that hold the same one component, get no task.
    """
    step = F.floor(F.log(1.25, "n"))
    # Few buckets need more than one block, so the rest has no part in working them out.
    need = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    crowded = rows.groupBy("bucket").agg(need.alias("parts")).where("parts > 1").select("bucket")
    crowded = cut(crowded)
    calm = rows.join(crowded, "bucket", "left_anti").withColumn("block", F.lit(0).cast("long"))
    rows = rows.join(crowded, "bucket", "left_semi").withColumn("step", step)
    large = rows.groupBy("bucket", "component").agg(F.count("*").alias("m")).where(F.col("m") >= BLOCK // 2)
    rows = rows.join(large.select("bucket", "component", F.lit(True).alias("large")), ["bucket", "component"], "left")
    # Every shape has a number of its own, by which rows meet their counts.
    shape = F.xxhash64("bucket", "step", F.when(F.col("large"), F.col("component")))
    rows = cut(rows.withColumn("shape", shape))
    parts = rows.groupBy("shape").agg(need.alias("parts"))
    block = F.xxhash64("shape", F.pmod(F.xxhash64("set_id"), F.col("parts"))).alias("block")
    blocked = cut(rows.join(parts, "shape").select("bucket", "set_id", "n", "component", block))
    nodes = blocked.groupBy("bucket", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("first"), F.max("component").alias("last")
    )
    x, y = nodes.alias("x"), nodes.alias("y")
    pairs = x.join(y, "bucket").where(
        (F.col("x.block") <= F.col("y.block"))
        & ~((F.col("x.first") == F.col("y.last")) & (F.col("x.last") == F.col("y.first")))
        & (F.least("x.high", "y.high") * den >= F.greatest("x.low", "y.low") * num)
    )
    task = F.xxhash64("bucket", "x.block", "y.block").alias("task")
    tasks = pairs.select("bucket", task, F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    met = blocked.join(tasks, ["bucket", "block"]).select("task", "set_id", "component")
    return calm.select(F.col("bucket").alias("task"), "set_id", "component").unionByName(met)


def _compared(tasks: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between sets of the same task that are not of one component, by dual traversal of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> list[tuple[int, int]]:
            pairs = linked([shingles(t, k) for _, _, t in rows], [c for _, c, _ in rows], num, den)
            return [(rows[i][0], rows[j][0]) for i, j in pairs]

        task, rows = None, []
        for batch in batches:
            found = []
            for t, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if t != task:
                    found += solved(rows)
                    task, rows = t, []
                rows.append(tuple(row))
            yield _edges(found)
        yield _edges(solved(rows))

    with_text = tasks.join(texts, "set_id").select("task", "set_id", "component", "text")
    return with_text.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def linked_sets(stars: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``node`` and ``component`` of the sets that link, from their stars and their ``texts`` (by ``set_id``).

    All links are found by the signature trees of tasks.  First each star has a tree, or in parts of BLOCK sets or
    so, each with the hub, several.  Of stars in parts, what is not of one component by then meets in pairs of parts.
    """
    sizes = stars.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).alias("parts")
    large = cut(sizes.select("hub", parts).where("parts > 1"))
    links = cut(_compared(_first_tasks(stars, large), texts, k, num, den))
    found = components(links)
    if large.isEmpty():
        return found
    apart = cut(_still_apart(stars, large, found))
    more = cut(_compared(_blocks(apart, num, den), texts, k, num, den), discard=(apart,))
    if more.isEmpty():
        return found
    return components(links.union(more))


def similarity_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 3) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row of *docs*.

    Two documents link when num / den of the union of their sets of *k*-word shingles is common to
    both; a component is named by its smallest ``doc_id``.  Null and empty texts and such without
    words have an empty set, link with nothing and are components of their own.  A text of fewer
    than *k* words is one shingle, and a very long one is compared whole.  Rows that share a ``doc_id`` are one document, which links where any of its
    texts does; rows without one link with nothing and have a null component.  Other columns of
    *docs* are not read.  An empty table gives no row.

    Documents with the same set are one node from the start, however many there are.  Minimum hashes only deal the
    sets out: those that share the key of a band of *rows* of them have a task in common; of sets that link, all but
    (1 - 0.8 ** 3) ** 32 = 1e-10 do, at the threshold, and above it fewer still are
    missed (hashes of 64 bits stand for shingles, by the same reasoning).  Which sets of a task link is
    found by dual traversal of its signature tree: no pair that may link is left out, and pairs that are joined
    already are not looked at.
    """
    signed = cut(_signatures(docs, k, lambda x: band_keys(x, bands, rows)))
    sets = signed.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(
        F.min("doc_id").alias("set_id"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    sets = cut(sets)
    stars = stars_of(sets)
    wanted = cut(stars.select("set_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("set_id"), "text").join(to_all(wanted), "set_id", "left_semi")
    texts = cut(texts, discard=(wanted,))
    parts = linked_sets(stars, texts, k, num, den)
    remove(texts, stars)

    own = parts.select(F.col("node").alias("set_id"), "component")
    named = sets.select("a", "b", "set_id").join(own, "set_id", "left")
    named = named.select("a", "b", F.coalesce("component", "set_id").alias("component"))
    joined = signed.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """*docs* with one document of each component of :func:`similarity_groups`: its smallest ``doc_id``.

    Rows stay as they are, with all columns.  Of rows that share a ``doc_id`` one stays; rows
    without one all stay, and so do null and empty texts, which are like nothing.  Texts of any length are compared whole; an empty table
    gives an empty one.
    """
    groups = similarity_groups(docs, **parameters)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    kept = rows.where("id is not null").join(gone, F.col("id") == gone["doc_id"], "left_anti").dropDuplicates(["id"])
    return kept.union(rows.where("id is null")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op4_ngram_jaccard_join(spark, sf_dir):
    return similarity_groups(documents(spark, sf_dir))

