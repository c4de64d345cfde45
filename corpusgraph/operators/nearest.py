"""A stored inverted-file index of vectors: lists around centroids, probed for near neighbours or, by bounds on angles, for exactly the nearest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.relational import top_per_group
from corpusgraph.sources.tables import stored, workspace

#: Centroids are fitted on so many vectors a list at most, and so many numbers in all; no more lists are made than MOST_LISTS.
SAMPLE_ROWS, SAMPLE_NUMBERS, MOST_LISTS = 64, 4_000_000, 4096
#: Vectors of a block, and queries that meet it together, about.
BLOCK, TOGETHER = 512, 256
#: Angles are exact to less than this, and similarities to less than its square.
_SLACK = 1e-6
_ROOM = 1e-10


def _unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=float)
    x = x.reshape(len(x), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of unit vectors by cosine: rounds of assignment and means, from evenly spread rows on; empty ones stay."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def enough_probes(x: np.ndarray, c: np.ndarray, recall: float, k: int = 10, queries: int = 256) -> int:
    """How many of the nearest lists hold the share *recall* of the *k* nearest, measured with rows of *x* among *x*.

    Among all vectors the nearest are nearer than in a sample of them, so a sample asks for more lists rather than for fewer.
    """
    some = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)
    near = x[some] @ x.T
    near[np.arange(len(some)), some] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
    place = np.argsort(np.argsort(-(x[some] @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort(np.take_along_axis(place, (x @ c.T).argmax(1)[best], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


@dataclass(frozen=True)
class VectorIndex:
    """Vectors in blocks, each of one list and near each other by their angle to its centroid.

    The table has ``list`` (a folder each), ``low`` and ``high`` (the block's angles), ``keys`` and ``vectors``.  *centers* (at most
    MOST_LISTS) and the lists' smallest and largest angles (*low*, *high*) are held by the driver.  *probes* lists are enough for
    the recall that the index was built for; *slices* says over how many tasks each list's blocks are to be dealt.
    """

    spark: SparkSession
    path: str
    key: str
    key_type: str
    vector_type: str
    centers: np.ndarray
    low: np.ndarray
    high: np.ndarray
    probes: int
    slices: tuple[int, ...]

    @property
    def blocks(self) -> DataFrame:
        schema = f"low double, high double, keys array<{self.key_type}>, vectors array<{self.vector_type}>, list int"
        return self.spark.read.schema(schema).parquet(self.path)


def build(vectors: DataFrame, key: str, column: str, path: str | None = None, lists: int | None = None, recall: float = 0.95) -> VectorIndex:
    """Write the index of *vectors* (of one dimension, without nulls; *key* is unique) to *path*, or a new folder that executors share.

    There are as many lists as the root of the rows, at most MOST_LISTS.  Centroids are fitted on an even sample by a hash of the key,
    of at most SAMPLE_ROWS vectors a list and SAMPLE_NUMBERS numbers, on which the number of lists to probe for *recall* is
    measured too; every vector is put in the list of its nearest centroid.
    Vectors are shuffled once, by list and a slice of it; the sample says how many slices a list needs, so that a large one is spread.
    """
    spark, n = vectors.sparkSession, vectors.count()
    dimensions = len((vectors.select(column).first() or [[0.0]])[0])
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n))
    most = min(SAMPLE_ROWS * lists, max(lists, SAMPLE_NUMBERS // dimensions))
    share = min(1.0, most / max(n, 1))
    taken = vectors.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = sorted(taken.select(key, column).limit(2 * most).collect())
    x = _unit([r[1] for r in sample]) if sample else np.zeros((0, dimensions))
    centers = centroids(x, min(lists, len(x))) if len(x) else np.zeros((1, dimensions))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = _unit(frame[column].tolist()) @ centers.T
                own = near.argmax(1)
                frame["list"], frame["angle"] = own.astype("int32"), np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                yield frame

    kinds = dict(vectors.dtypes)
    rows = vectors.select(key, column).mapInPandas(placed, f"{key} {kinds[key]}, {column} {kinds[column]}, list int, angle double")
    shares = np.bincount((x @ centers.T).argmax(1), minlength=len(centers)) / len(x) if len(x) else np.zeros(1)
    slices = tuple(int(share * n) // (64 * BLOCK) + 1 for share in shares)
    dealt = rows.repartition("list", F.pmod(F.xxhash64(key), F.get(F.lit(list(slices)), F.col("list")))).sortWithinPartitions("list", "angle", key)

    def blocked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cuts = np.flatnonzero(np.diff(frame["list"], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(frame)], strict=True):
                for at in range(a, b, BLOCK):
                    part = frame.iloc[at : min(b, at + BLOCK)]
                    yield pd.DataFrame({
                        "low": part["angle"].min(), "high": part["angle"].max(), "keys": [part[key].tolist()], "vectors": [part[column].tolist()], "list": part["list"].iloc[0],
                    })

    path = path or workspace(spark)
    schema = f"low double, high double, keys array<{kinds[key]}>, vectors array<{kinds[column]}>, list int"
    stored(dealt.mapInPandas(blocked, schema), path, by="list")
    index = VectorIndex(spark, path, key, kinds[key], kinds[column], centers, np.full(len(centers), np.pi), np.zeros(len(centers)), enough_probes(x, centers, recall) if len(x) else 1, slices)
    for r in index.blocks.groupBy("list").agg(F.min("low"), F.max("high")).collect():
        index.low[r[0]], index.high[r[0]] = r[1], r[2]
    return index


def _probes(index: VectorIndex, queries: DataFrame, query_key: str, column: str, nearest: int | None) -> DataFrame:
    """Pairs of query and list: the *nearest* lists of each query, or all that can hold a similarity of ``_least``."""
    kinds = dict(queries.dtypes)
    centers, low, high = index.centers, index.low, index.high
    filled = high >= low

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame) or not filled.any():
                continue
            angle = np.arccos(np.clip(_unit(frame[column].tolist()) @ centers.T, -1, 1))
            if nearest is not None:
                some = np.argsort(np.where(filled, angle, np.inf), axis=1, kind="stable")[:, :nearest]
                rows, lists = np.repeat(np.arange(len(frame)), some.shape[1]), some.ravel()
                least = np.full(len(rows), -2.0)
            else:
                nearby = np.maximum(np.maximum(angle - high, low - angle) - _SLACK, 0)
                least = frame["_least"].to_numpy()
                rows, lists = np.nonzero((np.cos(nearby) + _SLACK * _SLACK >= least[:, None]) & filled)
                least = least[rows]
            yield pd.DataFrame({
                query_key: frame[query_key].to_numpy()[rows], "_q": frame[column].to_numpy()[rows], "_angle": angle[rows, lists], "_least": least, "list": lists.astype("int32"),
            })

    return queries.mapInPandas(run, f"{query_key} {kinds[query_key]}, _q {kinds[column]}, _angle double, _least double, list int")


def _searched(index: VectorIndex, probes: DataFrame, query_key: str, n_queries: int, k: int) -> DataFrame:
    """The best *k* of each pair of a query and a block of a list that it probes, by similarity to 12 digits, as far as they reach ``_least``.

    Pairs of queries and lists grow faster than either, so both sides are shuffled by list and its slices, and neither is sent through the driver.
    """
    kinds, key = dict(probes.dtypes), index.key
    part = F.pmod(F.xxhash64(query_key), F.lit(n_queries // TOGETHER + 1))
    wish = F.struct(F.col(query_key).alias("key"), "_q", "_angle", "_least")
    together = probes.groupBy("list", part.alias("_part")).agg(F.collect_list(wish).alias("_wishes")).drop("_part")
    slices = F.get(F.lit(list(index.slices)), F.col("list"))
    wanted = together.select("*", F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice"))
    blocks = index.blocks.withColumn("_slice", F.pmod(F.xxhash64(F.get("keys", F.lit(0))), slices).cast("int"))
    met = blocks.join(wanted.hint("merge"), ["list", "_slice"]).drop("_slice")
    names = [query_key, key, "similarity", "_rounded"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, rows = [], 0
            for low, high, keys, vectors, wishes in zip(*(frame[c] for c in ("low", "high", "keys", "vectors", "_wishes")), strict=True):
                angle, least = (np.array([w[c] for w in wishes]) for c in ("_angle", "_least"))
                nearby = np.maximum(np.maximum(angle - high, low - angle) - _SLACK, 0)
                some = np.flatnonzero(np.cos(nearby) + _SLACK * _SLACK >= least)
                if not len(some):
                    continue
                ids, keys, x = np.array([wishes[i]["key"] for i in some]), np.asarray(keys), np.array(list(vectors), dtype=float)
                order = np.argsort(keys, kind="stable")
                keys, x = keys[order], x[order]
                size = np.linalg.norm(x, axis=1)
                near = (_unit([wishes[i]["_q"] for i in some]) @ x.T) / np.where(size == 0, np.inf, size)
                own = np.nan_to_num(np.round(near, 12), nan=-np.inf)
                best = np.argsort(-own, axis=1, kind="stable")[:, :k]
                values = np.take_along_axis(own, best, axis=1)
                # Of what is below a similarity that the k nearest reach, nothing is among them; products may differ in their last digits.
                at, place = np.nonzero(values >= np.where(least[some] > -2, least[some] - _ROOM, -np.inf)[:, None])
                found.append((ids[at], keys[best[at, place]], near[at, best[at, place]], values[at, place]))
                rows += len(at)
                if rows > 100_000:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))
                    found, rows = [], 0
            if found:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return met.mapInPandas(run, f"{query_key} {kinds[query_key]}, {key} {index.key_type}, similarity double, _rounded double")


def search(index: VectorIndex, queries: DataFrame, query_key: str, column: str, k: int, probes: int | None = None) -> DataFrame:
    """Up to *k* near vectors of each query, from the nearest lists (the index's number of *probes* or another): *query_key*, the
    index's key and ``similarity``; ties by key.  A list's blocks meet its queries in groups, by an equality join."""
    found = _near(index, stored(queries.select(query_key, column)), query_key, column, k, probes or index.probes)
    return found.drop("_rounded")


def _near(index: VectorIndex, queries: DataFrame, query_key: str, column: str, k: int, probes: int | None) -> DataFrame:
    found = _searched(index, _probes(index, queries, query_key, column, probes), query_key, queries.count(), k)
    return top_per_group(found, [query_key], [F.desc("_rounded"), F.asc(index.key)], k)


def search_exactly(index: VectorIndex, queries: DataFrame, query_key: str, column: str, k: int) -> DataFrame:
    """The *k* nearest vectors of each query, as :func:`search` gives them but none missed.

    The k-th similarity in a few lists is one that the nearest reach; then only lists and blocks are looked at whose angles allow
    as much.
    """
    queries = stored(queries.select(query_key, column))
    first = _near(index, queries, query_key, column, k, max(1, len(index.centers) // 16))
    reached = stored(first.groupBy(query_key).agg(F.min("_rounded").alias("_least"), F.count("*").alias("_n")))
    least = F.when(F.col("_n") >= k, F.col("_least")).otherwise(-2.0)
    wide = stored(queries.join(reached.select(query_key, least.alias("_least")), query_key, "left").fillna(-2.0, ["_least"]))
    return _near(index, wide, query_key, column, k, None).drop("_rounded")


def recall(found: DataFrame, exact: DataFrame, query_key: str, key: str) -> DataFrame:
    """The share of *exact* pairs that were *found*, over all queries: ``pairs``, ``hits`` and ``recall``."""
    met = exact.select(query_key, key).join(found.select(query_key, key).withColumn("_hit", F.lit(1)), [query_key, key], "left")
    counts = met.agg(F.count("*").alias("pairs"), F.count("_hit").alias("hits"))
    return counts.withColumn("recall", F.col("hits") / F.col("pairs"))
