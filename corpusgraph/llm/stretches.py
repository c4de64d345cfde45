"""Stretches of text around shared anchors: how strings that stand in several places meet without their texts.

Every window of a text has an anchor, the place in it whose hash is least, so equal windows have equal
anchors at equal places.  Windows in a row with one anchor are a stretch, told by 16 bytes: the
anchor's hash and one of all that its windows hold.  Stretches meet by their anchors; texts are
read again only where stretches around one anchor differ, and there one text for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import cut

#: Of a text's stretches: anchors, contents, first windows and numbers of windows.
Stretches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _over(values: np.ndarray, span: int, choose: np.ufunc) -> np.ndarray:
    """The least or the greatest of each *span* values in a row."""
    size = 1
    while 2 * size <= span:
        values = choose(values[:-size], values[size:])
        size *= 2
    return choose(values[: len(values) - (span - size)], values[span - size :]) if span > size else values


def minimizers(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of *span* hashes in a row, by runs that share the leftmost place of their least hash:
    that place, the first window and the number of windows."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = _over(hashes, span, np.minimum)
    # A place is an anchor if it has the least hash of any window that it is in.
    around = np.zeros(n + 2 * (span - 1), np.uint64)
    around[span - 1 : span - 1 + n] = least
    held = np.flatnonzero(_over(around, span, np.maximum) == hashes)
    by = np.lexsort((held, hashes[held]))
    values, places = hashes[held][by], held[by]
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.concatenate([change[1:], [n]])
    low = np.searchsorted(values, least[change], "left")
    high = np.searchsorted(values, least[change], "right")
    anchor = np.repeat(places[low], ends - change)
    for i in np.flatnonzero(high - low > 1).tolist():
        # Window s has the first of these places that is not before s.
        at = places[low[i] : high[i]]
        a, b = change[i], ends[i]
        anchor[a:b] = at[np.searchsorted(at, np.arange(a, b))]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[first], first, np.diff(np.concatenate([first, [n]]))


def lists(parts: list[np.ndarray], kind: np.dtype) -> pa.ListArray:
    """Arrays as one column of lists."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind, copy=False)))


def keyed(docs: DataFrame) -> DataFrame:
    """``id``, ``key`` (a hash of id and text) and ``text``."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("key"), "text")


def stretches(docs: DataFrame, anchored: Callable[[str | None], Stretches]) -> DataFrame:
    """By text (``id`` and ``key``) its stretches, some 25 bytes each: lists ``anchor``, ``content``, ``first`` and ``owned``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchored(text) for text in batch.column(2).to_pylist()]
            wanted = np.flatnonzero([len(x[0]) for x in found])
            columns = [[found[i][k] for i in wanted] for k in range(4)]
            kinds = (np.int64, np.int64, np.int32, np.int32)
            some = pa.array(wanted)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(some), batch.column(1).take(some), *(lists(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["id", "key", "anchor", "content", "first", "owned"],
            )

    return cut(keyed(docs).mapInArrow(run, "id long, key long, anchor array<long>, content array<long>, first array<int>, owned array<int>"))


def shared(stored: DataFrame) -> DataFrame:
    """A row each for those of the :func:`stretches` whose anchor stands in two places or more, with what all of the anchor's hold:
    ``mixed`` (whether they differ), and the ``least`` and the ``most`` of their ids.

    Counts are combined on the map side; the join of stretches with the anchors is one that Spark splits.
    """
    rows = stored.select("id", "key", F.inline(F.arrays_zip("anchor", "content", "first", "owned")))
    anchors = rows.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"),
        F.min("id").alias("least"), F.max("id").alias("most"),
    )
    # A table by itself, so that the join is no part of the count and Spark can split a frequent anchor.
    anchors = cut(anchors.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"), "least", "most"))
    return cut(rows.join(anchors, "anchor"), discard=(stored, anchors))


def different(shared: DataFrame) -> DataFrame:
    """Where stretches of an anchor differ, each of them once: ``anchor``, ``content``, how often it stands
    somewhere (``n``), the ``least`` and ``most`` id there, and the ``carrier``, the key of one text with it."""
    return cut(
        shared.where("mixed").groupBy("anchor", "content").agg(
            F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.min("key").alias("carrier")
        )
    )


def bodies(docs: DataFrame, distinct: DataFrame, read: Callable[[str, np.ndarray, np.ndarray], tuple], fields: str, kinds: list[pa.DataType]) -> DataFrame:
    """``anchor``, ``content``, ``n``, ``least``, ``most`` and *fields* of the different stretches, from their carriers.

    ``read(text, anchors, contents)`` gives, for the stretches of a text that are asked for, their places in
    what is asked for and a list for each of *fields*.
    """
    told = ["anchor", "content", "n", "least", "most"]
    wanted = distinct.groupBy("carrier").agg(*[F.collect_list(F.coalesce(F.col(c), F.lit(-1))).alias(c) for c in told])
    names = [*told, *(f.split()[0] for f in fields.split(", "))]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        types = [pa.int64()] * len(told) + kinds
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                text = batch.column(0)[i].as_py()
                asked = [np.array(batch.column(k + 1)[i].values) for k in range(len(told))]
                at, *values = read(text, asked[0], asked[1])
                rows += zip(*(x[at].tolist() for x in asked), *values, strict=True)
                size += len(text)
                if size > 2 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    both = keyed(docs).join(wanted, F.col("key") == F.col("carrier")).select("text", *told)
    return both.mapInArrow(run, ", ".join([f"{c} long" for c in told] + [fields]))

