"""Removal of repeated substrings, found by merging Burrows-Wheeler transforms of shards.

Work is dealt by content: each string of the length asked for has an anchor, the k bytes in it whose
hash is smallest (the leftmost of them), so equal strings have equal anchors at equal places.  Where
all stretches around an anchor are the same, their strings are repeated and no text is looked at.  Stretches that differ meet
in one task, which transforms them shard by shard, merges the transforms and reads the repeated
intervals off the refined interleave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.bwt import WIDTH, repeated_starts
from corpusgraph.llm.common import cut, documents
from corpusgraph.llm.rolling import Rolling
from corpusgraph.llm.stretches import bodies, different, keyed, minimizers, shared, stretches

#: Bytes of an anchor, as a share of the string: longer anchors collide less, shorter ones leave longer stretches.
_ANCHOR_SHARE = 0.3
#: Bytes of stretches that a task's bucket is to hold, and that may go on under one key.
BUCKET_BYTES = 2 << 20


def _anchored(text: str | None, length: int, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, and of its stretches the anchor's hash and place, a hash of all bytes, the first start and the number of starts."""
    rolling = Rolling((text or "").encode("utf-8", "surrogatepass"))
    hashes = rolling.every(k)
    anchor, first, owned = minimizers(hashes, length - k + 1)
    content = rolling.between(first, first + owned + length - 1)
    return rolling.data, hashes[anchor].view(np.int64), anchor, content.view(np.int64), first, owned


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


_ROWS = "anchor long, content long, n long, owned int, core int, width int, body binary"
_PIECES = "whole long, part long, shift int, " + _ROWS
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 3, pa.binary()]


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Stretches cut in two, with keys of their own that tell more of the bytes around the anchor.

    ``core`` and ``width`` say where in the body the bytes are that all stretches of the key have in common.
    A string of *length* bytes has half or more of the rest before them or after them: strings of the
    first kind are dealt on by the bytes before, the others by those after, so equal strings stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PIECES.split(", ")]
        for batch in batches:
            out = []
            for whole, part, n, owned, core, width, body in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                before = -(-(length - width) // 2)
                after = length - width - before + 1
                left = min(max(core - before + 1, 0), owned)
                if left:
                    x = body[: left - 1 + length]
                    key = _digest(b"<", whole.to_bytes(8, "little", signed=True), body[core - before : core])
                    out.append((whole, part, 0, key, _digest(x), n, left, core - before, width + before, x))
                if left < owned:
                    x = body[left:]
                    key = _digest(b">", whole.to_bytes(8, "little", signed=True), body[core + width : core + width + after])
                    out.append((whole, part, left, key, _digest(x), n, owned - left, core - left, width + after, x))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], names)

    return rows.mapInArrow(run, _PIECES)


def _dealt(rows: DataFrame, length: int, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of which no key has more than *limit* bytes of different bodies, and by step how pieces come from wholes.

    Halving tells the keys' strings apart until they are equal, so it ends after log2(*length*) steps at most.
    """
    calm, steps = [], []
    while True:
        heavy = cut(rows.groupBy("anchor").agg(F.sum(F.octet_length("body")).alias("bytes")).where(F.col("bytes") > limit).select("anchor"))
        if heavy.isEmpty():
            calm.append(rows)
            break
        calm.append(rows.join(heavy, "anchor", "left_anti"))
        pieces = cut(_halves(rows.join(heavy, "anchor", "left_semi"), length))
        steps.append(pieces.select("whole", "part", "shift", "anchor", "content"))
        same = [F.first(c).alias(c) for c in ("owned", "core", "width", "body")]
        rows = cut(pieces.groupBy("anchor", "content").agg(F.sum("n").alias("n"), *same).select(*rows.columns))
    out = calm[0]
    for x in calm[1:]:
        out = out.unionByName(x)
    return out, steps


def _solved(rows: DataFrame, length: int) -> DataFrame:
    """``anchor``, ``content`` and the ``runs`` of starts of each stretch that are repeated, as first and end in turn."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("content")
        flags = repeated_starts(table.column("body").to_pylist(), table.column("owned").to_numpy(), table.column("n").to_numpy(), length)
        runs = [np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8))) for f in flags]
        kept = pa.array(np.flatnonzero([len(r) for r in runs]), pa.int64())
        runs = pa.array([r.tolist() for r in runs if len(r)], pa.list_(pa.int32()))
        return pa.table([table.column("anchor").take(kept), table.column("content").take(kept), runs], ["anchor", "content", "runs"])

    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(max(1, total // BUCKET_BYTES))).alias("bucket")
    return rows.select(bucket, "anchor", "content", "n", "owned", "body").groupBy("bucket").applyInArrow(run, "anchor long, content long, runs array<int>")


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """``id``, ``key`` and ``starts`` (pairs of first and end) of the strings of *length* bytes found again."""
    k = max(WIDTH, int(length * _ANCHOR_SHARE))

    def anchored(text: str | None):
        _, anchor, _, content, first, owned = _anchored(text, length, k)
        return anchor, content, first, owned

    def read(text: str, anchors: np.ndarray, contents: np.ndarray):
        data, anchor, place, content, first, owned = _anchored(text, length, k)
        index = {x: i for i, x in enumerate(zip(anchor.tolist(), content.tolist(), strict=True))}
        found = [(j, index.get(x)) for j, x in enumerate(zip(anchors.tolist(), contents.tolist(), strict=True))]
        found = [x for x in found if x[1] is not None]
        at = np.array([j for j, _ in found], np.int64)
        own = np.array([i for _, i in found], np.int64)
        cuts = zip(first[own].tolist(), (first + owned)[own].tolist(), strict=True)
        return at, owned[own].tolist(), (place - first)[own].tolist(), [k] * len(own), [data[a : b + length - 1] for a, b in cuts]

    met = shared(stretches(docs, anchored))
    distinct = different(met)
    fields = "owned int, core int, width int, body binary"
    texts = bodies(docs, distinct, read, fields, [pa.int32()] * 3 + [pa.binary()]).drop("least", "most")
    texts = cut(texts.select(*[x.split()[0] for x in _ROWS.split(", ")]), discard=(distinct,))
    dealt, steps = _dealt(texts, length, BUCKET_BYTES)
    solved = cut(_solved(dealt, length), discard=(texts,))
    for step in reversed(steps):
        moved = F.transform("runs", lambda x: x + F.col("shift")).alias("runs")
        whole = solved.join(step, ["anchor", "content"]).select(F.col("whole").alias("anchor"), F.col("part").alias("content"), moved)
        solved = cut(solved.unionByName(whole))

    alike = met.where("not mixed").select("id", "key", "first", F.array(F.lit(0), "owned").alias("runs"))
    told = met.where("mixed").join(solved, ["anchor", "content"]).select("id", "key", "first", "runs")
    runs = F.transform("runs", lambda x: x + F.col("first"))
    return cut(alike.unionByName(told).groupBy("id", "key").agg(F.flatten(F.collect_set(runs)).alias("starts")), discard=(met, solved))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed, as pairs of first byte and end) and ``kept`` bytes.

    Every byte that a string of *length* bytes (8 or more) covers which also starts anywhere else in any text, its own
    included, is removed; overlapping strings count, and all are judged on the input.  A null text
    is empty.  Rows are texts of their own even if they share a ``doc_id`` or are alike.  Other
    columns are not read, an empty table gives no row, and strings never cross texts.  Texts of any
    length are cut whole; a task holds one such text and what its stretches say.

    A text's stretches cost some 25 bytes per 140 of text, and are shuffled twice.  Texts are shuffled
    twice: to one that stands for each group of different stretches, and to meet the spans.
    """
    if length < WIDTH:
        raise ValueError(f"strings have {WIDTH} bytes at least")
    runs = repeated_runs(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "n_bytes", "spans", "kept"], (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                doc_id, text, starts = (batch.column(k)[i].as_py() for k in range(3))
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = covered(np.array(starts or [], np.int64).reshape(-1, 2), length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rows.append((doc_id, len(data), [x for s in spans for x in s], b"".join([*kept, data[at:]])))
                size += len(data)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = keyed(docs)
    runs = runs.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "starts")
    both = rows.join(runs, (F.col("key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2")), "left")
    return both.select(F.col("id").alias("doc_id"), "text", "starts").mapInArrow(run, "doc_id long, n_bytes long, spans array<int>, kept binary")


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that strings of *length* bytes cover, from pairs of first start and end."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, starts.tolist())):
        end = b - 1 + length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def op3_suffix_dedup(spark, sf_dir):
    out = remove_repeats(documents(spark, sf_dir))
    pairs = F.size("spans") / 2
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        pairs.cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
