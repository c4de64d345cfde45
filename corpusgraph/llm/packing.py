"""Packing documents into token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import documents

#: Documents a group: enough lengths to choose from, few enough for one task.
GROUP_DOCS = 2048
#: Room for the windows of a group in a sequence's id.
_GROUP_BITS = 24

_PIECES = "unit long, salt long, doc_id long, start long, length long, crc long, head_crc long, tail_crc long, doc_tokens long, ids binary"
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]
_TYPES = [pa.int64()] * 9 + [pa.binary()]
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the largest sum of at most *capacity*.

    A bitset holds the sums that can be reached; one step adds one piece of a length.  The search
    ends at the step that reaches *capacity*; going back through the steps gives the counts.  Of equal sums the
    one with longer pieces wins.
    """
    mask = (1 << (capacity + 1)) - 1
    reached, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        for _ in range(min(counts[length], capacity // length)):
            after = (reached | reached << length) & mask
            if after == reached:
                break
            steps.append((length, reached))
            reached = after
            if reached >> capacity:
                break
        if reached >> capacity:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> total & 1:
            total -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def pack_lengths(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length) of pieces, or of parts of them: minimum bin slack.

    Each window starts with the longest piece left, so that no long piece is left for the end, and
    :func:`fill` picks what comes closest to filling the rest.  Where that leaves more than a 256th
    of the window and the longest piece is over half a window, that piece is cut at half a window,
    and both parts go back; every piece is cut once at most.
    """
    half = window // 2
    left: dict[int, list[tuple[int, int, int]]] = {}
    counts: dict[int, int] = {}

    def put(part: tuple[int, int, int]) -> None:
        left.setdefault(part[2], []).append(part)
        counts[part[2]] = counts.get(part[2], 0) + 1

    def take(n: int) -> tuple[int, int, int]:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return left[n].pop()

    for i, n in reversed(list(enumerate(lengths))):
        put((i, 0, n))
    windows = []
    while counts:
        longest = max(counts)
        first = take(longest)
        chosen = fill(counts, window - longest)
        slack = window - longest - sum(n * k for n, k in chosen.items())
        if slack > window // 256 and half < longest < window:
            put((first[0], 0, half))
            put((first[0], half, longest - half))
            continue
        windows.append([first, *(take(n) for n, k in chosen.items() for _ in range(k))])
    return windows


def cut_pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], window: int, keep_ids: bool) -> DataFrame:
    """Documents as pieces of *window* tokens and a shorter rest; *encoder* is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(), {}
        half = 4 * (window // 2)
        for batch in batches:
            rows: list[tuple] = []
            for unit, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = (encode(text) if text else b"") + b"\0\0\0\0"
                n = len(ids) // 4
                salt = seen[unit] = seen.get(unit, -1) + 1
                for start in range(0, n, window):
                    x = ids[4 * start : 4 * (start + window)]
                    parts = (zlib.crc32(x[:half]), zlib.crc32(x[half:])) if half < len(x) < 4 * window else (None, None)
                    rows.append((unit, salt, doc_id, start, len(x) // 4, zlib.crc32(x), *parts, n, x if keep_ids else None))
            columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return docs.select(F.xxhash64("doc_id", "text").alias("unit"), F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def pack(
    docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], window: int = 1024, keep_ids: bool = False
) -> DataFrame:
    """One row a piece: its document, place and ids' crc32, and its sequence and offset there.

    A document is the ids of its text (null or empty: none) and id 0.  It is cut into windows and a
    shorter rest, and the rests are packed; a sequence is never longer than *window*.  Rows that
    share a ``doc_id``, or are alike in all, are documents of their own; a null ``doc_id`` stays
    null.  Texts of any length are cut whole.  An empty table gives no row.  Other columns of *docs* are not read.  With *keep_ids* the
    pieces' ids come along (``ids``, little-endian 32-bit).

    Only lengths and checksums are shuffled (and ids where they are asked for): documents are dealt
    by a hash into groups of about GROUP_DOCS, of which each is packed by one task.  Rows that are
    alike go to different groups.  ``sequence_id`` has the group in its upper bits.  Reruns agree.
    """
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    pieces = cut_pieces(docs, encoder, window, keep_ids)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("unit", "salt"), F.lit(groups)))
    half = window // 2

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "unit", "salt", "start")])
        rows = table.to_pydict()
        base = rows["group"][0] << _GROUP_BITS
        out: list[tuple] = []
        for k, parts in enumerate(pack_lengths(rows["length"], window)):
            at = 0
            for i, start, n in parts:
                crc = rows["crc"][i] if n == rows["length"][i] else rows["tail_crc" if start else "head_crc"][i]
                ids = rows["ids"][i][4 * start : 4 * (start + n)] if keep_ids else None
                out.append((rows["doc_id"][i], rows["start"][i] + start, n, crc, rows["doc_tokens"][i], base + k, at, ids))
                at += n
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64()] * 7 + [pa.binary()] * keep_ids
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names)

    schema = _PACKED + ", ids binary" * keep_ids
    return dealt.groupBy("group").applyInArrow(run, schema)


def vocabulary_encoder(path: str | None = None) -> Callable[[], Callable[[str], bytes]]:
    """Makes the encoder of a byte-level BPE file, by default that of the installed public vocabularies."""

    def make() -> Callable[[str], bytes]:
        from corpusgraph.llm.tokens import Encoder

        if path is None:
            import public_tokenizers

            return Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode
        return Encoder(path).encode

    return make


def op9_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir), vocabulary_encoder())
