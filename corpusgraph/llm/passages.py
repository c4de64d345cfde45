"""Substring deduplication: paragraphs alike, by MinHash banding, and passages alike wherever they stand.

A line with enough words is a paragraph, and so is a run of shorter lines that has enough together.  Paragraphs that collide in
a band of minimum hashes, or short ones in one of their smallest shingle hashes, are compared exactly and joined
into components.  Passages that start or end within a line are found by windows of *min_words*
words, which meet by an anchor (equal windows always have the same) and are then compared by a hash of all their words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm import stretches
from corpusgraph.llm.common import cut, documents
from corpusgraph.llm.components import components
from corpusgraph.llm.joins import factors, linked_sets, stars_of
from corpusgraph.llm.rolling import Words, mix

#: Shingles up to which a paragraph has fewer smallest hashes to meet others by than bands.
_SHORT = 45
#: More words than a text has, so that a place and a number of words fit in one number.
_ROOM = 1 << 31
#: Words whose paragraphs are signed together.
_WORDS_A_PART = 1 << 17


def tune_bands(similarity: float, recall: float, far: float, chance: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows) of the least bands that bring pairs of *similarity* together with probability
    *recall*, and pairs as far apart as *far* with no more than *chance*, if *most* bands can."""
    fitting = []
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if bands <= most:
            fitting.append((1 - (1 - far**rows) ** bands > chance, bands, rows))
    _, bands, rows = min(fitting)
    return bands, rows


def line_paragraphs(words: list[int], least: int) -> list[tuple[int, int]]:
    """First word and number of words of each paragraph, from the numbers of words of a text's lines.

    A line of *least* words is one; of shorter lines a longest run is, if its lines have as many together.
    Lines without a word part nothing.
    """
    out, at, run = [], 0, 0
    for n in [*words, least]:
        if n >= least:
            if run >= least:
                out.append((at - run, run))
            out.append((at, n))
            run = 0
        else:
            run += n
        at += n
    return out[:-1]


def _signed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, num: int, den: int, bands: int, rows: int):
    """Of paragraphs, given by text as (shingle hashes of the text, first words, numbers of words), the sizes of
    their sets, a 64-bit name for each set, how many buckets each is in, and the keys of those in a row.

    Sets that link have num / den of the larger one in common, so the smallest common hash is among the
    first n - ceil(n num / den) + 1 of either: short paragraphs meet by those, and none that link are
    missed.  Longer ones have bands; sets up to den / num of _SHORT have both, so that they meet shorter ones too.
    """
    runs = [(h[a : a + c - k + 1]) for h, first, words in parts for a, c in zip(first.tolist(), words.tolist(), strict=True)]
    owner = np.repeat(np.arange(len(runs)), np.fromiter(map(len, runs), np.int64, len(runs)))
    hashes = np.concatenate(runs)
    by = np.lexsort((hashes, owner))
    hashes, owner = hashes[by], owner[by]
    once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
    hashes, owner = hashes[once], owner[once]
    n = np.bincount(owner, minlength=len(runs))
    starts = np.cumsum(n) - n
    names = mix(np.add.reduceat(mix(hashes), starts) + n.astype(np.uint64))
    short = np.where(n * num <= _SHORT * den, n + 1 + -n * num // den, 0)
    long = np.flatnonzero(n > _SHORT)
    counts = short.copy()
    counts[long] += bands
    at = np.cumsum(counts) - counts
    keys = np.empty(counts.sum(), np.uint64)
    place = np.arange(len(hashes)) - starts[owner]
    least = place < short[owner]
    keys[at[owner[least]] + place[least]] = mix(hashes[least])
    if len(long):
        own, firsts = hashes[(n > _SHORT)[owner]], np.cumsum(n[long]) - n[long]
        banded = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(long), axis=1)
        for i, f in enumerate(factors(bands * rows)):
            banded[i // rows] = mix(banded[i // rows] ^ np.minimum.reduceat(own * f, firsts))
        keys[(at + short)[long] + np.arange(bands)[:, None]] = banded
    return n, names, counts, keys


_PARAGRAPHS = "id long, key long, first long, words long, n long, set_id long, bands array<long>"


def paragraphs(docs: DataFrame, least: int, k: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """The paragraphs of *docs* with their place (``first`` word and number of ``words``), the size and the name of their sets, and bands.

    The name is a 64-bit hash of the set: two different sets of all are mistaken for one with a chance of
    their number squared by 2**-65.
    """
    names = [x.split()[0] for x in _PARAGRAPHS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signed(parts: list[tuple]) -> pa.RecordBatch:
            if not parts:
                empty = [pa.array([], t) for t in (*[pa.int64()] * 6, pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays(empty, names)
            sizes = [len(p[3]) for p in parts]
            n, sets, counts, keys = _signed([p[2:] for p in parts], k, num, den, bands, rows)
            columns = [np.repeat([p[i] for p in parts], sizes) for i in (0, 1)]
            columns += [*(np.concatenate([p[i] for p in parts]) for i in (3, 4)), n, sets.view(np.int64)]
            ends = np.cumsum(np.concatenate([[0], counts])).astype(np.int32)
            buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), buckets], names)

        for batch in batches:
            parts, size = [], 0
            for i in range(batch.num_rows):
                doc_id, key, text = (batch.column(c)[i].as_py() for c in range(3))
                lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
                own = line_paragraphs([len(x.split()) for x in lines], least)
                if own:
                    words = b"\n".join(lines).split()
                    first, count = np.array(own, np.int64).T
                    parts.append((doc_id, key, Words(words).runs(k), first, count))
                    size += len(words)
                if size > _WORDS_A_PART:
                    yield signed(parts)
                    parts, size = [], 0
            yield signed(parts)

    return stretches.keyed(docs.where(F.col("doc_id").isNotNull())).mapInArrow(run, _PARAGRAPHS)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set_id`` and ``text`` of wanted paragraphs (``set_id``, ``carrier``, ``first``, ``words``), a text's words with single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, texts, size = [], [], 0
            for i in range(batch.num_rows):
                words = batch.column(0)[i].as_py().encode("utf-8", "surrogatepass").lower().split()
                for x in batch.column(1)[i].as_py():
                    sets.append(x["set_id"])
                    texts.append(b" ".join(words[x["first"] : x["first"] + x["words"]]))
                    size += len(texts[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(texts, pa.binary())], ["set_id", "text"])
                    sets, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(texts, pa.binary())], ["set_id", "text"])

    by_text = wanted.groupBy("carrier").agg(F.collect_list(F.struct("set_id", "first", "words")).alias("asked"))
    both = stretches.keyed(docs).join(by_text, F.col("key") == F.col("carrier")).select("text", "asked")
    return both.mapInArrow(run, "set_id long, text binary").select("set_id", F.col("text").cast("string"))


def alike_paragraphs(docs: DataFrame, least: int, num: int, den: int, recall: float, k: int = 5) -> DataFrame:
    """``id``, ``first``, ``end`` (words) and ``keeper`` of paragraphs that paragraphs of other documents are like.

    The keeper is the smallest ``doc_id`` of the component.
    """
    bands, rows = tune_bands(num / den, recall, far=0.3, chance=0.1)
    signed = cut(paragraphs(docs, least, k, num, den, bands, rows))
    # One paragraph stands for all with its set.
    place = F.col("first") * _ROOM + F.col("words")
    sets = signed.groupBy("set_id").agg(
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("key").alias("carrier"), F.min_by(place, "key").alias("place")
    )
    first, words = F.shiftright("place", 31).alias("first"), F.pmod("place", F.lit(_ROOM)).alias("words")
    sets = cut(sets.select("set_id", "n", "bands", "carrier", first, words))
    stars = stars_of(sets)
    wanted = sets.select("set_id", "carrier", "first", "words").join(stars.select("set_id").distinct(), "set_id", "left_semi")
    texts = cut(_texts(docs, wanted), discard=(sets,))
    parts = linked_sets(stars, texts, k, num, den)
    parts = parts.select(F.col("node").alias("set_id"), "component")
    named = signed.select("set_id", "id", "first", "words").join(parts, "set_id", "left")
    named = cut(named.select(F.coalesce("component", "set_id").alias("component"), "id", "first", "words"), discard=(signed, stars, texts))
    groups = named.groupBy("component").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper <> last")
    groups = cut(groups.select("component", "keeper"))
    found = named.join(groups, "component").select("id", "first", (F.col("first") + F.col("words")).alias("end"), "keeper")
    return cut(found, discard=(named, groups))


def repeated_windows(docs: DataFrame, min_words: int, k: int = 8) -> DataFrame:
    """``id``, ``first``, ``end`` (words) and ``keeper`` of runs of words whose windows other documents hold too.

    The keeper is the smallest ``doc_id`` that holds a window.  Where all stretches around an anchor are equal no text is looked
    at; where they differ their windows are, one by one, from one text for each different stretch.
    """

    def found_in(text: str | None):
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(parts) < min_words:
            return None, *(np.empty(0, np.int64),) * 4
        words = Words(parts)
        hashes = words.runs(k)
        anchor, first, owned = stretches.minimizers(hashes, min_words - k + 1)
        content = words.between(words.starts[first], words.ends[first + owned + min_words - 2])
        return words, hashes[anchor].view(np.int64), content.view(np.int64), first, owned

    def read(text: str, anchors: np.ndarray, contents: np.ndarray):
        words, anchor, content, first, owned = found_in(text)
        windows = words.runs(min_words).view(np.int64)
        index = {x: i for i, x in enumerate(zip(anchor.tolist(), content.tolist(), strict=True))}
        both = [(j, index.get(x)) for j, x in enumerate(zip(anchors.tolist(), contents.tolist(), strict=True))]
        both = [x for x in both if x[1] is not None]
        return np.array([j for j, _ in both], np.int64), [windows[first[i] : first[i] + owned[i]].tolist() for _, i in both]

    known = docs.where(F.col("doc_id").isNotNull())
    met = stretches.shared(stretches.stretches(known, lambda text: found_in(text)[1:]))
    distinct = stretches.different(met)
    each = stretches.bodies(known, distinct, read, "windows array<long>", [pa.list_(pa.int64())])
    each = cut(each.select("anchor", "content", "least", "most", F.posexplode("windows").alias("at", "window")), discard=(distinct,))
    by_window = each.groupBy("anchor", "window").agg(F.min("least").alias("keeper"), F.max("most").alias("last")).where("keeper <> last")
    by_window = cut(by_window.drop("last"))
    told = (
        each.select("anchor", "content", "at", "window")
        .join(by_window, ["anchor", "window"])
        .groupBy("anchor", "content", "keeper")
        .agg(F.sort_array(F.collect_set("at")).alias("ats"))
    )
    told = cut(told.select("anchor", "content", "keeper", F.explode(_runs()).alias("run")), discard=(each, by_window))
    mixed = met.where("mixed").select("id", "anchor", "content", "first").join(told, ["anchor", "content"])
    mixed = mixed.select("id", (F.col("first") + F.col("run.a")).alias("first"), (F.col("first") + F.col("run.b")).alias("last"), "keeper")
    alone = met.where("not mixed and least <> most")
    alone = alone.select("id", "first", (F.col("first") + F.col("owned") - 1).alias("last"), F.col("least").alias("keeper"))
    runs = mixed.unionByName(alone)
    runs = runs.select("id", F.col("first").cast("long"), (F.col("last") + min_words).cast("long").alias("end"), "keeper")
    return cut(runs, discard=(met, told))


def _runs():
    """Of the sorted places ``ats``, the first and the last of each run without a gap."""
    starts = F.filter("ats", lambda x, i: (i == 0) | (F.get("ats", i - 1) != x - 1))
    ends = F.filter("ats", lambda x, i: (i == F.size("ats") - 1) | (F.get("ats", i + 1) != x + 1))
    return F.arrays_zip(starts.alias("a"), ends.alias("b")).cast("array<struct<a:int,b:int>>")


def repeated_passages(
    docs: DataFrame, min_words: int = 50, num: int = 80, den: int = 100, recall: float = 0.999, paragraph_words: int = 20
) -> DataFrame:
    """``id``, ``first``, ``end`` and ``keeper`` of every run of words in *docs* that other documents repeat.

    Paragraphs (lines of *paragraph_words* words, 5 at least, and runs of shorter lines with as many together) count with num / den of their 5-word shingles in common,
    passages of *min_words* words or more if they are equal but for letter case (A-Z) and white space.  ``keeper`` is the smallest
    ``doc_id`` of those that hold it, or of the component of alike paragraphs: it keeps the words,
    others lose them.  The two kinds are judged by themselves: of a passage that is kept for others, the
    words in a paragraph that is like one of a smaller ``doc_id`` go all the same, and what stays of them is that paragraph.

    Null texts and texts without a word have none; rows without a ``doc_id``
    are left alone; rows that share one are one document, which doesn't repeat itself.  Rows that are alike in all but the id are copies like others.
    An empty table gives no row, other columns are not read, and texts of any length are read whole.
    """
    if paragraph_words < 5:
        raise ValueError("paragraphs have 5 words at least")
    alike = alike_paragraphs(docs, paragraph_words, num, den, recall)
    return repeated_windows(docs, min_words).unionByName(alike)


def drop_passages(docs: DataFrame, **parameters) -> DataFrame:
    """*docs* without the passages that a document with a smaller ``doc_id`` keeps, as :func:`repeated_passages` finds them.

    An empty table stays empty; null and empty texts stay, and texts of any length are read whole.  Of rows that share a ``doc_id`` each loses what
    the document loses at the same words.  White space between the words that stay is kept as it is before each of them; other columns pass
    through, and texts that lose nothing stay as they are.
    """
    lost = repeated_passages(docs, **parameters).where("id <> keeper")
    lost = lost.groupBy("id").agg(F.collect_set(F.struct("first", "end")).alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [
                    text if not spans else _without(text, union([(s["first"], s["end"]) for s in spans]))
                    for text, spans in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["text", "row"])

    rows = docs.select(F.struct("*").alias("row")).join(lost, F.col("row.doc_id") == F.col("id"), "left")
    kind = rows.select("row").schema["row"].dataType.simpleString()
    out = rows.select("row.text", "lost", "row").mapInArrow(run, f"text string, row {kind}")
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : words[a - 1][1] if a else 0])
        at = words[b - 1][1]
    return "".join([*kept, text[at:]])


def op2_substring_dedup(spark, sf_dir):
    """A row for each document with passages that others repeat: how many words of it are in such
    passages, how many it loses (the smallest doc_id keeps them), and the smallest doc_id that it is connected with by passages."""
    found = cut(repeated_passages(documents(spark, sf_dir)))
    parts = components(found.select(F.col("id").alias("a"), F.col("keeper").alias("b")))
    spans = F.sort_array(F.collect_set(F.struct("first", "end")))
    lost = F.sort_array(F.collect_set(F.when(F.col("id") != F.col("keeper"), F.struct("first", "end"))))

    def length(column: str):
        """Words in the union of sorted spans."""
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
        step = lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["end"].cast("int") - F.greatest(s["to"], x["first"].cast("int")))).alias("n"),
            F.greatest(s["to"], x["end"].cast("int")).alias("to"),
        )
        return F.aggregate(column, state, step)["n"].cast("long")

    by_doc = found.groupBy("id").agg(spans.alias("spans"), lost.alias("lost"))
    counted = by_doc.select("id", length("spans").alias("n_repeated"), length("lost").alias("n_removed"))
    return counted.join(parts, F.col("id") == F.col("node")).select(
        F.col("id").alias("doc_id"), "n_repeated", "n_removed", F.col("component").alias("component_id")
    )
