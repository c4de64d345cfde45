"""Finding what names stand for."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import references as ref
from corpusgraph.functions import text as t
from corpusgraph.operators.relational import top_per_group


def cascade(
    wanted: DataFrame, name: str, tiers: list[tuple[str, float, DataFrame]], id_: str,
    fuzzy_tiers: list[tuple[str, DataFrame]] | None = None, candidate: str = "name", least: float = 0.85, score=None,
) -> DataFrame:
    """Each wanted name with the smallest id of the first tier that knows it, ``method`` and ``confidence``.

    A tier is (method, confidence, table of names and ids).  All tiers are one table with ranks, so
    that one join does for them all.  What no tier knows is then compared with the names of each of *fuzzy_tiers* (method, and table of
    *candidate* and id) by *score* (:func:`fuzzy_ratio`, or :func:`fuzzy`), whose value is the confidence: the best of the first tier
    that has one of at least *least*.
    """
    known = None
    for k, (method, confidence, names) in enumerate(tiers):
        rows = names.select(name, id_, F.lit(k).alias("_k"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
        known = rows if known is None else known.unionByName(rows)
    best = known.groupBy(name).agg(F.min(F.struct("_k", id_, "method", "confidence")).alias("best"))
    joined = wanted.join(best, name, "left")
    found = joined.select(
        name, F.col("best")[id_].alias(id_), F.coalesce("best.method", F.lit("unmatched")).alias("method"),
        F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"),
    )
    if not fuzzy_tiers:
        return found
    left, near = found.where("method = 'unmatched'").select(name), None
    for k, (method, names) in enumerate(fuzzy_tiers):
        ids = names.groupBy(candidate).agg(F.min(id_).alias("_id"))
        rows = (score or fuzzy_ratio)(left, name, ids.select(candidate), candidate, least).join(ids, candidate)
        rows = rows.select(F.col(name).alias("_name"), F.lit(k).alias("_k"), F.lit(method).alias("_method"), "_id", F.col("score").cast("double").alias("_score"))
        near = rows if near is None else near.unionByName(rows)
    near = near.groupBy("_name").agg(F.min(F.struct("_k", "_method", "_id", "_score")).alias("_best"))
    both = found.join(near, F.col(name) == F.col("_name"), "left")
    hit = F.col("_name").isNotNull()
    return both.select(
        name, F.when(hit, F.col("_best._id")).otherwise(F.col(id_)).alias(id_), F.when(hit, F.col("_best._method")).otherwise(F.col("method")).alias("method"),
        F.when(hit, F.col("_best._score")).otherwise(F.col("confidence")).alias("confidence"),
    )


def _segment(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Where part *i* of a text cut evenly into *parts* begins (from 0), and its length; the longer ones come last."""
    size, short = F.floor(length / parts).cast("int"), parts - length % parts
    return i * size + F.greatest(i - short, F.lit(0)), size + F.when(i >= short, 1).otherwise(0)


def candidates(wanted: DataFrame, name: str, names: DataFrame, candidate: str, least: float, errors) -> DataFrame:
    """Pairs of a wanted name and another that may be as near as ``errors(a, b)`` edits, for lengths a and b of at least *least* of each other.

    A name cut into one part more than the edits allowed has a part that none of them touches, and that stands in the other name, moved
    by no more than the edits before and after it allow.  So names meet by part and lengths, equality joins, and no pair is missed.
    """
    lengths = lambda c: F.sequence(F.ceil(F.length(c) * least - 1e-9).cast("int"), F.floor(F.length(c) / least + 1e-9).cast("int"))
    own = names.select(candidate).where(F.length(candidate) > 0).distinct().withColumn("_b", F.length(candidate))
    own = own.select("*", F.explode(lengths(candidate)).alias("_a")).where("_a > 0").withColumn("_t", errors(F.col("_a"), F.col("_b")))
    # Names with no more letters than edits meet all of their lengths.
    parts = F.when(F.col("_b") > F.col("_t"), F.sequence(F.lit(0), F.col("_t"))).otherwise(F.array(F.lit(-1)))
    own = own.select("*", F.explode(parts).alias("_i"))
    at, size = _segment(F.col("_b"), F.col("_t") + 1, F.col("_i"))
    own = own.select(candidate, "_a", "_b", "_i", F.when(F.col("_i") >= 0, F.substring(candidate, at + 1, size)).otherwise("").alias("_part"))

    other = wanted.select(name).where(F.length(name) > 0).distinct().withColumn("_a", F.length(name))
    other = other.select("*", F.explode(lengths(name)).alias("_b")).where("_b > 0").withColumn("_t", errors(F.col("_a"), F.col("_b")))
    other = other.select("*", F.explode(F.when(F.col("_b") > F.col("_t"), F.sequence(F.lit(0), F.col("_t"))).otherwise(F.array(F.lit(-1)))).alias("_i"))
    at, size = _segment(F.col("_b"), F.col("_t") + 1, F.col("_i"))
    more, left = F.col("_a") - F.col("_b"), F.col("_t") - F.col("_i")
    lowest = F.greatest(at - F.col("_i"), at + more - left, F.lit(0))
    highest = F.least(at + F.col("_i"), at + more + left, F.col("_a") - size)
    places = F.when(F.col("_i") < 0, F.array(F.lit(0))).when(lowest <= highest, F.sequence(lowest, highest))
    other = other.select("*", size.alias("_size"), F.explode(places).alias("_at"))
    part = F.when(F.col("_i") >= 0, F.substring(name, F.col("_at") + 1, F.col("_size"))).otherwise("")
    keys = other.select(name, "_a", "_b", "_i", part.alias("_part")).distinct()
    return keys.join(own, ["_a", "_b", "_i", "_part"]).select(name, candidate).distinct()


def _edits(least: float):
    """So many edits leave a score of *least* by the longer length; the room is for rounding."""
    return lambda a, b: F.floor((1 - least) * F.greatest(a, b) + 1e-9).cast("int")


def fuzzy(wanted: DataFrame, name: str, names: DataFrame, candidate: str, least: float) -> DataFrame:
    """The best candidate of each name by 1 - edit distance / longer length, if it scores *least*; ties by name."""
    longer = F.greatest(F.length(name), F.length(candidate))
    pairs = candidates(wanted, name, names, candidate, least, _edits(least))
    scored = pairs.withColumn("score", 1 - F.levenshtein(name, candidate) / longer).where(F.col("score") >= least)
    return top_per_group(scored, [name], [F.desc("score"), F.asc(candidate)])


def fuzzy_ratio(wanted: DataFrame, name: str, names: DataFrame, candidate: str, least: float = 0.85) -> DataFrame:
    """As :func:`fuzzy`, by the ratio of matching blocks (2 m / total length).

    What matches is a common subsequence, so what does not is inserted or deleted: at most 1 - *least* of the total length.
    """

    def ratio(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["score"] = [
                difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(frame[name], frame[candidate], strict=True)
            ]
            yield frame

    edits = lambda a, b: F.floor((1 - least) * (a + b) + 1e-9).cast("int")
    pairs = candidates(wanted, name, names, candidate, least / (2 - least), edits)
    scored = pairs.mapInPandas(ratio, f"{name} string, {candidate} string, score double").where(F.col("score") >= least)
    return top_per_group(scored, [name], [F.desc("score"), F.asc(candidate)])


def unify(people: DataFrame, name: str, kind: str, mixed: str) -> DataFrame:
    """A row a name; its kind, or *mixed* where it occurs with several."""
    return people.groupBy(name).agg(F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise(mixed).alias(kind))


def alias_map(aliases: DataFrame, key: str, priority: str, id_: str) -> DataFrame:
    """The id of each key: that of the first priority, and of the smallest id in it."""
    return aliases.where(F.col(key) != "").groupBy(key).agg(F.min(F.struct(priority, id_))[id_].alias(id_))


def resolve_references(texts: DataFrame, id_: str, text: str, aliases: DataFrame, books: DataFrame) -> DataFrame:
    """Each reference of each text: *id_*, ``place`` (from 0), ``segment``, ``book`` (its code), chapter, verse, their ends, and ``status``.

    *aliases* (``key``, ``priority``, ``book``) has names of any number of words as :func:`~corpusgraph.functions.text.ascii_key` gives them, of which the first
    priority counts; *books* has ``book`` and its number of ``chapters``.  The status is ``ok``, ``unparsed``, ``book_not_found``
    or ``chapter_out_of_range``.
    """
    known = alias_map(aliases, "key", "priority", "book").join(books.select("book", "chapters"), "book", "left")
    parts = texts.select(id_, F.posexplode(ref.segments(text)).alias("place", "segment")).withColumn("p", ref.parse("segment"))
    named = parts.withColumn("key", t.ascii_key("p.book")).join(known, "key", "left")
    last = F.coalesce("p.end_chapter", "p.chapter")
    status = (
        F.when(~F.col("p.ok"), "unparsed").when(F.col("book").isNull(), "book_not_found")
        .when((F.col("p.chapter") < 1) | (F.greatest("p.chapter", last) > F.col("chapters")), "chapter_out_of_range").otherwise("ok")
    )
    return named.select(id_, "place", "segment", "book", *[f"p.{c}" for c in ("chapter", "verse", "end_chapter", "end_verse")], status.alias("status"))
