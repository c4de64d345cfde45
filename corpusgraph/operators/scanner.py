"""References to passages in running text: names of books of any number of words, with chapter and verses after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import text as t

_TOKENS = r"\p{L}+|[0-9]+|\S"


def candidates(texts: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """The runs of up to *words* words and numbers right before a number of a text: what may be a name with a reference.

    Of each: ``start`` and ``last`` (places of tokens, of the name's first and the reference's last), ``n`` tokens of the name, its ``key``
    (:func:`~corpusgraph.functions.text.ascii_key` of the run), ``chapter``, ``verse`` and ``end_verse``.  A full stop may stand between
    name and number; a colon or full stop, and a dash, between chapter, verse and end.  Numbers have three digits at most.  Texts are
    read whole, and only places that have a number after them become rows.
    """
    rows = texts.select(F.col(key).alias("_id"), F.regexp_extract_all(F.lower(text), F.lit(_TOKENS), F.lit(0)).alias("_ts"))
    token = lambda i: F.coalesce(F.get("_ts", i), F.lit(""))
    # A token that begins with a digit is a run of them, so no pattern is needed at every place.
    number = lambda i: (token(i) >= "0") & (token(i) < ":") & (F.length(token(i)) <= 3)
    word = lambda i: token(i).rlike(r"^\p{L}+$")
    value = lambda i: token(i).try_cast("int")

    def ends(p: Column) -> Column:
        """The name's last token before the number at *p*, or null."""
        return F.when(word(p - 1), p - 1).when((token(p - 1) == ".") & word(p - 2), p - 2)

    found = F.filter(F.sequence(F.lit(1), F.size("_ts")), lambda p: number(p) & ends(p).isNotNull())
    numbers = rows.select("_id", "_ts", F.explode(found).alias("_p")).withColumn("_e", ends(F.col("_p")))
    p = F.col("_p")
    verse = F.when(token(p + 1).isin(":", ".") & number(p + 2), value(p + 2))
    end = F.when(verse.isNotNull() & token(p + 3).isin("-", "–") & number(p + 4), value(p + 4))
    parsed = numbers.select("_id", "_ts", "_p", "_e", value(p).alias("chapter"), verse.alias("verse"), F.coalesce(end, verse).alias("end_verse"), end.isNotNull().alias("_wide"))
    last = F.col("_p") + F.when(F.col("_wide"), 4).when(F.col("verse").isNotNull(), 2).otherwise(0)
    runs = parsed.select("*", last.alias("last"), F.explode(F.sequence(F.lit(1), F.lit(words))).alias("n")).withColumn("start", F.col("_e") - F.col("n") + 1)
    run = F.slice("_ts", F.col("start") + 1, F.col("n"))
    whole = runs.where("start >= 0").withColumn("_run", run).where(~F.exists("_run", lambda x: ~x.rlike(r"^(\p{L}+|[0-9]+)$")))
    return whole.select(F.col("_id").alias(key), "start", "last", "n", t.ascii_key(F.array_join("_run", "")).alias("key"), "chapter", "verse", "end_verse")


def leftmost_longest(matches: DataFrame, key: str) -> DataFrame:
    """Of matches of a text (``start``, ``last``, ``n``) those that a reader finds from left to right: at each place the longest name, none
    that begins within one found before.

    Matches that overlap, one way or another, are put together; each such stretch is gone through by itself.
    """
    order = Window.partitionBy(key).orderBy("start", F.desc("n"))
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum(F.when(F.coalesce(before >= F.col("start"), F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rest = [c for c in matches.columns if c not in (key, "start", "n")]
    rows = matches.withColumn("_stretch", stretch)
    alone = F.struct("start", (-F.col("n")).alias("_n"), *rest)
    lists = rows.groupBy(key, "_stretch").agg(F.sort_array(F.collect_list(alone)).alias("_m"))

    def step(taken: Column, m: Column) -> Column:
        free = (F.size(taken) == 0) | (F.element_at(taken, -1)["last"] < m["start"])
        return F.when(free, F.concat(taken, F.array(m))).otherwise(taken)

    kept = F.aggregate("_m", F.slice("_m", 1, 1), step)
    found = lists.select(key, F.inline(kept))
    return found.withColumn("n", -F.col("_n")).select(*matches.columns)


def scan(texts: DataFrame, key: str, text: str, aliases: DataFrame, words: int = 4) -> DataFrame:
    """The references in running texts: *key*, ``start`` (the place of its first token), ``book``, ``chapter``, ``verse`` and ``end_verse``.

    *aliases* has a row a ``key`` (of a name of up to *words* words) and its ``book``.  Names meet the runs of words before numbers by
    equality.
    """
    met = candidates(texts, key, text, words).join(aliases.select("key", "book"), "key").drop("key")
    return leftmost_longest(met, key).select(key, "start", "book", "chapter", "verse", "end_verse")
