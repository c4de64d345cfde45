"""Classes of words that are forms of each other, mined from a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import stems
from corpusgraph.functions import text as t
from corpusgraph.operators.matching import configuration
from corpusgraph.operators.relational import top_per_group
from corpusgraph.sources.tables import stored


def contexts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``config``, ``token``, ``side`` (of the neighbour) and ``neighbour``, once each: what every word stands next to in texts of a language."""
    ts = docs.select(configuration(lang).alias("config"), t.tokens(text).alias("ts")).where(F.size("ts") > 1)
    pairs = F.zip_with(F.slice("ts", F.lit(1), F.size("ts") - 1), F.slice("ts", F.lit(2), F.size("ts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = ts.select("config", F.inline(pairs)).distinct()
    both = F.array(
        F.struct(F.col("a").alias("token"), F.lit("after").alias("side"), F.col("b").alias("neighbour")),
        F.struct(F.col("b").alias("token"), F.lit("before").alias("side"), F.col("a").alias("neighbour")),
    )
    return rows.select("config", F.inline(both))


def variants(docs: DataFrame, text: str, lang: str, most: int = 3, least: int = 1) -> DataFrame:
    """Up to *most* other forms of each word: ``config``, ``token``, ``variant`` and ``shared``.

    Words of one stem are forms of each other where they stand next to the same words: at least *least* neighbours on a side in
    common (``shared``), the most first, then by the alphabet.  Words that are alone with their stem drop out before their
    neighbours are compared, and only forms of one stem at one neighbour meet; there are as many as a stem has forms.
    """
    near = stored(contexts(docs, text, lang))
    vocabulary = near.select("config", "token").distinct()
    stem = F.when(F.col("config") == "pt", stems.stem("token", "pt")).otherwise(stems.stem("token", "en"))
    classed = stored(vocabulary.withColumn("stem", stem))
    several = classed.groupBy("config", "stem").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    members = classed.join(several, ["config", "stem"])
    rows = near.join(members, ["config", "token"])
    other = rows.select("config", "stem", "side", "neighbour", F.col("token").alias("variant"))
    met = rows.join(other, ["config", "stem", "side", "neighbour"]).where(F.col("token") != F.col("variant"))
    counted = met.groupBy("config", "token", "variant").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    order = [F.desc("shared"), F.asc("variant")]
    return top_per_group(counted, ["config", "token"], order, most)


def synonyms(found: DataFrame) -> DataFrame:
    """Variants as a table that expands queries: ``term``, ``synonym`` and ``priority`` from 1 on."""
    place = F.row_number().over(Window.partitionBy("config", "token").orderBy(F.desc("shared"), "variant"))
    return found.select(F.col("token").alias("term"), F.col("variant").alias("synonym"), place.alias("priority"))
