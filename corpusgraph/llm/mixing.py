"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import cut, documents, n_words

#: The draw of a document is 44 bits of a digest, so that SQL can make it too.
_DRAW_BITS = 44
#: Slices of a source's order, by which the cut is found without sorting a source.
_SLICES = 4096
#: Rows of a table of one row a source up to which it is broadcast: a few MB at most.
_BROADCAST_SOURCES = 10_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """A row a source (``source``, ``source_size``, ``docs`` with words, ``target``) from rows of ``source`` and ``size``.

    Sources in the order of their code points, null last, have *weights* in turn and share all
    words; no target is over *most* times its source's size, and what is over goes to the others
    by weight.  The water level is found over the sources sorted by the level at which each is
    full: one row a source, not one a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs")).withColumn("weight", weight.cast("long"))
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0))
    levels = per_source.withColumn("left", left).withColumn("open", F.sum("weight").over(after))
    full = F.col("left") * F.col("weight") >= most * F.col("source_size") * F.col("open")
    # The first source that isn't full sets the level for itself and all after it.
    levels = levels.withColumn("level", F.when(~full, F.struct("left", "open")))
    level = F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(level.isNull(), (most * F.col("source_size")).cast("double")).otherwise(
        (level["left"] * F.col("weight")).cast("double") / level["open"].cast("double")
    )
    return levels.select("source", "source_size", "docs", target.alias("target"))


def mix_sources(docs: DataFrame, size: Column | None = None, seed: str = "mix", most: int = 3) -> DataFrame:
    """*docs* with a struct ``mix`` of ``size``, ``source_size``, ``target`` and ``copies``.

    A document of a source whose target is r times its size is first given floor(r) whole copies,
    which are certain.  The rest, p = r - floor(r), is the inclusion probability of one more for a document of the source's
    mean size; the inclusion odds of others are in proportion to their sizes, so that longer documents are likelier.  By
    Pareto order sampling each document draws u from a digest of *seed* and ``doc_id`` (the same in
    each run), and those with the smallest odds of u divided by their inclusion odds are taken until the
    words still missing are reached; the document that passes them is taken if the sum then comes
    nearer.  Ties are broken by ``doc_id`` and size; rows that are alike in all three are taken
    together.  Documents without words (null texts too) get no copies, a null ``doc_id`` draws as
    an empty one, and null sources are a source.  Texts of any length count with all their words.  An empty table gives an empty table.  Other
    columns pass through whatever their names are (an older ``mix`` is replaced).

    *size* is a column over *docs*; without it, words are counted.  No source is sorted or gathered: sums by
    source and slice of the order, combined on the map side, show in which slice the cut falls,
    twice over, and only the documents of that slice of a slice are put in order.
    """
    if size is None:
        size = n_words(F.col("text"))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("source").alias("source"),
        F.col("doc_id").alias("id"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
    )
    keys = cut(rows.select("source", "id", "size"))
    shares = (
        source_targets(keys, most=most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0))
    )
    shares = cut(shares)
    n_sources = shares.count()
    placed = _join_sources(keys.where("size > 0"), shares.where("p > 0"), n_sources).select(
        "source", "id", "size", "missing", _place(seed).alias("place")
    )
    first = _crossing(placed.withColumn("slice", F.floor(F.col("place") * _SLICES)), F.lit(0.0))
    inner = _join_sources(placed, first, n_sources).where(F.floor(F.col("place") * _SLICES) == F.col("cut_slice"))
    inner = inner.withColumn("slice", F.floor((F.col("place") * _SLICES - F.col("cut_slice")) * _SLICES))
    second = _crossing(inner.drop("cut_slice"), F.col("before"))
    last = _join_sources(inner.drop("cut_slice", "before"), second, n_sources).where(F.col("slice") == F.col("cut_slice"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("place", "id", "size"))
    cuts = (
        last.groupBy("source", "missing", "before", "place", "id", "size")
        .agg(F.sum("size").alias("words"))
        .withColumn("after", F.col("before") + running)
        .where(2 * F.col("after") - F.col("words") <= 2 * F.col("missing"))
        .groupBy("source")
        .agg(F.max(F.struct("place", "id", "size")).alias("last_taken"))
    )
    # Where no document of the inner slice is taken, all before it are.
    floor = first.withColumnRenamed("cut_slice", "outer").join(
        second.select(F.col("source").alias("s2"), F.col("cut_slice").alias("inner")),
        F.col("source").eqNullSafe(F.col("s2")), "left",
    )
    rule = shares.join(
        floor.select(F.col("source").alias("s1"), "outer", "inner"), F.col("source").eqNullSafe(F.col("s1")), "left"
    ).join(cuts.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")), "left")
    rule = cut(rule.drop("s1", "s3"))
    place = F.col("place")
    at_outer = F.floor(place * _SLICES)
    at_inner = F.floor((place * _SLICES - at_outer) * _SLICES)
    taken = (
        (F.col("size") > 0)
        & (F.col("p") > 0)
        & F.when(F.col("outer").isNull(), F.lit(False))
        .when(at_outer != F.col("outer"), at_outer < F.col("outer"))
        .when(F.col("inner").isNull(), F.lit(False))
        .when(at_inner != F.col("inner"), at_inner < F.col("inner"))
        .otherwise(F.coalesce(F.struct("place", "id", "size") <= F.col("last_taken"), F.lit(False)))
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + taken.cast("int")).otherwise(0).cast("long")
    decided = _join_sources(rows, rule, n_sources).withColumn("place", _place(seed))
    mix = F.struct("size", "source_size", "target", copies.alias("copies")).alias("mix")
    return decided.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "mix"], mix)


def _place(seed: str) -> Column:
    """q / (1 + q) for the ranking variable q of Pareto order sampling."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, _DRAW_BITS // 4), 16, 10).cast("double")
    u = (draw + 0.5) / float(1 << _DRAW_BITS)
    relative = F.col("size").cast("double") * F.col("docs").cast("double") / F.col("source_size").cast("double")
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")) * relative)
    return F.when((F.col("p") > 0) & (F.col("size") > 0), q / (1 + q))


def _join_sources(rows: DataFrame, by_source: DataFrame, n_sources: int) -> DataFrame:
    """*rows* with the columns of a table of one row a source.

    That table is broadcast while it is small, which is checked; beyond that Spark chooses, and
    splits large sources by its handling of skewed joins.
    """
    other = by_source.withColumnRenamed("source", "_s")
    other = F.broadcast(other) if n_sources <= _BROADCAST_SOURCES else other
    names = [c for c in by_source.columns if c != "source" and c in rows.columns]
    return rows.drop(*names).join(other, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _crossing(placed: DataFrame, before: Column) -> DataFrame:
    """The slice of each source in which its words reach what is missing, and the words before it."""
    sums = placed.groupBy("source", "slice", "missing", before.alias("base")).agg(F.sum("size").alias("words"))
    ends = sums.withColumn("end", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("slice")))
    start = F.col("end") - F.col("words")
    return ends.where((start < F.col("missing")) & (F.col("end") >= F.col("missing"))).select(
        "source", F.col("slice").alias("cut_slice"), start.alias("before")
    )


def op7_mixing(spark, sf_dir):
    out = mix_sources(documents(spark, sf_dir))
    return out.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken")
    )


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 11))::BIGINT + 0.5::DOUBLE)
           / 17592186044416::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (WHERE size > 0) AS docs,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER ())
       - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
       sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
       row_number() OVER w AS k
  FROM s WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), f AS (
  SELECT min(k) AS k FROM l WHERE rest * weight < 3 * source_size * open
), t AS (
  SELECT source, source_size, docs,
         CASE WHEN f.k IS NULL OR l.k < f.k THEN (3 * source_size)::DOUBLE
              ELSE ((SELECT rest FROM l l2 WHERE l2.k = f.k) * weight)::DOUBLE
                   / ((SELECT open FROM l l2 WHERE l2.k = f.k))::DOUBLE END AS target
  FROM l, f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), q AS (
  SELECT *, target - whole * source_size AS missing,
         CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS p FROM p
), r AS (
  SELECT d.doc_id, d.source, size, source_size, target, whole, missing, p,
         CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p) * (size::DOUBLE * docs::DOUBLE / source_size::DOUBLE)) END AS odds
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), o AS (
  SELECT *, odds / (1 + odds) AS place FROM r
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place NULLS LAST, doc_id, size) AS upto FROM o
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN size > 0 AND p > 0 AND 2 * upto - size <= 2 * missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
