"""Line deduplication: drop lines that many documents share, but for one copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import SPACES, bind, cut, documents

#: A key is frequent if it holds one in so many of the shared lines, so there are no more than so many.
_FREQUENT_KEYS = 500
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased.

    ``lower`` is much faster than ``translate`` and the same where all is ASCII.
    """
    return bind(
        F.trim(line, F.lit(SPACES)),
        lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _UPPER.lower())),
    )


def _key_hashes(text: Column, min_chars: int) -> Column:
    """Of each line that is long enough: its position and 128 bits of its key."""

    def one(line: Column, at: Column) -> Column:
        return bind(
            line_key(line),
            lambda k: F.struct(
                at.alias("at"),
                F.when(F.length(k) >= min_chars, F.xxhash64(k)).alias("a"),
                F.xxhash64(F.lit(7), k).alias("b"),
            ),
        )

    return F.filter(F.transform(_lines(text), one), lambda x: x["a"].isNotNull())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """*docs* with a new ``text``, and a struct ``line_stats`` of ``n_lines`` and ``n_dropped``.

    Lines are split at newlines (a null or empty text is one empty line).  A key of at least
    *min_chars* code points that at least *min_docs* different ``doc_id`` hold loses all its lines,
    except those in the largest ``doc_id`` that holds it.  Lines that stay keep their order and are
    joined by newlines; a text that loses no line stays as it is (null too), one that loses all is
    empty.  Rows with the same ``doc_id`` count as one document; a row without one is no document
    to the count, but loses shared lines.  Other columns pass through whatever their names are (an
    older ``line_stats`` is replaced).  Texts of any length are split whole.  An empty table gives an empty table.

    The count is combined on the map side, first by key and document and then by key, so that a
    line of a third of all documents costs one row a task.  Keys that hold at least a 500th of all
    shared lines, of which there are at most 500, meet their lines by a broadcast, the others by a
    shuffle of hashes; the text is shuffled once, to meet the positions of the lines it loses.
    """
    long_lines = docs.select(
        "doc_id", F.xxhash64("text").alias("version"), F.explode(_key_hashes(F.col("text"), min_chars)).alias("k")
    ).select("doc_id", "version", "k.*")
    shared = (
        long_lines.where(F.col("doc_id").isNotNull())
        .select("a", "b", "doc_id")
        .distinct()
        .groupBy("a", "b")
        .agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n"))
        .where(F.col("n") >= min_docs)
    )
    shared = cut(shared)
    held = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") * _FREQUENT_KEYS >= held
    hot, cold = F.broadcast(shared.where(frequent)).drop("n"), shared.where(~frequent).drop("n")
    of_hot = long_lines.join(hot, ["a", "b"])
    of_cold = long_lines.join(hot.drop("keeper"), ["a", "b"], "left_anti").join(cold, ["a", "b"])
    lost = (
        of_hot.unionByName(of_cold)
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "version")
        .agg(F.collect_set("at").alias("lost"))
        .select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "lost")
    )
    rows = docs.select(F.struct("*").alias("row"))
    met = rows.join(
        lost, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_version")), "left"
    )
    lines = _lines(F.col("row.text"))
    stay = bind(
        lines,
        lambda x: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("lost")), lambda i: F.element_at(x, i + 1)
            ),
            "\n",
        ),
    )
    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(stay).alias("text")
    stats = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    ).alias("line_stats")
    return met.select(
        *[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "line_stats"], stats
    )


def op8_line_dedup(spark, sf_dir):
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "line_stats.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: trim() and lower() of DuckDB know more than ASCII, hence the regular expression and translate().
OP8_SQL = """
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE s.key IS NOT NULL AND k.doc_id <> s.keeper) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
                       FILTER (WHERE s.key IS NULL OR k.doc_id = s.keeper), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY k.doc_id
"""
