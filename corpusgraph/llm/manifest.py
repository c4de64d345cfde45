"""Merkle manifests: a root for a data set, a proof for each row, and what a changed row does to the root."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import bind, cut, documents

#: Nodes that make one node of the next level.
FAN = 8
#: Characters of a hash.
WIDTH = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_hash(*fields: Column) -> Column:
    """The hash of a row: of each field ``-`` for null, or else its UTF-8 byte count, a colon and its value."""
    parts = [bind(x.cast("string"), lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))) for x in fields]
    return F.sha2(F.concat(*parts), 256)


def siblings(steps: Column) -> Column:
    """The other hashes of each run on the way to the root, from left to right and from the leaf up.

    A step holds a parent's preimage, from which the node's own slot is cut out.
    """
    return F.array_join(F.transform(steps, lambda s: F.overlay(s["preimage"], F.lit(""), s["slot"] * WIDTH + 1, F.lit(WIDTH))), "")


def fold(steps: Column, leaf: Column) -> Column:
    """The root that follows from *leaf* and its siblings: its hash is put into its slot of each preimage in turn."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["slot"] * WIDTH + 1, F.lit(WIDTH)), 256))


def _placed(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """*rows* (a written table) with ``_at``, their place from 0 on in their tree, and its size ``_n``; and the table that this reads.

    Ranges of all trees are sorted each by itself, so that a large tree is spread; the places before a range come from a
    table of a row a range and tree.
    """
    ranges = rows.repartitionByRange(F.col("tree"), *order).sortWithinPartitions(F.col("tree"), *order)
    ranges = cut(ranges.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)))
    parts = ranges.groupBy("_range", "tree").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    own = Window.partitionBy("tree")
    before = F.sum("_rows").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_n": F.sum("_rows").over(own)}).drop("_rows")
    at = F.col("_id") - F.col("_first") + F.col("_before")
    return ranges.join(parts, ["_range", "tree"]).select(*rows.columns, at.alias("_at"), "_n"), ranges


def _parents(nodes: DataFrame, at: str, of: list[str]) -> DataFrame:
    """Runs of FAN nodes, in order, as lists: ``index`` and ``children`` with ``slot`` and the columns *of*."""
    child = F.struct((F.col(at) % FAN).cast("int").alias("slot"), *of)
    return nodes.groupBy("tree", F.floor(F.col(at) / FAN).alias("index")).agg(
        F.array_sort(F.collect_list(child), lambda a, b: a["slot"] - b["slot"]).alias("children"), F.first("_n").alias("_below")
    )


def _levels(rows: DataFrame, order: list[str]) -> list[DataFrame]:
    """The levels of all trees over *rows* (a written table, used up), from the parents of leaves up, each a written table.

    *rows* have a ``tree``, a ``hash``, the columns of *order* and a ``row`` that the first level keeps in its ``children``.
    A row of a level is a parent: ``index``, its ``preimage`` (its children's hashes in a row), its hash ``node``, and
    ``_n``, the number of parents of its tree there.  A tree of one leaf has no parent: ``node`` is the leaf, ``preimage`` null.
    """
    placed, table = _placed(rows, [F.asc_nulls_first(c) for c in order] + [F.asc("hash")])
    up = F.ceil(F.col("_below") / FAN).alias("_n")
    preimage = F.array_join(F.transform("children", lambda c: c["hash"]), "")
    node = F.coalesce(F.sha2("preimage", 256), F.col("children")[0]["hash"]).alias("node")
    first = _parents(placed, "_at", ["hash", "row"])
    first = first.select("tree", "index", "children", up, F.when(F.col("_below") > 1, preimage).alias("preimage"))
    levels = [cut(first.select("*", node), discard=(rows, table))]
    most = levels[0].agg(F.max("_n")).first()[0] or 1
    while most > 1:
        below = levels[-1].where("_n > 1").withColumn("hash", F.col("node"))
        level = _parents(below, "index", ["hash"]).select("tree", "index", up, preimage.alias("preimage"))
        levels.append(cut(level.select("*", F.sha2("preimage", 256).alias("node"))))
        most = -(-most // FAN)
    return levels


def _climbed(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first level with *above*, a row a tree (``root``, ``subroot`` and ``steps``), whose steps follow those of the tree.

    Steps go down from the roots, so that rows meet ancestors of their own run alone, and a large tree is no hot key.
    """
    rows = None
    for level in reversed(levels):
        kept = [c for c in level.columns if c != "_n"]
        here = level.where("_n = 1").join(above, "tree").select(*kept, "subroot", "steps")
        if rows is not None:
            step = F.struct((F.col("index") % FAN).cast("int").alias("slot"), F.col("_preimage").alias("preimage"))
            higher = rows.select("tree", F.col("index").alias("_index"), F.col("preimage").alias("_preimage"), "subroot", "steps")
            lower = level.where("_n > 1").withColumn("_index", F.floor(F.col("index") / FAN)).join(higher, ["tree", "_index"])
            here = here.unionByName(lower.select(*kept, "subroot", F.concat(F.array(step), "steps").alias("steps")))
        rows = here
    return rows


def _leaves(level: DataFrame) -> DataFrame:
    """The leaves below a climbed first level: their ``row``, ``subroot`` and ``steps``."""
    child = level.select("preimage", "subroot", "steps", F.explode("children").alias("c"))
    step = F.struct(F.col("c.slot").alias("slot"), "preimage")
    steps = F.when(F.col("preimage").isNull(), F.col("steps")).otherwise(F.concat(F.array(step), "steps"))
    return child.select(F.col("c.row").alias("row"), "subroot", steps.alias("steps"))


def manifest(rows: DataFrame, leaf: str, group: str, order: list[str]) -> DataFrame:
    """*rows* with a struct ``proof``: the ``subroot`` of their group, the ``root`` of all, and the ``steps`` from the row to it.

    *leaf* is the column of a row's hash, *group* one of text.  Each group is a tree: its leaves by *order* (null first; of
    equal ones by hash, so that only rows of one hash are interchangeable) are taken FAN at a time, the last run being
    shorter, until one node is left; a single leaf is its own subroot.  The groups' subroots, null first and then by
    bytes, are the leaves of the last tree.  A step is a parent's ``preimage``, the hashes of its children in a row, and
    the ``slot`` (from 0) of the node in it; :func:`siblings` and :func:`fold` read them.  Other columns pass through whatever
    their names are (an older ``proof`` is replaced); an empty table gives an empty one.

    Rows are shuffled twice, to be placed and to meet their run; each further level is an eighth of the one below.  The
    levels are tables in the shared folder, which the result reads; what led to them is removed.
    """
    kept = [c for c in rows.columns if c != "proof"]
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))  # sorts as the group does, with null first
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]
    levels = _levels(cut(rows.select(key.alias("tree"), F.col(leaf).alias("hash"), *keys, F.struct(*kept).alias("row"))), [f"_by{i}" for i in range(len(order))])
    roots = reduce(DataFrame.unionByName, [x.where("_n = 1").select("tree", F.col("node").alias("hash")) for x in levels])
    roots = cut(roots.select(F.lit("").alias("tree"), F.col("tree").alias("_by0"), "hash", F.struct("tree", F.col("hash").alias("subroot")).alias("row")))
    tops = _levels(roots, ["_by0"])
    top = tops[-1].select(F.lit("").alias("tree"), F.col("node").alias("subroot"), F.array().cast("array<struct<slot:int,preimage:string>>").alias("steps"))
    above = _leaves(_climbed(tops, top)).select("row.*", "steps", F.col("subroot").alias("root"))
    root = above.select("root").first()
    proven = _leaves(_climbed(levels, above.select("tree", "subroot", "steps")))
    proof = F.struct("subroot", F.lit(root[0] if root else "").alias("root"), "steps").alias("proof")
    return proven.select(*[F.col("row")[c].alias(c) for c in kept], proof)


def document_leaf(text: Column) -> Column:
    """The leaf of a row of ``documents`` with *text* for its text."""
    return leaf_hash(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)


def op12_merkle_manifest(spark, sf_dir):
    text = F.col("text")
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, document_leaf(lowered)).alias("tampered")
    docs = documents(spark, sf_dir).select("doc_id", "lang", document_leaf(text).alias("leaf"), tampered)
    proven = manifest(docs, "leaf", "lang", ["doc_id"])
    steps = F.col("proof.steps")
    out = proven.select(
        "doc_id", "leaf", "proof.subroot", "proof.root", F.sha2(siblings(steps), 256).alias("proof_sha256"),
        fold(steps, F.coalesce("tampered", "leaf")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = (
    "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: "
    "list_reduce(list_prepend(xor(a, x), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
)
_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_NODES = """
  SELECT g, 0 AS l, i, n, h FROM {0}
  UNION ALL
  SELECT g, l + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {1} WHERE n > 1 GROUP BY g, l, i // 8
"""
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS g, sha256({_FIELDS} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 3 = 0
              THEN sha256({_FIELDS} || coalesce(strlen(text) || ':' || translate(text, '{_UPPER}', '{_UPPER.lower()}'), '-')) END AS tampered
  FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM d
), a AS ({_NODES.format("p", "a")}),
q AS (SELECT 't' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM a WHERE n = 1),
b AS ({_NODES.format("q", "b")}),
t AS (SELECT * FROM a UNION ALL SELECT * FROM b),
r AS (SELECT g, l, i // 8 AS up, string_agg(h, '' ORDER BY i) AS preimage FROM t WHERE n > 1 GROUP BY ALL),
c AS (
  SELECT doc_id, g, g AS own, 0 AS l, i, n, coalesce(tampered, leaf) AS h, '' AS proof FROM p
  UNION ALL
  SELECT c.doc_id, CASE WHEN c.n = 1 THEN 't' ELSE c.g END, c.own, CASE WHEN c.n = 1 THEN 0 ELSE c.l + 1 END,
         CASE WHEN c.n = 1 THEN q.i ELSE c.i // 8 END, CASE WHEN c.n = 1 THEN q.n ELSE (c.n + 7) // 8 END,
         CASE WHEN c.n = 1 THEN c.h ELSE sha256(substr(preimage, 1, 64 * (c.i % 8)) || c.h || substr(preimage, 64 * (c.i % 8) + 65)) END,
         CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || substr(preimage, 1, 64 * (c.i % 8)) || substr(preimage, 64 * (c.i % 8) + 65) END
  FROM c LEFT JOIN r ON r.g = c.g AND r.l = c.l AND r.up = c.i // 8 LEFT JOIN q ON q.lang = c.g
  WHERE c.n > 1 OR c.g <> 't'
), s AS (SELECT doc_id, own, h, proof FROM c WHERE g = 't' AND n = 1)
SELECT p.doc_id, p.leaf, q.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, s.h AS folded_root, s.h = root.h AS verified
FROM p JOIN s ON s.doc_id IS NOT DISTINCT FROM p.doc_id AND s.own = p.g JOIN q ON q.lang = p.g, (SELECT h FROM b WHERE n = 1) root
"""
