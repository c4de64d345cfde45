"""Document fingerprints of closed syncmers, with native expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.common import bind, documents

#: Code points of an inner substring, and inner substrings of a k-mer (a power of two).
INNER, WINDOW = 8, 16
#: Code points of a k-mer.
K = INNER + WINDOW - 1
#: An anchor is its position, and so many bits of its hash.
HASH_BITS = 20
#: Hexadecimal digits of an anchor in a fingerprint: one of its distance to the one before (below WINDOW), the others of its hash.
DIGITS = 6
#: Code points of a text that are looked at together.
_BLOCK = 4096
_LEAST = -(1 << 63)


def anchors(text: Column) -> Column:
    """The closed syncmers of a text: of each its position (from 0, shifted by HASH_BITS) and hash, in order.

    A k-mer is chosen if the smallest of its inner substrings, by their hashes, is its first or its last (or as small as those).  That
    depends on the k-mer alone, so what two texts have in common gives the same anchors wherever it stands; and of
    WINDOW - 1 k-mers in a row one is always chosen.  Null and short texts have none.

    Blocks overlap by K - 1; in each, the smallest of a quarter of WINDOW hashes from every place on is found by doubling, and four of them make a window.
    """
    low = F.lit((1 << HASH_BITS) - 1)

    def doubled(h: Column, by: int) -> Column:
        return bind(h, lambda x: F.zip_with(x, F.slice(x, by + 1, F.size(x)), lambda a, b: F.least(a, b)))

    def chosen(h: Column, offset: Column) -> Column:
        last, quarter = F.greatest(F.size(h) - WINDOW, F.lit(0)), WINDOW // 4

        def at_edge(least: Column) -> Column:
            """*least* has the smallest of a quarter of a window; few first or last hashes are that small, so the others are seldom asked."""

            def edge(i: Column) -> Column:
                first, final, of = F.get(h, i), F.get(h, i + (WINDOW - 1)), [F.get(least, i + k * quarter) for k in range(4)]
                at_first = (first == of[0]) & (first <= of[1]) & (first <= of[2]) & (first <= of[3])
                return at_first | ((final == of[3]) & (final <= of[2]) & (final <= of[1]) & (final <= of[0]))

            return F.filter(F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), edge)

        smallest = h
        for i in range(quarter.bit_length() - 1):
            smallest = doubled(smallest, 1 << i)
        bits = lambda i: F.xxhash64(F.get(h, i), F.get(h, i + INNER), F.get(h, i + (WINDOW - 1))).bitwiseAND(low)
        return F.transform(bind(smallest, at_edge), lambda i: F.shiftleft(offset + i, HASH_BITS) + bits(i))

    def of_block(blocks: Column):
        def run(block: Column, at: Column) -> Column:
            piece = F.concat(block, F.coalesce(F.substring(F.get(blocks, at + 1), 1, K - 1), F.lit("")))
            inner = F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{INNER}}}))."), F.lit(1))
            return bind(F.transform(inner, lambda x: F.xxhash64(x)), lambda h: chosen(h, at.cast("long") * _BLOCK))

        return run

    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return bind(blocks, lambda x: F.flatten(F.transform(x, of_block(x))))


def _or_whole(found: Column, text: Column) -> Column:
    """A text in which nothing is chosen is an anchor itself, unless it is empty."""
    whole = F.array(F.xxhash64(text).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    return F.when((F.size(found) == 0) & (F.length(text) > 0), whole).otherwise(found)


def encoded(found: Column) -> Column:
    """The fingerprint of a text's anchors: DIGITS hexadecimal digits of each, the distance to the one before and the hash."""
    base = F.lit(1 << HASH_BITS)

    def one(x: Column, i: Column) -> Column:
        before = F.coalesce(F.shiftright(F.get(found, i - 1), HASH_BITS), F.lit(0))
        return F.lpad(F.hex(x - before * base), DIGITS, "0")

    return F.lower(F.array_join(F.transform(found, one), ""))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text: its anchors with their distances.  Equal texts have equal ones; null and empty texts an empty one."""
    whole = F.coalesce(text, F.lit(""))
    return bind(anchors(whole), lambda x: bind(_or_whole(x, whole), encoded))


def links(mark: Column) -> Column:
    """What is matched of a fingerprint: of each anchor its hash with the distance to and the hash of the next one."""
    items = F.regexp_extract_all(mark, F.lit(f".{{{DIGITS}}}"), F.lit(0))
    return bind(items, lambda x: F.transform(x, lambda a, i: F.xxhash64(F.substring(a, 2, DIGITS - 1), F.coalesce(F.get(x, i + 1), F.lit("")))))


def _in_common(a: Column, b: Column) -> Column:
    """How many elements two lists have in common, repeats counted.

    Where one list has no repeats, the set does.  Else both are sorted together, one bit telling them apart, and runs are counted.
    """

    def step(s: Column, x: Column) -> Column:
        value, own = x.bitwiseAND(F.lit(-2)), x.bitwiseAND(F.lit(1)).cast("int")
        same = value == s["value"]
        return F.struct(
            value.alias("value"),
            F.when(same, s["a"]).otherwise(0).__add__(1 - own).alias("a"),
            F.when(same, s["b"]).otherwise(0).__add__(own).alias("b"),
            (s["n"] + F.when(same & (own == 1) & (s["b"] < s["a"]), 1).otherwise(0)).alias("n"),
        )

    tagged = F.concat(F.transform(a, lambda x: x.bitwiseAND(F.lit(-2))), F.transform(b, lambda x: x.bitwiseOR(F.lit(1))))
    start = F.struct(F.lit(0).cast("long").alias("value"), *[F.lit(0).alias(c) for c in ("a", "b", "n")])
    counted = F.aggregate(F.sort_array(tagged), start, step, lambda s: s["n"])
    distinct = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    return F.when(distinct(a) | distinct(b), F.size(F.array_intersect(a, b))).otherwise(counted)


def linked(a: Column, b: Column) -> Column:
    """The likeness of two lists of :func:`links`: twice those in common by those of both; two empty ones are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * _in_common(a, b) / total)


def likeness(a: Column, b: Column) -> Column:
    """How much two fingerprints have in common, from 0 to 1: anchors that are followed by the same anchor at the same distance."""
    return bind(links(a), lambda x: bind(links(b), lambda y: linked(x, y)))


def anchor_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """*key*, ``position`` and ``hash`` of every anchor, for joins that look for passages in common."""
    found = docs.select(key, F.explode(anchors(F.col("text"))).alias("_a"))
    return found.select(key, F.shiftright("_a", HASH_BITS).alias("position"), F.col("_a").bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("hash"))


def _range_of(key: Column, starts: list[int]) -> Column:
    """The place of the last of the sorted *starts* that is not above *key*, by blocks of them."""
    step = max(1, math.isqrt(len(starts)))
    upto = lambda values: F.size(F.filter(values, lambda x: x <= key))
    block = upto(F.lit(starts[::step])) - 1
    return bind(block, lambda b: b * step + upto(F.slice(F.lit(starts), b * step + 1, F.lit(step))) - 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``n_chars`` of each document, its ``fingerprint``, its edited text and that one's
    (``edited``, ``edited_fingerprint``), and how like its fingerprint is to it (``near_edited``) and to the next document's (``near_next``).

    The edited text has as its last quarter (rounded down) the first code points of the next document, as many or all.
    The next one is that by ``doc_id``, and after the last the first; rows without an id come first, rows of one id by a
    hash of their texts.  Null texts are empty ones, texts of any length are read whole, a table of one row follows itself, other
    columns are not read, and an empty table gives no row.

    Texts are shuffled once: ranges of ids are dealt out (eight a shuffle partition at most, whose first ids are collected),
    and the first row of each range goes to the range before too.  The edited text has the anchors of what it shares with the text and of what
    it shares with the next one; only those across the place where they meet are looked for.
    """
    spark = docs.sparkSession
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), F.coalesce(F.col("text"), F.lit(""))
    n = docs.count()
    ranges = min(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 64 + 1)
    cuts = F.percentile_approx(key, [i / ranges for i in range(ranges)], 4 * ranges + 100)
    about = sorted({_LEAST, *map(int, docs.agg(cuts).first()[0] or [])})  # rounded where ids are large
    firsts = docs.select(key.alias("_key")).groupBy(_range_of(F.col("_key"), about)).agg(F.min("_key").alias("_key"))
    starts = sorted(r["_key"] for r in firsts.collect()) or [_LEAST]

    rows = docs.select("doc_id", key.alias("_key"), text.alias("_text")).withColumn("_range", _range_of(F.col("_key"), starts))
    place = lambda at, copy: F.struct(at.alias("_range"), F.lit(copy).alias("_copy"))
    own, before = place(F.col("_range"), False), place(F.pmod(F.col("_range") - 1, F.lit(len(starts))), True)
    first = F.get(F.lit(starts), F.col("_range")) == F.col("_key")
    places = F.when(first, F.array(own, before)).otherwise(F.array(own))
    rows = rows.select("doc_id", "_key", "_text", F.xxhash64("_text").alias("_hash"), F.inline(places))
    order = Window.partitionBy("_range").orderBy("_copy", "_key", "_hash")
    rows = rows.withColumn("_next", F.lead("_text").over(order))

    size = F.length("_text")
    kept = size - F.floor(size / 4).cast("int")
    start = F.greatest(kept - (K - 1), F.lit(0))
    put = F.coalesce(F.substring("_next", F.lit(1), size - kept), F.lit(""))
    placed = ("doc_id", "_range", "_copy", "_key", "_hash")
    edited = F.concat(F.substring("_text", F.lit(1), kept), put).alias("edited")
    cut = rows.select(*placed, F.length("_text").cast("long").alias("n_chars"), "_text", kept.alias("_kept"), start.alias("_start"), edited, anchors(F.col("_text")).alias("_anchors"))
    moved = lambda found, by: F.transform(found, lambda x: x + F.shiftleft(by.cast("long"), HASH_BITS))
    upto = lambda found, last: F.filter(found, lambda x: F.shiftright(x, HASH_BITS) <= last)
    around = F.substring("edited", F.col("_start") + 1, F.col("_kept") - F.col("_start") + (K - 1))
    first = F.concat(upto(F.col("_anchors"), F.col("_kept") - K), moved(anchors(around), F.col("_start")))
    fingerprint = bind(_or_whole(F.col("_anchors"), F.col("_text")), encoded).alias("fingerprint")
    # The length of a text is counted, so it must not stand in what is done for each anchor.
    until = (F.length("edited") - F.col("_kept") - K).alias("_until")
    marked = cut.select(*placed, "n_chars", "edited", "_kept", until, "_anchors", first.alias("_first"), fingerprint)
    marked = marked.withColumn("_links", links(F.col("fingerprint")))
    met = marked.withColumns({"_after": F.lead("_links").over(order), "_following": F.lead("_anchors").over(order)}).where(~F.col("_copy"))
    last = moved(upto(F.col("_following"), F.col("_until")), F.col("_kept"))
    both = bind(F.concat("_first", last), lambda x: bind(_or_whole(x, F.col("edited")), encoded))
    near = met.withColumn("edited_fingerprint", both).withColumn("_edited", links(F.col("edited_fingerprint")))
    return near.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        linked(F.col("_links"), F.col("_edited")).alias("near_edited"), linked(F.col("_links"), F.col("_after")).alias("near_next"),
    )


def op11_fingerprints(spark, sf_dir):
    found = fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
