"""Fill-in-middle: documents cut in three by their units and put together in another order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import SPACES, bind, documents

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


class EventScan:
    """Finds, in one pass of one automaton, the characters at which a text changes between white space and words, and the sentinels.

    A unit is a word with the white space before it, or the white space at the end.  Between two events lies a gap of
    no white space, and a gap of some length is one unit, so units are counted and looked up by rank in the gaps alone.
    """

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS) -> None:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for mark in sentinels:
            self._automaton.add_word(mark, -1)
        for space in SPACES:
            self._automaton.add_word(space, 1)
        self._automaton.make_automaton()

    def cut(self, text: str, first: int, second: int) -> tuple[int, int, int, bool]:
        """The number n of units, the places (in code points) after the smaller and the larger of *first* and *second*
        modulo n + 1 units, and whether a sentinel was found."""
        flat = np.fromiter((kind * (at + 1) for at, kind in self._automaton.iter(text)), np.int64)
        held = bool((flat < 0).any())
        spaces = flat[flat > 0] if held else flat
        spaces -= 1
        ends = spaces[np.diff(spaces, prepend=-1) > 1]
        open_end = len(text) > 0 and (not len(spaces) or spaces[-1] < len(text) - 1)
        closed = len(text) > 0 and not open_end  # the text ends in white space: a unit of its own
        n = len(ends) + open_end + closed

        def place(rank: int) -> int:
            return 0 if not rank else len(text) if rank > len(ends) else int(ends[rank - 1])

        low, high = sorted((first % (n + 1), second % (n + 1)))
        return n, place(low), place(high), held


def _cuts(sentinels: tuple[str, ...]):
    """An Arrow function of text and two random numbers, which sends only numbers back."""
    kinds = pa.struct([("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("held", pa.bool_())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scan = EventScan(sentinels)
        for texts, firsts, seconds in batches:
            rows = (scan.cut(t.as_py() or "", a.as_py(), b.as_py()) for t, a, b in zip(texts, firsts, seconds, strict=True))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], fields=list(kinds))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n long, low long, high long, held boolean")


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """*docs* with a struct ``fim``: ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` (code points) and ``output``.

    Draws depend on the seed and ``doc_id`` alone.  Of all documents *percent* in a hundred are cut after two random
    numbers of units into prefix, middle and suffix; *spm_percent* in a hundred of those have the form ``spm`` (suffix,
    prefix, middle), the others ``psm`` (prefix, suffix, middle).  The rest are ``plain``: their output is the text and they
    have no counts of characters.  A text that holds a sentinel is plain, and so is an empty one; a null text is an empty one, and a
    null id is one without digits.  A text of any length is scanned and cut whole; rows with the same id share their draws,
    rows that are alike their results.  Other columns pass through (an older ``fim`` is replaced); an empty table gives an empty one.

    Nothing is shuffled: workers get the text and send back four numbers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    first, second, third, fourth = _draws(F.col("doc_id"), seed)
    kept = [c for c in docs.columns if c != "fim"]
    rows = docs.select(F.struct(*kept).alias("_row"), text.alias("_text"), F.struct(third.alias("c"), fourth.alias("d")).alias("_h"), first.alias("_a"), second.alias("_b"))
    rows = rows.select("_row", "_text", "_h", _cuts(sentinels)("_text", "_a", "_b").alias("_cut"))
    low, high = F.col("_cut.low").cast("int"), F.col("_cut.high").cast("int")
    plain = (F.length("_text") == 0) | F.col("_cut.held") | (F.col("_h.c") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("_h.d") % 100 < spm_percent, "spm").otherwise("psm")

    def whole(form: Column) -> Column:
        p, s, m = map(F.lit, sentinels)
        prefix, middle, suffix = F.substring("_text", F.lit(1), low), F.substring("_text", low + 1, high - low), F.substring("_text", high + 1, F.length("_text"))
        ordered = F.when(form == "spm", F.concat(s, suffix, p, prefix)).otherwise(F.concat(p, prefix, s, suffix))
        return F.when(form == "plain", F.col("_text")).otherwise(F.concat(ordered, m, middle))

    chars = lambda n: F.when(~plain, n.cast("long"))
    made = bind(
        form,
        lambda x: F.struct(
            F.col("_cut.n").alias("n"), x.alias("form"), chars(low).alias("prefix_chars"), chars(high - low).alias("middle_chars"), whole(x).alias("output")
        ),
    )
    return rows.select(*[F.col("_row")[c].alias(c) for c in kept], made.alias("fim"))


def restore(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text from what :func:`transform` has made of it.

    The text has no sentinel, none can arise where a piece meets one, and so each is found at its only place.
    """
    p, s, m = sentinels
    middle = F.substring_index(output, m, -1)
    body = F.substring_index(output, m, 1)
    of_psm = F.concat(F.substring_index(F.substring_index(body, s, 1), p, -1), middle, F.substring_index(body, s, -1))
    of_spm = F.concat(F.substring_index(body, p, -1), middle, F.substring_index(F.substring_index(body, p, 1), s, -1))
    return F.when(form == "plain", output).when(form == "psm", of_psm).otherwise(of_spm)


def op13_fill_in_middle(spark, sf_dir):
    made = transform(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_HEX = "('0x' || substr(h, {}, 8))::BIGINT"
OP13_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents
), d AS (
  SELECT doc_id, text, u, len(u) AS n, {_HEX.format(1)} % (len(u) + 1) AS a, {_HEX.format(9)} % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_HEX.format(17)} % 100 >= 50
              THEN 'plain' WHEN {_HEX.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS prefix,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
