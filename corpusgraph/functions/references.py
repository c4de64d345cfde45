"""References to passages as text: parsing, normalising, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Book, chapter, verse, and either an end verse or an end chapter and verse.
PATTERN = r"^\s*((?:[1-3]\s*)?\p{L}[\p{L}. ]*?)\s*(\d+)(?::(\d+)(?:\s*-\s*(?:(\d+):)?(\d+))?|\s*-\s*(\d+))?\s*$"


def segments(text: Column | str) -> Column:
    """The non-empty parts between semicolons."""
    parts = F.transform(F.split(text, "[;；]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def parse(segment: Column | str) -> Column:
    """A struct of book, chapter, verse, end_chapter, end_verse and ok; numbers that aren't there are null.

    ``Book 3-5`` is a range of chapters.
    """

    def number(group: int) -> Column:
        return F.nullif(F.regexp_extract(segment, PATTERN, group), F.lit("")).try_cast("int")

    book = F.nullif(F.trim(F.regexp_extract(segment, PATTERN, 1)), F.lit(""))
    return F.struct(
        book.alias("book"),
        number(2).alias("chapter"),
        number(3).alias("verse"),
        F.coalesce(number(4), number(6), number(2)).alias("end_chapter"),
        F.coalesce(number(5), number(3)).alias("end_verse"),
        book.isNotNull().alias("ok"),
    )


def parse_dotted(reference: Column | str) -> Column:
    """``BOOK.c.v[-v]`` as a struct; null numbers where they aren't."""
    parts = F.split(reference, r"\.")
    verses = F.split(F.get(parts, F.lit(2)), "-")
    number = lambda x: F.nullif(x, F.lit("")).try_cast("int")
    return F.struct(
        F.get(parts, F.lit(0)).alias("book"),
        number(F.get(parts, F.lit(1))).alias("chapter"),
        number(F.get(verses, F.lit(0))).alias("verse"),
        F.coalesce(number(F.get(verses, F.lit(1))), number(F.get(verses, F.lit(0)))).alias("end_verse"),
    )


def chapter_and_verse(code: Column | str) -> Column:
    """The numbers of names such as ``rom_12_01.json`` or ``LK 1:1``: book, chapter, verse."""
    pattern = r"([1-3]?[A-Za-z]+)[ _](\d+)[:_](\d+)"
    return F.struct(
        F.lower(F.regexp_extract(code, pattern, 1)).alias("book"),
        F.nullif(F.regexp_extract(code, pattern, 2), F.lit("")).try_cast("int").alias("chapter"),
        F.nullif(F.regexp_extract(code, pattern, 3), F.lit("")).try_cast("int").alias("verse"),
    )


def accepted_languages(header: Column | str) -> Column:
    """Codes of an Accept-Language header, the most wanted first; equal ones in their order."""
    items = F.filter(F.transform(F.split(header, ","), lambda x: F.trim(x)), lambda x: x != "")

    def weighed(item: Column, i: Column) -> Column:
        parts = F.split(item, ";")
        q = F.nullif(F.regexp_extract(item, r";\s*q=([0-9.]+)", 1), F.lit("")).try_cast("double")
        return F.struct((-F.coalesce(q, F.lit(1.0))).alias("q"), i.alias("i"), F.lower(F.trim(parts[0])).alias("code"))

    return F.transform(F.array_sort(F.transform(items, weighed)), lambda x: x["code"])
