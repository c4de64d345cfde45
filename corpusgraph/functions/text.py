"""Text functions from Column to Column: folding, tokens, matching, excerpts, keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the letters they are folded to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

_LETTERS = "a-zA-ZÀ-ÿ"


def fold(text: Column | str) -> Column:
    """Lower case without accents (a pinned table, so that other engines give the same)."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def ascii_key(text: Column | str) -> Column:
    """A key for names: folded, and only a-z and 0-9 of it."""
    return F.regexp_replace(fold(text), "[^a-z0-9]", "")


def slug(text: Column | str) -> Column:
    """Folded words joined by hyphens."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), F.lit("-"))


def one_spaced(text: Column | str) -> Column:
    """Lower case, with runs of white space as one space and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with *value* computed once a row, where Catalyst would copy a long expression to every place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def content_tokens(text: Column | str, stop: tuple[str, ...], longer_than: int = 2) -> Column:
    """Tokens that are no stop words and have more than so many characters, in order, with repeats."""
    stops = F.array(*map(F.lit, stop))
    return F.filter(tokens(text), lambda x: (F.length(x) > longer_than) & ~F.array_contains(stops, x))


def ngrams(toks: Column, n: int) -> Column:
    """Runs of *n* tokens joined by underscores; none if there are fewer."""
    return F.when(
        F.size(toks) >= n,
        F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, n), "_")),
    ).otherwise(F.array().cast("array<string>"))


def whole_words(text: Column | str, words: str | list[str]) -> Column:
    """Every word stands in the text between other characters than letters, in any case."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.lit(True)
    for word in words.split() if isinstance(words, str) else words:
        found &= text.rlike(f"(?iu)(^|[^{_LETTERS}]){re.escape(word)}([^{_LETTERS}]|$)")
    return found


def contains(text: Column | str, term: str) -> Column:
    """*term* as it is written, in any case: nothing in it is a pattern."""
    return F.contains(F.lower(text), F.lit(term.lower()))


def starts(text: Column | str, term: str) -> Column:
    return F.startswith(F.lower(text), F.lit(term.lower()))


def ends(text: Column | str, term: str) -> Column:
    return F.endswith(F.lower(text), F.lit(term.lower()))


def same(a: Column | str, b: Column | str) -> Column:
    """Equal in any case."""
    return F.lower(a) == F.lower(b)


def matches_any(term: str, *columns: str) -> Column:
    """Some column contains the term."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(contains(c, term), F.lit(False))
    return found


def preview(text: Column | str, n: int) -> Column:
    """The first *n* characters, and dots if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(
        F.col(text) if isinstance(text, str) else text
    )


def snippet(text: Column | str, term: str, around: int = 75, short: int = 150) -> Column:
    """The surroundings of the first hit, with dots where they are cut; short texts as they are."""
    text = F.col(text) if isinstance(text, str) else text
    hit = F.instr(F.lower(text), term.lower()) - 1
    start = F.greatest(F.lit(0), hit - around)
    end = F.least(F.length(text), hit + len(term) + around)
    cut = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(text, start + 1, end - start),
        F.when(end < F.length(text), "...").otherwise(""),
    )
    return F.when((F.length(text) <= short) | (hit < 0), preview(text, short)).otherwise(cut)


def last_part(code: Column | str, mark: str = "_") -> Column:
    return F.element_at(F.split(code, mark), -1)


def jaccard(a: Column, b: Column) -> Column:
    """The share of common elements of two sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def bucket(value: Column | str, floors: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first floor, from the highest on, that the value reaches."""
    value = F.col(value) if isinstance(value, str) else value
    chain = None
    for floor, label in sorted(floors, reverse=True):
        chain = F.when(value >= floor, label) if chain is None else chain.when(value >= floor, label)
    return chain.otherwise(rest)


def lookup(value: Column | str, table: dict, default=None) -> Column:
    """The value that a small table has for a key."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), F.col(value) if isinstance(value, str) else value)
    return found if default is None else F.coalesce(found, F.lit(default))


def truthy(value: Column | str) -> Column:
    return F.lower(value).isin("1", "true", "yes")


def century(year: Column | str) -> Column:
    """Roman numeral of a year's century, marked where the year is before the common era."""
    year = F.col(year) if isinstance(year, str) else year
    numerals = F.array(*map(F.lit, "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI".split()))
    n = F.floor((F.abs(year) - 1) / 100).cast("int") + 1
    return F.concat(F.get(numerals, n - 1), F.when(year < 0, F.lit(" a.C.")).otherwise(F.lit("")))
