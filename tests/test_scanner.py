"""References in running text against a scan from left to right."""

import random
import re
import unicodedata

import pytest

from corpusgraph.operators import scanner

ALIASES = {
    "gen": "Gen", "genesis": "Gen", "john": "John", "1 john": "1John", "2 peter": "2Pet", "peter": "Pet", "song": "Song", "song of songs": "Song", "of songs": "Odes",
    "cântares de salomão": "Song", "salomão": "Sol", "3 ma": "3Macc", "ma": "Ma",
}


def fold(word):
    return re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)))


KEYS = {fold(name): book for name, book in ALIASES.items()}


def plain_scan(text, words=4):
    ts = re.findall(r"[^\W\d_]+|[0-9]+|\S", (text or "").lower())
    token = lambda i: ts[i] if 0 <= i < len(ts) else ""
    number = lambda i: bool(re.fullmatch("[0-9]{1,3}", token(i)))
    word = lambda i: token(i).isalpha()
    found, at = [], 0
    while at < len(ts):
        best = None
        for n in range(words, 0, -1):
            run = ts[at : at + n]
            if len(run) < n or not all(re.fullmatch(r"[^\W\d_]+|[0-9]+", x) for x in run) or not word(at + n - 1) or fold("".join(run)) not in KEYS:
                continue
            p = at + n if number(at + n) else at + n + 1 if token(at + n) == "." and number(at + n + 1) else None
            if p is not None:
                best = n, p
                break
        if best is None:
            at += 1
            continue
        n, p = best
        verse = end = None
        last = p
        if token(p + 1) in (":", ".") and number(p + 2):
            verse, last = int(token(p + 2)), p + 2
            if token(p + 3) in ("-", "–") and number(p + 4):
                end, last = int(token(p + 4)), p + 4
        found.append((at, KEYS[fold("".join(ts[at : at + n]))], int(token(p)), verse, verse if end is None else end))
        at = last + 1
    return found


TEXTS = [
    "See Gen 3:1-15 and Genesis. 4, then 1 John 2 Peter 3:1; Song of Songs 2:4–6.", "John 3", "1 John 3.16. 4 men", "Cântares de Salomão 4:14 and Salomão 5", "Gen Gen 1 2", "no 3:4",
    None, "", "3 Ma 2:1 ma. 5:6-7:8", "Gen 12345 and gen 1234:5", "song of songs song 1 of songs 2", "GEN 1:1GEN 2:2", "1 1 john 1 john 1", "peter 2 peter 2 peter 2:2",
]


def test_scan_against_plain_python(spark):
    rng = random.Random(2)
    bits = ["gen", "john", "1", "2", "3", "peter", "song", "of", "songs", ":", ".", "-", ",", "salomão", "cântares", "de", "ma", "word", "12"]
    texts = TEXTS + [" ".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(300)] + ["Gen 1:1 " * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(3)
    aliases = spark.createDataFrame(list(KEYS.items()), "key string, book string")
    found = sorted(((r.id, r.start, r.book, r.chapter, r.verse, r.end_verse) for r in scanner.scan(frame, "id", "body", aliases).collect()), key=repr)
    assert found == sorted(((i, *x) for i, text in enumerate(texts) for x in plain_scan(text)), key=repr)


@pytest.mark.parametrize("empty", ["texts", "aliases"])
def test_empty_tables(spark, empty):
    frame, aliases = spark.createDataFrame([(1, "Gen 1:1")], "id int, body string"), spark.createDataFrame([("gen", "Gen")], "key string, book string")
    found = scanner.scan(frame.limit(0 if empty == "texts" else 9), "id", "body", aliases.limit(0 if empty == "aliases" else 9))
    assert found.count() == 0
