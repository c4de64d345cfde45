import random

import pytest

WORDS = [a + b for a in ("ba", "co", "du", "fe", "gi", "lo", "mu", "ne", "pi", "ra") for b in ("ka", "le", "mi", "no", "su", "ta", "ve", "zo", "ry", "sh")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, id long, rule string, key long, lost string"


def prose(rng, n, line=14):
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) + "." for i in range(0, n, line))


@pytest.fixture(scope="session")
def texts():
    """Texts of every awkward kind, by doc_id (some ids twice, one missing)."""
    rng = random.Random(7)
    base = prose(rng, 300)
    shared = prose(rng, 90, line=200)
    words = base.split(" ")
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 4 else "other" for i, w in enumerate(words))
    rows = [
        (1, base), (2, base), (3, near), (4, far), (5, None), (6, ""), (7, " \t\n\x0b "), (8, "one"), (9, "One"), (10, "a b c d"),
        (11, prose(rng, 120) + " " + shared + " " + prose(rng, 100)), (12, prose(rng, 60) + "\n" + shared), (13, shared + prose(rng, 30)),
        (14, "ab " * 900), (15, "ß Ünï çödé 日本語 текст " * 40), (16, prose(rng, 9000)), (2, base), (None, base), (17, "\n\n\n"), (18, "x" * 3000),
        (19, "!!! ### $$$ " * 200), (20, "A" * 45 + "\n" + "b c"), (21, "  " + "a" * 45 + "\nq"), (22, "  nbsp em"), (23, "nul\0 byte"),
    ]
    license_line = "This line stands in many of the documents, word for word."
    rows += [(100 + i, prose(rng, 80) + "\n" + license_line + ("  " if i % 2 else "") + "\n" + prose(rng, 20)) for i in range(8)]
    rows += [(200 + i, prose(rng, 60 + i)) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with more columns than it should have, some with names that operators use inside."""
    langs, sources = ["en", "fr", None, "de"], ["s1", "s2", "s1", None, "s1", "Ä"]
    rows = [
        (i, t, langs[k % 4], sources[k % 6], None if t is None else len(t), k, 3, 4, "r", 5, "l") for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
