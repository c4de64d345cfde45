"""Forms of words, mined from texts."""

import collections
import re

from corpusgraph.operators import expansion, morphology

TEXTS = [
    (1, "she loves cats and he loved cats", "en"), (2, "they love cats; loving is fine", "en"), (3, "a house by houses", "en"), (4, "o amor da casa", "pt"), (5, "amores da casas", "pt-BR"),
    (6, None, "en"), (7, "", None), (8, "love", "en"), (9, "he loves dogs and she loved dogs and he love dogs", None), (10, "amor da terra, amores da terra", "portuguese"),
]
STEMS = {"loves": "love", "loved": "love", "loving": "love", "love": "love", "house": "hous", "houses": "hous", "cats": "cat", "dogs": "dog", "amor": "amor", "amores": "amor", "casa": "cas", "casas": "cas"}


def plain(most):
    near = collections.defaultdict(set)
    for _, text, lang in TEXTS:
        config = "pt" if (lang or "").startswith(("pt", "portuguese")) else "en"
        ts = re.findall(r"\w+", (text or "").lower())
        for a, b in zip(ts, ts[1:], strict=False):
            near[config, a].add(("after", b))
            near[config, b].add(("before", a))
    out = set()
    for config, word in near:
        others = [(-len(near[config, word] & near[c, w]), w) for c, w in near if c == config and w != word and STEMS.get(w, w) == STEMS.get(word, word)]
        out |= {(config, word, w, -n) for n, w in sorted(others)[:most] if n}
    return out


def test_variants_against_plain_python(spark):
    docs = spark.createDataFrame(TEXTS, "id int, body string, lang string")
    for most in (1, 3):
        found = {(r.config, r.token, r.variant, r.shared) for r in morphology.variants(docs, "body", "lang", most).collect()}
        assert found == plain(most)
    assert ("en", "loves", "loved", 5) in found or ("en", "loved", "loves", 5) in found or len(found) > 6
    assert morphology.variants(docs.limit(0), "body", "lang").count() == 0


def test_pairs_of_a_long_text_are_not_compared_with_each_other(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i % 700}" for i in range(3000)), "en")], "body string, lang string")
    near = morphology.contexts(docs, "body", "lang")
    # Spark tells structs of an array apart by comparing each with all.
    assert "array_distinct" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert near.count() == 1400


def test_variants_expand_queries(spark):
    docs = spark.createDataFrame(TEXTS, "id int, body string, lang string")
    table = morphology.synonyms(morphology.variants(docs, "body", "lang"))
    terms = spark.createDataFrame([("amor",), ("cats",)], "term string")
    assert {r.term: r.more for r in expansion.expand(terms, "term", table, 3).collect()} == {"amor": "amores", "cats": ""}
