"""Quality rules: base rules of fixed thresholds, and a decision list learned from labels.

Everything here is DataFrame expressions; what reaches the driver while learning are counts by
feature and bin, of which there are a fixed number however large the corpus is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import bind, cut, documents, labels, words

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may ask about: the statistics as rates, so that a rule holds for texts of any length.
FEATURES = ("words", "symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "upper_rate", "digit_rate", "mark_rate", "words_per_line")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = F.size(w)
    at = F.sequence(F.lit(1), n - 2)
    hashes = F.transform(at, lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(places: Column) -> Column:
        """The sum of what each window, in order, covers before the next one starts."""
        gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def repeated(ordered: Column) -> Column:
        same = F.transform(
            ordered,
            lambda x, k: F.when(
                ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | (F.get(ordered, k + 1)["h"] == x["h"]), x["i"]
            ),
        )
        return bind(F.array_sort(F.array_compact(same)), covered)

    def places(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(F.array_sort(pairs), repeated))

    return F.when(n < 4, F.lit(0)).otherwise(bind(hashes, places))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def statistics(text: Column) -> Column:
    """A struct of STATISTICS and of the counts that FEATURES need besides (longs); of a null text all are 0."""

    def of(t: Column) -> Column:
        def lined(ls: Column) -> Column:
            return F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"))

        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)

        def worded(w: Column) -> Column:
            return F.struct(
                F.size(w).alias("n_words"),
                F.length(F.array_join(w, "")).alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
            )

        return F.struct(
            bind(words(t), worded).alias("w"),
            bind(lines, lined).alias("l"),
            _count(t, r"[#*$%&|<>]").alias("n_symbols"),
            _count(t, r"\p{Lu}").alias("n_upper"),
            _count(t, r"[0-9]").alias("n_digits"),
            _count(t, r"""[!?"'()\[\]{}+=~^_/\\@:;-]""").alias("n_marks"),
        )

    def flat(s: Column) -> Column:
        named = {x: s["w"][x] for x in ("n_words", "word_chars", "n_repeat_words")}
        named |= {x: s["l"][x] for x in ("n_lines", "n_dup_lines")}
        named |= {x: s[x] for x in ("n_symbols", "n_upper", "n_digits", "n_marks")}
        return F.struct(*[c.cast("long").alias(x) for x, c in named.items()])

    return bind(F.coalesce(text, F.lit("")), lambda t: bind(of(t), flat))


def features(s: Column) -> list[Column]:
    """FEATURES of a struct of :func:`statistics`, as doubles."""

    def rate(a: str, b: str) -> Column:
        return F.coalesce(s[a].cast("double") / F.nullif(s[b], F.lit(0)), F.lit(0.0))

    of = {
        "words": s["n_words"].cast("double"),
        "symbol_rate": rate("n_symbols", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "word_length": rate("word_chars", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
        "digit_rate": rate("n_digits", "word_chars"),
        "mark_rate": rate("n_marks", "word_chars"),
        "words_per_line": rate("n_words", "n_lines"),
    }
    return [of[x].alias(x) for x in FEATURES]


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass
class Rule:
    """Rejects what meets all conditions (feature, ">=" or "<", threshold)."""

    conditions: list[tuple[str, str, float]]
    caught: int = 0
    wrong: int = 0

    def column(self, by_name) -> Column:
        test = F.lit(True)
        for name, sign, at in self.conditions:
            test &= (by_name(name) >= at) if sign == ">=" else (by_name(name) < at)
        return test

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {t:.6g}" for n, s, t in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def column(self, by_name=F.col) -> Column:
        """The number of the first rule that a row meets, as one conditional expression; null if none."""
        chain = None
        for i, rule in enumerate(self.rules, 1):
            test = rule.column(by_name)
            chain = F.when(test, F.lit(i)) if chain is None else chain.when(test, F.lit(i))
        return F.lit(None).cast("int") if chain is None else chain


def learn(
    rows: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 4,
    n_bins: int = 48,
    min_caught: int = 2,
    min_precision: float = 0.9,
) -> DecisionList:
    """Sequential covering of the rows with ``quality`` 0 by rules over FEATURES.

    *rows* has ``doc_id``, ``quality`` and FEATURES.  A third of the rows, by a hash of the id, is
    kept for pruning.  A rule grows by the condition of the largest information gain over the rows
    not yet covered (thresholds are quantiles of each class), until it catches no wrong row or none
    of its conditions gains.  It is pruned to the prefix of conditions whose share of right minus
    wrong rows is largest on the rows kept for that, and joins the list if it is right there for at
    least *min_precision* of *min_caught* rows or more; the first that isn't ends the list.  Each
    step is one aggregate over all rows, of which counts by feature and bin come to the driver.
    Rows of other labels (null too) are left out; without rows of both classes the list is empty.
    """
    rows = rows.where(F.col("quality").isin(0, 1)).select(
        (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"), *FEATURES
    )
    quantiles = [i / n_bins for i in range(n_bins + 1)]
    at = rows.groupBy("bad").agg(*[F.percentile_approx(x, quantiles, 2000).alias(x) for x in FEATURES]).collect()
    if len(at) < 2:
        return DecisionList()
    edges = {x: sorted({v for r in at for v in r[x] if v is not None}) for x in FEATURES}
    def bin_of(x: str) -> Column:
        """The number of edges that are at most the value."""
        return F.size(F.filter(F.array(*map(F.lit, edges[x])), lambda e: e <= F.col(x))).alias(x)

    bins = [bin_of(x) for x in FEATURES]
    binned = cut(rows.select("bad", "pruning", *bins).groupBy("bad", "pruning", *FEATURES).agg(F.count("*").alias("n")))

    def test(conditions: list[tuple[str, str, int]]) -> Column:
        out = F.lit(True)
        for name, sign, k in conditions:
            out &= (F.col(name) >= k) if sign == ">=" else (F.col(name) < k)
        return out

    def real(c: tuple[str, str, int]) -> tuple[str, str, float]:
        return c[0], c[1], edges[c[0]][c[2] - 1]

    left, found = ~F.col("pruning"), DecisionList()
    uncovered = F.lit(True)
    for _ in range(max_rules):
        conditions: list[tuple[str, str, int]] = []
        while len(conditions) < max_conditions:
            best = _best(binned.where(left & uncovered & test(conditions)), edges, min_caught)
            if best is None:
                break
            conditions.append(best[0])
            if best[1] == 0:
                break
        if not conditions:
            break
        prefixes = [conditions[: i + 1] for i in range(len(conditions))]
        held = binned.where(F.col("pruning") & uncovered).agg(
            *[F.sum(F.when(test(p) & (F.col("bad") == bad), F.col("n")).otherwise(0)).alias(f"{i}{bad}") for i, p in enumerate(prefixes) for bad in (True, False)]
        )
        counts = held.first()
        scored = [(counts[f"{i}True"] or 0, counts[f"{i}False"] or 0) for i in range(len(prefixes))]
        i = max(range(len(prefixes)), key=lambda i: ((scored[i][0] - scored[i][1]) / max(1, sum(scored[i])), scored[i][0]))
        caught, wrong = scored[i]
        if caught < min_caught or caught < min_precision * (caught + wrong):
            break
        found.rules.append(Rule([real(c) for c in prefixes[i]], caught, wrong))
        uncovered &= ~test(prefixes[i])
    return found


def _best(binned: DataFrame, edges: dict[str, list[float]], min_caught: int):
    """The condition that gains most, and how many wrong rows are left with it."""
    stacked = F.explode(F.array(*[F.struct(F.lit(x).alias("f"), F.col(x).alias("k")) for x in FEATURES])).alias("c")
    sums = binned.select("bad", "n", stacked).groupBy("c.f", "c.k", "bad").agg(F.sum("n").alias("n")).collect()
    by = {x: ([0] * (len(edges[x]) + 1), [0] * (len(edges[x]) + 1)) for x in FEATURES}
    for r in sums:
        by[r["f"]][0 if r["bad"] else 1][r["k"]] += r["n"]
    p0, n0 = sum(by[FEATURES[0]][0]), sum(by[FEATURES[0]][1])
    if not n0 or p0 < min_caught:
        return None
    # Half a row more keeps a rule of few, all right rows from looking certain.
    before, best = math.log2(p0 / (p0 + n0)), None
    for x in FEATURES:
        bad, good = by[x]
        for k in range(1, len(bad)):
            below = sum(bad[:k]), sum(good[:k])
            for sign, (p, n) in (("<", below), (">=", (p0 - below[0], n0 - below[1]))):
                if p < min_caught or n == n0:
                    continue
                gain = p * (math.log2(p / (p + n + 0.5)) - before)
                if gain > 0 and (best is None or gain > best[2]):
                    best = ((x, sign, k), n, gain)
    return best and best[:2]


def fit(docs: DataFrame, labelled: DataFrame) -> DecisionList:
    """A decision list from the labelled documents among *docs* (all of them).

    A document with several labels counts once for each.  Labels are joined first, so only the labelled texts are measured.
    """
    with_labels = docs.select("doc_id", "text").join(labelled.select("doc_id", "quality"), "doc_id")
    measured = with_labels.select("doc_id", "quality", statistics(F.col("text")).alias("s"))
    return learn(cut(measured.select("doc_id", "quality", *features(F.col("s")))))


def judge(measured: DataFrame, rules: DecisionList) -> DataFrame:
    """Rows with a struct ``s`` of :func:`statistics`, with ``base_failed``, ``rule`` and ``kept``."""
    named = dict(zip(FEATURES, features(F.col("s")), strict=True))
    first = rules.column(lambda x: named[x])
    return measured.withColumns({"base_failed": base_failed(F.col("s")), "rule": first}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def filter_quality(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of *docs* that neither the base rules nor the list learned from *labelled* reject.

    A null or empty text has no words and is rejected.  Rows stay as they are, with all columns
    whatever their names are; repeated rows are judged alike.  An empty table gives an empty table;
    without labels only the base rules judge.  Texts of any length are measured whole, once and where they lie, and stored with
    what was measured; only that is joined with the labels.
    """
    rows = cut(docs.select(F.struct("*").alias("row"), statistics(F.col("text")).alias("s")))
    measured = rows.select(F.col("row.doc_id").alias("doc_id"), *features(F.col("s")))
    rules = learn(cut(measured.join(labelled.select("doc_id", "quality"), "doc_id")))
    kept = judge(rows, rules).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op1_quality_rules(spark, sf_dir):
    measured = cut(documents(spark, sf_dir).select("doc_id", statistics(F.col("text")).alias("s")))
    with_labels = measured.join(labels(spark, sf_dir).select("doc_id", "quality"), "doc_id")
    rules = learn(with_labels.select("doc_id", "quality", *features(F.col("s"))))
    return judge(measured, rules).select("doc_id", *[f"s.{x}" for x in STATISTICS], "base_failed", "rule", "kept")
