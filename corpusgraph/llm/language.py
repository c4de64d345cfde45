"""Language identification: scripts narrow the candidates, Viterbi labels spans of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import documents, even_sample, held_out
from corpusgraph.llm.rolling import mix

_WORD = re.compile(r"[^\W\d_]+")

#: Ranges of letters by script (fixed values); anything else is "Other".
_SCRIPTS = (
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
)
#: In a word of a script that a language's texts hardly ever use, this is the language's score.
_FOREIGN = -12.0
_LOW = np.array([low for low, _, _ in _SCRIPTS])
_HIGH = np.array([high for _, high, _ in _SCRIPTS])
_NAMES = sorted({name for _, _, name in _SCRIPTS} | {"Other"})
_SCRIPT_OF = np.array([_NAMES.index(name) for _, _, name in _SCRIPTS])


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(found: list[str], words_bits: int, grams_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words: the row of each in a table of 2**words_bits; the rows of their runs of three letters (with a mark at
    either end) in one of 2**grams_bits, word after word; how many runs each has; and the script of its first letter."""
    letters = np.frombuffer(("<" + "><".join(found) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    # A word of n letters has n runs, which start at its opening mark and all its letters but the last.
    first = np.cumsum(sizes) - sizes
    at = np.repeat(starts - first, sizes) + np.arange(sizes.sum())
    runs = mix(letters[at] | letters[at + 1] << np.uint64(21) | letters[at + 2] << np.uint64(42))
    places = (np.arange(len(at)) - np.repeat(first, sizes)).astype(np.uint64)
    whole = mix(np.add.reduceat(mix(letters[at + 1] | places << np.uint64(21)), first))
    initial = letters[starts + 1].astype(np.int64)
    k = np.searchsorted(_LOW, initial, "right") - 1
    script = np.where((k >= 0) & (initial <= _HIGH[k]), _SCRIPT_OF[k], _NAMES.index("Other"))
    return (whole & np.uint64((1 << words_bits) - 1)).astype(np.int64), (runs & np.uint64((1 << grams_bits) - 1)).astype(np.int64), sizes, script


@dataclass
class LanguageModel:
    """Log-odds by language of the rows of two hashed tables, of words and of letter runs, and the languages of each script."""

    languages: list[str]
    words: np.ndarray
    grams: np.ndarray
    scripts: np.ndarray
    switch: float = 6.0

    def score(self, found: list[str]) -> np.ndarray:
        """A score a language for each word: its own log-odds and the mean of its letter runs'."""
        word, gram, sizes, script = features(found, len(self.words).bit_length() - 1, len(self.grams).bit_length() - 1)
        means = np.add.reduceat(self.grams[gram], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return np.where(self.scripts[script], self.words[word] + means, _FOREIGN)


def learn(docs: DataFrame, max_docs: int = 8_000, words_bits: int = 17, grams_bits: int = 15) -> LanguageModel:
    """A model from the ``text`` and ``lang`` of *docs*, of which rows with a null in either are left out.

    It learns from about *max_docs* documents, an even sample by a hash of the id.  Every word and letter
    run of them counts; what reaches the driver are counts by language of the rows of tables of 2**words_bits and 2**grams_bits
    rows, and of scripts.  An empty table gives a model without languages.
    """
    known = docs.where(F.col("lang").isNotNull())
    sample = even_sample(known, "doc_id", max_docs).where(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(words(text))
            for lang, counts in by_lang.items():
                if not counts:
                    continue
                n = np.fromiter(counts.values(), np.int64, len(counts))
                word, gram, sizes, script = features(list(counts), words_bits, grams_bits)
                for kind, rows, times in (("w", word, n), ("g", gram, np.repeat(n, sizes)), ("s", script, n)):
                    row, group = np.unique(rows, return_inverse=True)
                    total = np.bincount(group, times).astype(np.int64)
                    same = [pa.array([x] * len(row), pa.string()) for x in (kind, lang)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(row), pa.array(total)], ["kind", "lang", "row", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "kind string, lang string, row long, n long")
    rows = counts.groupBy("kind", "lang", "row").agg(F.sum("n").alias("n")).toArrow()
    kinds, langs, at, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    languages = sorted(set(langs.tolist()))
    index = np.searchsorted(np.array(languages, object), langs) if len(langs) else np.empty(0, np.int64)

    def table(kind: str, size: int) -> np.ndarray:
        own = kinds == kind
        out = np.zeros((size, len(languages)))
        np.add.at(out, (at[own].astype(np.int64), index[own]), n[own].astype(float))
        return out

    def odds(seen: np.ndarray) -> np.ndarray:
        """Log of each language's rate over the mean rate, which is 0 where a row tells nothing."""
        rate = (seen + 0.5) / (seen.sum(axis=0) + 1)
        return np.log(rate / rate.mean(axis=1, keepdims=True)).astype(np.float32) if languages else seen.astype(np.float32)

    seen = table("s", len(_NAMES))
    # A language has a script if a thousandth of its words are in it; a script that none has leaves them all.
    allowed = seen >= np.maximum(0.001 * seen.sum(axis=0), 1e-9)
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(languages, odds(table("w", 1 << words_bits)), odds(table("g", 1 << grams_bits)), allowed)


#: Words of a text that are labelled in a row; a longer text is labelled in parts side by side.
_STEPS = 1024


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best language of each word of each text, where a change of language costs *switch*.

    Texts run side by side, word by word.  A long one is cut into parts, of which all but the first run once
    for each language that the word before may have; then the best way through the parts is chosen.
    """
    if not scores:
        return []
    k = scores[0].shape[1]
    flat = np.concatenate(scores)
    first, size, before, text = [], [], [], []  # of each chain: where it starts, its words, the language before (-1: any), its text
    at = 0
    for i, s in enumerate(scores):
        for a in range(0, max(1, len(s)), _STEPS):
            for j in range(k) if a else (-1,):
                first.append(at + a)
                size.append(min(_STEPS, len(s) - a))
                before.append(j)
                text.append(i)
        at += len(s)
    by = np.argsort(-np.array(size), kind="stable")
    first, size, before = (np.array(x)[by] for x in (first, size, before))
    now = np.where(before[:, None] < 0, 0.0, np.where(before[:, None] == np.arange(k), 0.0, -switch))
    held = np.cumsum(size) - size
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # chains of more than t words
    best = np.zeros(int(size.sum()), np.int16)
    jumped = np.zeros((len(best), k), bool)
    for t in range(size[0]):
        m = active[t]
        if t:
            top = now[:m].argmax(axis=1)
            jump = now[np.arange(m), top][:, None] - switch
            jumped[held[:m] + t] = now[:m] < jump
            best[held[:m] + t] = top
            now[:m] = np.maximum(now[:m], jump)
        now[:m] += flat[first[:m] + t]

    # The chain that each part takes, from the last part of a text to its first, and its last language.
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    chosen, last = [], []
    c = 0
    for i, s in enumerate(scores):
        parts = [place[c : c + 1]]
        c += 1
        for _ in range(_STEPS, len(s), _STEPS):
            parts.append(place[c : c + k])
            c += k
        worth = [now[parts[0][0]]]
        for own in parts[1:]:
            worth.append((worth[-1][:, None] + now[own]).max(axis=0))
        j = int(worth[-1].argmax())
        for b in range(len(parts) - 1, -1, -1):
            came = int((worth[b - 1] + now[parts[b]][:, j]).argmax()) if b else 0
            chosen.append(parts[b][came])
            last.append(j)
            j = came
    by = np.argsort(-size[chosen], kind="stable")
    chosen, state = np.array(chosen)[by], np.array(last, np.int16)[by]
    first, size, held = first[chosen], size[chosen], held[chosen]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    label = np.zeros(len(flat), np.int16)
    for t in range(size[0] - 1, -1, -1):
        m = active[t]
        label[first[:m] + t] = state[:m]
        at = held[:m] + t
        state[:m] = np.where(jumped[at, state[:m]], best[at], state[:m])
    return np.split(label, np.cumsum([len(s) for s in scores])[:-1])


_OUT = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"
#: Words of the texts that are labelled side by side.
_WORDS_A_PART = 200_000


def spans(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one label: labels, first words and ends."""
    starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
    return labels[starts], starts, np.append(starts[1:], len(labels))


def identify(docs: DataFrame, model: LanguageModel, memo: int = 300_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``spans`` of each row.

    Spans are runs of words (numbered from 0) of one language.  The language of a text is that of
    most of its words, weighted by how much they tell apart; ``score`` is its share.  A null text
    and one without a letter are ``und`` with score 0 and no span; of equal shares the first name
    wins.  Each text is judged whole, however long, and by itself, so repeated rows are judged alike, a null
    ``doc_id`` stays null, and an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, "und"], pa.string())
        und = len(model.languages)
        index: dict[str, int] = {}
        table = weight = np.empty(0)

        def labelled(part: list[tuple[int, list[str]]], found: list) -> None:
            """Put into *found* what the texts of *part* are."""
            nonlocal index, table, weight
            if len(index) > memo:
                index = {}
            new = list(dict.fromkeys(w for _, own in part for w in own if w not in index))
            scores = model.score(new) if new else np.empty((0, und))
            # Some signs count as word characters but are no letters.
            letter = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in new], bool)
            base = len(table) if index else 0
            index |= zip(new, np.where(letter, np.arange(base, base + len(new)), -1).tolist(), strict=True)
            table = np.concatenate([table[:base].reshape(base, und), scores])
            # A word that fits all languages alike weighs little.
            weight = np.concatenate([weight[:base], 0.05 + np.ptp(scores, axis=1)])
            texts = []
            for i, own in part:
                at = np.fromiter(map(index.__getitem__, own), np.int64, len(own))
                at = at[at >= 0]
                if len(at):
                    texts.append((i, at))
            for (i, at), labels in zip(texts, viterbi([table[at] for _, at in texts], model.switch), strict=True):
                shares = np.bincount(labels, weight[at], und)
                best = int(shares.argmax())
                found[i] = (best, float(shares[best] / shares.sum()), spans(labels))

        for batch in batches:
            none = np.empty(0, np.int64)
            found: list = [(und, 0.0, (none, none, none))] * batch.num_rows
            part: list[tuple[int, list[str]]] = []
            size = 0
            for i in range(batch.num_rows if und else 0):
                own = words(batch.column(2)[i].as_py())
                if own:
                    part.append((i, own))
                    size += len(own)
                if size > _WORDS_A_PART:
                    labelled(part, found)
                    part, size = [], 0
            if part:
                labelled(part, found)
            ends = pa.array(np.cumsum([0, *(len(x[2][0]) for x in found)]).astype(np.int32))
            label, first, end = (np.concatenate([none, *(x[2][k] for x in found)]) for k in range(3))
            runs = pa.StructArray.from_arrays([names.take(pa.array(label)), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], ["lang", "start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), names.take(pa.array([x[0] for x in found], pa.int32())), pa.array([x[1] for x in found], pa.float64()), pa.ListArray.from_arrays(ends, runs)],
                ["doc_id", "held_out", "lang_pred", "score", "spans"],
            )

    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), fold.alias("held_out"), "text").mapInArrow(run, _OUT)


def op10_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).drop("spans")
