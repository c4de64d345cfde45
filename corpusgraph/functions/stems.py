"""Stems of English and Portuguese words by ordered suffix rules, after the published Snowball algorithms.

A language is a table of steps.  A step takes the longest of its suffixes that a word ends with, and rewrites it if its
condition holds; the conditions are regions of the word (a suffix must begin in them) and patterns of what stands before the suffix.  The
same table becomes an expression of columns or of SQL, in which each step is a CASE.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.text import bound


@dataclass(frozen=True)
class Rule:
    """Rewrite *suffix* as *to*, if it begins in *region* (r1, r2, rv) and the part before it matches *before*.

    ``to`` may begin with ``-``: so many characters of the part before go too.
    """

    suffix: str
    to: str = ""
    region: str | None = None
    before: str | None = None


@dataclass(frozen=True)
class Step:
    """Rules of which at most one applies: that of the longest suffix, or, *within* regions, of the longest whose condition holds.

    *after* names steps of which one must have changed the word (a colon and suffixes: by one of these), *unless* some that must not.
    """

    name: str
    rules: list[Rule]
    within: bool = False
    after: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class Language:
    """*regions* are patterns of all that stands before a region; r2 is looked for in r1."""

    steps: list[Step]
    regions: dict[str, list[str]]
    words: dict[str, str] = field(default_factory=dict)
    prepare: list[tuple[str, str]] = field(default_factory=list)
    finish: list[tuple[str, str]] = field(default_factory=list)
    shortest: int = 1


def _all(suffixes: str, to: str = "", region: str | None = None, before: str | None = None) -> list[Rule]:
    return [Rule(s, to, region, before) for s in suffixes.split()]


# The suffixes, regions and exceptions of the published English stemmer (its second version), less apostrophes,
# which tokens do not have.
_V = "[aeiouy]"
_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_ENGLISH = Language(
    shortest=3,
    prepare=[("^y", "Y"), ("([aeiouy])y", "$1Y")],
    regions={"r1": ["^(gener|commun|arsen)", f"^.*?{_V}[^aeiouy]"], "r2": [f"^.*?{_V}[^aeiouy]"]},
    words={
        "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
        "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes inning innings outing outings canning cannings herring herrings earring earrings proceed exceed succeed".split()},
        **{w + "s": w for w in "inning outing canning herring earring proceed exceed succeed".split()},
    },
    steps=[
        Step("plural", [Rule("sses", "ss"), Rule("ied", "i", before="..$"), Rule("ied", "ie"), Rule("ies", "i", before="..$"), Rule("ies", "ie"), Rule("us", "us"), Rule("ss", "ss"), Rule("s", "", before=f"{_V}.+$")]),
        Step("past", [*_all("eedly eed", "ee", "r1"), *_all("ingly edly ing ed", "", before=_V)]),
        Step("mend", [*_all("at bl iz", "+e"), *[Rule(c * 2, c) for c in "bdfgmnprt"], Rule("", "+e", before=f"r1:{_SHORT}")], after=("past:ingly edly ing ed",)),
        Step("final_y", [Rule("y", "i", before="^.+[^aeiouy]$"), Rule("Y", "i", before="^.+[^aeiouy]$")]),
        Step("second", [
            Rule("ational", "ate", "r1"), Rule("tional", "tion", "r1"), Rule("enci", "ence", "r1"), Rule("anci", "ance", "r1"), Rule("abli", "able", "r1"), Rule("entli", "ent", "r1"),
            Rule("izer", "ize", "r1"), Rule("ization", "ize", "r1"), Rule("ation", "ate", "r1"), Rule("ator", "ate", "r1"), Rule("alism", "al", "r1"), Rule("aliti", "al", "r1"),
            Rule("alli", "al", "r1"), Rule("fulness", "ful", "r1"), Rule("ousli", "ous", "r1"), Rule("ousness", "ous", "r1"), Rule("iveness", "ive", "r1"), Rule("iviti", "ive", "r1"),
            Rule("biliti", "ble", "r1"), Rule("bli", "ble", "r1"), Rule("ogi", "og", "r1", "l$"), Rule("fulli", "ful", "r1"), Rule("lessli", "less", "r1"), Rule("li", "", "r1", "[cdeghkmnrt]$"),
        ]),
        Step("third", [
            Rule("ational", "ate", "r1"), Rule("tional", "tion", "r1"), Rule("alize", "al", "r1"), *_all("icate iciti ical", "ic", "r1"), *_all("ful ness", "", "r1"), Rule("ative", "", "r2"),
        ]),
        Step("fourth", [*_all("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", "", "r2"), Rule("ion", "", "r2", "[st]$")]),
        Step("fifth", [Rule("e", "", "r2"), Rule("e", "", "r1", f"not:{_SHORT}"), Rule("l", "", "r2", "l$")]),
    ],
    finish=[("Y", "y")],
)

# The suffixes and regions of the published Portuguese stemmer; a~ and o~ stand for ã and õ.
_VP = "[aeiouáéíóúâêô]"
_CP = "[^aeiouáéíóúâêô]"
_VERBS = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam
    em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas
    es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis
    ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos
    imos armos ermos irmos eu iu ou ira iras"""
_PORTUGUESE = Language(
    prepare=[("ã", "a~"), ("õ", "o~")],
    regions={
        "r1": [f"^.*?{_VP}{_CP}"], "r2": [f"^.*?{_VP}{_CP}"],
        "rv": [f"^.{_CP}{_CP}*{_VP}", f"^{_VP}{_VP}{_VP}*{_CP}", f"^{_CP}{_VP}."],
    },
    steps=[
        Step("standard", [
            *_all("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", "", "r2"),
            *_all("logia logias", "log", "r2"), *_all("uça~o uço~es", "u", "r2"), *_all("ência ências", "ente", "r2"), Rule("amente", "", "r1"), Rule("mente", "", "r2"),
            *_all("idade idades", "", "r2"), *_all("iva ivo ivas ivos", "", "r2"), *_all("ira iras", "ir", "rv", "e$"),
        ]),
        Step("of_amente", [Rule("iv", "", "r2"), *_all("os ic ad", "", "r2")], after=("standard:amente",)),
        Step("of_ativamente", [Rule("at", "", "r2")], after=("of_amente:iv",)),
        Step("of_mente", _all("ante avel ível", "", "r2"), after=("standard:mente",)),
        Step("of_idade", _all("abil ic iv", "", "r2"), after=("standard:idade idades",)),
        Step("of_ivo", [Rule("at", "", "r2")], after=("standard:iva ivo ivas ivos",)),
        Step("verb", _all(_VERBS, "", "rv"), within=True, unless=("standard",)),
        Step("ci", [Rule("i", "", "rv", "c$")], after=("standard", "verb")),
        Step("residue", _all("os a i o á í ó", "", "rv"), unless=("standard", "verb")),
        Step("e", [*[Rule("gu" + e, "g", "rv-1") for e in "eéê"], *[Rule("ci" + e, "c", "rv-1") for e in "eéê"], *_all("e é ê", "", "rv"), Rule("ç", "c")], within=True),
    ],
    finish=[("a~", "ã"), ("o~", "õ")],
)
LANGUAGES = {"en": _ENGLISH, "pt": _PORTUGUESE}


class _Columns:
    """Makes columns of tables of rules."""

    lit = staticmethod(F.lit)

    def length(self, w):
        return F.length(w)

    def left(self, w, n):
        return F.substring(w, F.lit(1), n)

    def after(self, w, n):
        return F.substring(w, n + 1, F.length(w))

    def replace(self, w, pattern, to):
        return F.regexp_replace(w, pattern, to)

    def prefix(self, w, pattern):
        return F.length(F.regexp_extract(w, f"({pattern})", 1))

    def ends(self, w, suffix):
        return F.endswith(w, F.lit(suffix))

    def matches(self, w, pattern):
        return w.rlike(pattern)

    def concat(self, a, text):
        return F.concat(a, F.lit(text)) if text else a

    def cases(self, pairs, default):
        out = None
        for condition, value in pairs:
            out = F.when(condition, value) if out is None else out.when(condition, value)
        return default if out is None else out.otherwise(default)

    def both(self, a, b):
        return a & b

    def either(self, a, b):
        return a | b

    def no(self, a):
        return ~a

    def least(self, a, n):
        return a >= n

    def equal(self, a, b):
        return a == b


class _Sql:
    """Makes SQL of them, for engines that know CASE and regular expressions."""

    def lit(self, x):
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)

    def length(self, w):
        return f"length({w})"

    def left(self, w, n):
        return f"substr({w}, 1, {n})"

    def after(self, w, n):
        return f"substr({w}, {n} + 1)"

    def replace(self, w, pattern, to):
        return f"regexp_replace({w}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def prefix(self, w, pattern):
        return f"length(regexp_extract({w}, {self.lit(pattern)}))"

    def ends(self, w, suffix):
        return f"ends_with({w}, {self.lit(suffix)})"

    def matches(self, w, pattern):
        return f"regexp_matches({w}, {self.lit(pattern)})"

    def concat(self, a, text):
        return f"{a} || {self.lit(text)}" if text else a

    def cases(self, pairs, default):
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END" if pairs else default

    def both(self, a, b):
        return f"({a} AND {b})"

    def either(self, a, b):
        return f"({a} OR {b})"

    def no(self, a):
        return f"NOT ({a})"

    def least(self, a, n):
        return f"{a} >= {n}"

    def equal(self, a, b):
        return f"{a} = {b}"


def _applied(x, step: Step, state: dict):
    """The rule that takes effect at *step* (its place, or -1) and the word after it, as two lists of cases."""
    word, places, words = state["w"], [], []
    order = sorted(range(len(step.rules)), key=lambda i: -len(step.rules[i].suffix))
    for i in order:
        rule = step.rules[i]
        part = x.left(word, f"({x.length(word)} - {len(rule.suffix)})" if isinstance(x, _Sql) else F.length(word) - len(rule.suffix)) if rule.suffix else word
        at = x.length(part)
        holds = None
        and_ = lambda a, b: b if a is None else x.both(a, b)
        if rule.region:
            name, _, less = rule.region.partition("-")
            holds = and_(holds, x.least(at, state[name]) if not less else x.least(f"({at} + {less})" if isinstance(x, _Sql) else at + int(less), state[name]))
        if rule.before:
            kind, _, pattern = rule.before.rpartition(":") if rule.before.startswith(("r1:", "not:")) else ("", "", rule.before)
            if kind == "r1":  # the whole word lies before r1
                holds = and_(holds, x.both(x.no(x.least(x.length(word), f"({state['r1']} + 1)" if isinstance(x, _Sql) else state["r1"] + 1)), x.matches(part, pattern)))
            else:
                holds = and_(holds, x.no(x.matches(part, pattern)) if kind == "not" else x.matches(part, pattern))
        new = x.concat(word, rule.to[1:]) if rule.to.startswith("+") else x.concat(part, rule.to)
        again = step.within or any(r.suffix == rule.suffix for j, r in enumerate(step.rules) if j > i)
        found = x.ends(word, rule.suffix)
        if holds is not None and again:  # another rule of the suffix has its turn
            places.append((x.both(found, holds), x.lit(i)))
            words.append((x.both(found, holds), new))
        else:
            places.append((found, x.lit(i) if holds is None else x.cases([(holds, x.lit(i))], x.lit(-1))))
            words.append((found, new if holds is None else x.cases([(holds, new)], word)))
    return x.cases(places, x.lit(-1)), x.cases(words, word)


def _allowed(x, language: Language, step: Step, state: dict):
    """Whether what *step* depends on has happened, or None if it depends on nothing."""
    rules = {s.name: s.rules for s in language.steps}

    def happened(wish: str):
        name, _, suffixes = wish.partition(":")
        some = [i for i, r in enumerate(rules[name]) if not suffixes or r.suffix in suffixes.split()]
        out = None
        for i in some:
            one = x.equal(state[name], x.lit(i))
            out = one if out is None else x.either(out, one)
        return x.least(state[name], x.lit(0)) if not suffixes else out

    out = None
    for wish in step.after:
        out = happened(wish) if out is None else x.either(out, happened(wish))
    for wish in step.unless:
        one = x.no(happened(wish))
        out = one if out is None else x.both(out, one)
    return out


def stem(token: Column | str, lang: str) -> Column:
    """The stem of a lower-case token in *lang* (``pt``, or else English).  Null stays null."""
    language, x = LANGUAGES["pt" if lang.startswith("pt") else "en"], _Columns()
    token = F.col(token) if isinstance(token, str) else token

    def run(steps: list[Step], state: dict) -> Column:
        if not steps:
            out = state["w"]
            for pattern, to in language.finish:
                out = x.replace(out, pattern, to)
            return out
        place, word = _applied(x, steps[0], state)
        allowed = _allowed(x, language, steps[0], state)
        if allowed is not None:
            place, word = x.cases([(allowed, place)], x.lit(-1)), x.cases([(allowed, word)], state["w"])
        return bound(F.struct(place.alias("p"), word.alias("w")), lambda s: run(steps[1:], {**state, steps[0].name: s["p"], "w": s["w"]}))

    def regions(word: Column) -> Column:
        def start(name: str, w: Column) -> Column:
            patterns = language.regions[name]
            return x.cases([(x.matches(w, p), x.prefix(w, p)) for p in patterns], x.length(w))

        def rest(r1: Column) -> Column:
            marks = {"r1": r1, "r2": r1 + start("r2", x.after(word, r1))} | ({"rv": start("rv", word)} if "rv" in language.regions else {})
            return bound(F.struct(*[c.alias(k) for k, c in marks.items()]), lambda m: run(language.steps, {"w": word, **{k: m[k] for k in marks}}))

        return bound(start("r1", word), rest)

    prepared = token
    for pattern, to in language.prepare:
        prepared = x.replace(prepared, pattern, to)
    stemmed = bound(prepared, regions)
    known = [(x.equal(token, x.lit(k)), x.lit(w)) for k, w in language.words.items()]
    return x.cases([(token.isNull(), F.lit(None).cast("string")), (~x.least(x.length(token), language.shortest), token), *known], stemmed)


def stem_sql(table: str, token: str, lang: str) -> str:
    """A SELECT of all columns of *table* and ``stem``, that of its column *token*."""
    language, x = LANGUAGES["pt" if lang.startswith("pt") else "en"], _Sql()
    word = token
    for pattern, to in language.prepare:
        word = x.replace(word, pattern, to)
    start = lambda name, w: x.cases([(x.matches(w, p), x.prefix(w, p)) for p in language.regions[name]], x.length(w))
    sql = f"SELECT *, {word} AS w_ FROM {table}"
    sql = f"SELECT *, {start('r1', 'w_')} AS r1 FROM ({sql})"
    marks = f"r1 + {start('r2', 'substr(w_, r1 + 1)')} AS r2" + (f", {start('rv', 'w_')} AS rv" if "rv" in language.regions else "")
    sql = f"SELECT *, {marks} FROM ({sql})"
    state = {"w": "w_", "r1": "r1", "r2": "r2", "rv": "rv"}
    for i, step in enumerate(language.steps):
        place, word = _applied(x, step, state)
        allowed = _allowed(x, language, step, state)
        if allowed is not None:
            place, word = x.cases([(allowed, place)], "-1"), x.cases([(allowed, word)], state["w"])
        sql = f"SELECT *, {place} AS p{i}_, {word} AS w{i}_ FROM ({sql})"
        state |= {"w": f"w{i}_", step.name: f"p{i}_"}
    word = state["w"]
    for pattern, to in language.finish:
        word = x.replace(word, pattern, to)
    known = [(x.equal(token, x.lit(k)), x.lit(w)) for k, w in language.words.items()]
    return f"SELECT * EXCLUDE (w_), {x.cases([(f'length({token}) < {language.shortest}', token), *known], word)} AS stem FROM ({sql})"
