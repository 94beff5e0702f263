"""English lexemes: words without stop words, brought to their stems, as column expressions.

The stemmer is the published Porter2 algorithm.  Each step is a list of (pattern, replacement): the first pattern
that matches applies, and a pattern that leaves a word as it is ends the step for words whose ending meets no
condition.  The steps are plain data, so that any engine with regular expressions can run them.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English stop words of full-text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Words whose stems the algorithm states one by one, words that it leaves alone, and words that it leaves
# alone once their plural ending is gone.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ALONE = "sky news howe atlas cosmos bias andes".split()
ALONE_LATER = "inning outing canning herring earring proceed exceed succeed".split()
KNOWN = WHOLE | {w: w for w in ALONE + ALONE_LATER} | {f"{w}s": w for w in ALONE_LATER}

_V, _C = "[aeiouy]", "[^aeiouy]"
#: Before an ending in the first region (behind the first consonant that follows a vowel), and in the second.
_R1 = f".*?{_V}{_C}.*"
_R2 = f".*?{_V}{_C}.*?{_V}{_C}.*"
#: A short syllable at the end, and a word that is one.
_SHORT = f"{_C}{_V}[^aeiouywxY]"
_MARK = "\x01"


def _ending(suffix: str, stem: str, put: str) -> list[tuple[str, str]]:
    """suffix behind a stem becomes put; behind any other it stays."""
    return [(f"^({stem}){suffix}$", "\\1" + put), (f"^(.*{suffix})$", "\\1")]


def _each(stem: str, **endings: str) -> list[tuple[str, str]]:
    return [rule for suffix, put in endings.items() for rule in _ending(suffix, stem, put)]


def _behind(region: str, letters: str) -> str:
    """A stem of a region that ends with one of some consonants."""
    head = f".*?{_V}" if region == _R1 else f".*?{_V}{_C}.*?{_V}"
    return f"{head}(?:{_C}.*[{letters}]|[{letters.replace('e', '')}])"


# The endings of the algorithm, the longest first within a step.
STEPS: list[list[tuple[str, str]]] = [
    # beginnings whose first region starts at their end: a mark in place of a vowel makes it so
    [("^gener(.*)$", "g\x02ner\\1"), ("^commun(.*)$", "c\x03mmun\\1"), ("^arsen(.*)$", "\x04rsen\\1")],
    [("^(.*)sses$", "\\1ss"), ("^(..+)(?:ied|ies)$", "\\1i"), ("^(.?)(?:ied|ies)$", "\\1ie"), ("^(.*(?:us|ss))$", "\\1"), (f"^(.*{_V}.+)s$", "\\1")],
    [
        *_ending("eedly", _R1, "ee"),
        *_ending("ingly", f".*{_V}.*", _MARK),
        *_ending("edly", f".*{_V}.*", _MARK),
        *_ending("eed", _R1, "ee"),
        *_ending("ing", f".*{_V}.*", _MARK),
        *_ending("ed", f".*{_V}.*", _MARK),
    ],
    [
        (f"^(.*(?:at|bl|iz)){_MARK}$", "\\1e"),
        *((f"^(.*{c}){c}{_MARK}$", "\\1") for c in "bdfgmnprt"),
        (f"^({_C}+{_V}[^aeiouywxY]|{_V}{_C}){_MARK}$", "\\1e"),
        (f"^(.*){_MARK}$", "\\1"),
    ],
    [(f"^(.+{_C})[yY]$", "\\1i")],
    [
        *_each(_R1, ization="ize", ational="ate", fulness="ful", ousness="ous", iveness="ive", tional="tion", biliti="ble", lessli="less"),
        *_each(_R1, entli="ent", ation="ate", alism="al", aliti="al", ousli="ous", iviti="ive", fulli="ful", enci="ence", anci="ance", abli="able", izer="ize", ator="ate", alli="al", bli="ble"),
        *_ending("ogi", _behind(_R1, "l"), "og"),
        *_ending("li", _behind(_R1, "cdeghkmnrt"), ""),
    ],
    [*_each(_R1, ational="ate", tional="tion", alize="al", icate="ic", iciti="ic"), *_ending("ative", _R2, ""), *_each(_R1, ical="ic", ness="", ful="")],
    [*_each(_R2, **dict.fromkeys("ement ance ence able ible ment ant ent ism ate iti ous ive ize".split(), "")), *_ending("ion", _behind(_R2, "st"), ""), *_each(_R2, al="", er="", ic="")],
    [(f"^({_R2})e$", "\\1"), (f"^(.*{_SHORT}|{_V}{_C})(e)$", "\\1\\2"), (f"^({_R1})e$", "\\1"), (f"^({_behind(_R2, 'l')})l$", "\\1")],
    [("^g\x02(.*)$", "ge\\1"), ("^c\x03(.*)$", "co\\1"), ("^\x04(.*)$", "a\\1")],
]


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# What a word has that a step may change; other words skip it.
GUARDS = [
    "^(?:gener|commun|arsen)",
    "(?:s|ied)$",
    "(?:ly|ed|ing)$",
    f"{_MARK}$",
    "[yY]$",
    "(?:tion|tional|ness|i|alism|izer|ator)$",
    "(?:tional|alize|icate|i|ative|ical|ness|ful)$",
    "(?:ement|ance|ence|able|ible|ment|ant|ent|ism|ate|iti|ous|ive|ize|ion|al|er|ic)$",
    "[el]$",
    "^(?:g\x02|c\x03|\x04)",
]


def _step(guard: str, rules: list[tuple[str, str]]):
    def step(word: Column) -> Column:
        chain = None
        for pattern, put in rules:
            test, value = word.rlike(pattern), F.regexp_replace(word, pattern, put.replace("\\1", "$1").replace("\\2", "$2"))
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return F.when(word.rlike(guard), chain.otherwise(word)).otherwise(word)

    return step


def stem(word: Column | str) -> Column:
    """The stem of a lower-case word.  Costly for every word of a text: use it on distinct words."""
    word = F.col(word) if isinstance(word, str) else word
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({_V})y", "$1Y")
    for guard, rules in zip(GUARDS, STEPS, strict=True):
        marked = _let(marked, _step(guard, rules))
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.coalesce(F.try_element_at(known, word), F.when(F.length(word) > 2, F.translate(marked, "Y", "y")).otherwise(word))


def is_stop_word(word: Column | str) -> Column:
    return (F.col(word) if isinstance(word, str) else word).isin(*STOP_WORDS)


def lexicon(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, term): the stem of each distinct word that is no stop word."""
    return words.select(word).distinct().where(~is_stop_word(word)).withColumn("term", stem(word))


@cache
def _compiled() -> tuple[re.Pattern, list]:
    """What a word must have for any step to change it, and the steps as compiled expressions, each rule with the letters
    that it ends with, if these are always the same."""

    def tail(pattern: str) -> str:
        found = re.search(r"[)*]([a-z]+)\)?\$$", pattern)
        return found[1] if found else ""

    return re.compile("|".join(GUARDS)), [(re.compile(guard), [(tail(p), re.compile(p), put) for p, put in rules]) for guard, rules in zip(GUARDS, STEPS, strict=True)]


def stem_of(word: str) -> str:
    """stem() of one word, for tasks that have words at hand: the same steps."""
    if word in KNOWN or len(word) <= 2:
        return KNOWN.get(word, word)
    some, steps = _compiled()
    if not some.search(word):
        return word
    marked = re.sub(f"({_V})y", "\\1Y", re.sub("^y", "Y", word)) if "y" in word else word
    for guard, rules in steps:
        if guard.search(marked):
            for tail, pattern, put in rules:
                if marked.endswith(tail) and (found := pattern.search(marked)):
                    marked = found.expand(put)
                    break
    return marked.replace("Y", "y")


def stem_sql(word: str = "word", table: str = "words") -> str:
    """A query of (word, term) over a table of distinct words in DuckDB's SQL: the same steps, one after the other."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    inner = f"SELECT {word} AS word, regexp_replace(regexp_replace({word}, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS w FROM {table}"
    for rules in STEPS:
        cases = " ".join(f"WHEN regexp_matches(w, {quote(p)}) THEN regexp_replace(w, {quote(p)}, {quote(put)})" for p, put in rules)
        inner = f"SELECT word, CASE {cases} ELSE w END AS w FROM ({inner})"
    known = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in KNOWN.items())
    stops = ", ".join(map(quote, STOP_WORDS))
    return f"SELECT word, CASE word {known} ELSE CASE WHEN length(word) > 2 THEN replace(w, 'Y', 'y') ELSE word END END AS term FROM ({inner}) WHERE word NOT IN ({stops})"
