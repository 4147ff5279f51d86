"""English analysis: stop words and the Snowball English stemmer as plain SQL expressions.

The stemmer is a list of steps, each an expression over the column ``w`` and the region starts ``r1`` and ``r2``; it is meant for the
distinct vocabulary, not for every token. The steps use functions that Spark and DuckDB share, so that a test's SQL can have them
too; ``like`` names the regular expression test, which the two engines call differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: English stop words of common full-text search.
STOP = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
    did doing a an the and but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Words with stems of their own, and words that are left as they are (always, or after their plural has gone).
SPECIAL = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl")
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which the first region starts.
BEGINNINGS = ("gener", "commun", "arsen")
#: Suffixes of the second and third step and what replaces them.
SECOND = dict(
    tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful",
    ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="",
)
THIRD = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = f"^({_C}*{_V}+{_C})"
_SHORT = f"({_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def _ends(w: str, s: str) -> str:
    return f"right({w}, {len(s)}) = '{s}'"


def _cut(w: str, s: str, by: str = "") -> str:
    return f"concat(left({w}, length({w}) - {len(s)}), '{by}')"


def _longest(w: str, rules) -> str:
    """A CASE over suffixes, longest first: (suffix, condition or None, result)."""
    cases = [f"WHEN {_ends(w, s)} THEN " + (r if c is None else f"CASE WHEN {c} THEN {r} ELSE {w} END") for s, c, r in sorted(rules, key=lambda x: -len(x[0]))]
    return f"CASE {' '.join(cases)} ELSE {w} END"


def steps(like: str) -> list[tuple[str, str]]:
    """(column, expression) in order, each over the columns ``word``, ``w``, ``r1``, ``r2`` and ``d`` as they are before it."""
    has = lambda w, p: f"{like}({w}, '{p}')"
    inside = lambda region, s: f"length(w) - {len(s)} >= {region}"
    marked = "CASE WHEN left(word, 1) = 'y' THEN concat('Y', substring(word, 2)) ELSE word END"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    beginning = "CASE " + " ".join(f"WHEN left(w, {len(b)}) = '{b}' THEN {len(b)}" for b in BEGINNINGS)
    r1 = f"{beginning} WHEN {has('w', _REGION)} THEN length(regexp_extract(w, '{_REGION}', 1)) ELSE length(w) END"
    r2 = f"CASE WHEN {has('substring(w, r1 + 1)', _REGION)} THEN r1 + length(regexp_extract(substring(w, r1 + 1), '{_REGION}', 1)) ELSE length(w) END"
    short_i = lambda s: f"CASE WHEN length(w) > 4 THEN {_cut('w', s, 'i')} ELSE {_cut('w', s, 'ie')} END"
    plural = _longest("w", [("sses", None, _cut("w", "sses", "ss")), ("ied", None, short_i("ied")), ("ies", None, short_i("ies")), ("us", None, "w"), ("ss", None, "w"), ("s", has("w", f"{_V}.+s$"), _cut("w", "s"))])
    bare = lambda s: _cut("w", s)
    past = [("eed", inside("r1", "eed"), _cut("w", "eed", "ee")), ("eedly", inside("r1", "eedly"), _cut("w", "eedly", "ee"))]
    past += [(s, has(bare(s), _V), f"concat({bare(s)}, '+')") for s in ("ed", "edly", "ing", "ingly")]  # '+': something was taken off
    stem = "left(w, length(w) - 1)"
    mended = f"""CASE WHEN right(w, 1) <> '+' THEN w WHEN {has('w', '(at|bl|iz)[+]$')} THEN concat({stem}, 'e')
        WHEN {has('w', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)[+]$')} THEN left(w, length(w) - 2)
        WHEN r1 >= length(w) - 1 AND {has(stem, _SHORT)} THEN concat({stem}, 'e') ELSE {stem} END"""
    soft = f"CASE WHEN {has('w', f'.{_C}[yY]$')} THEN concat(left(w, length(w) - 1), 'i') ELSE w END"
    extra = {"ogi": f"AND {has('w', 'logi$')}", "li": f"AND {has('w', '[cdeghkmnrt]li$')}"}
    second = _longest("w", [(s, f"{inside('r1', s)} {extra.get(s, '')}", _cut("w", s, by)) for s, by in SECOND.items()])
    third = _longest("w", [(s, inside("r2" if s == "ative" else "r1", s), _cut("w", s, by)) for s, by in THIRD.items()])
    fourth = _longest("w", [(s, inside("r2", s) + (f" AND {has('w', '[st]ion$')}" if s == "ion" else ""), _cut("w", s)) for s in FOURTH])
    fifth = f"""CASE WHEN {_ends('w', 'e')} AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {has(stem, _SHORT)})) THEN {stem}
        WHEN {_ends('w', 'll')} AND length(w) - 1 >= r2 THEN {stem} ELSE w END"""
    special = " ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in SPECIAL.items())
    kept = ", ".join(f"'{x}'" for x in KEPT)
    later = ", ".join(f"'{x}'" for x in KEPT_LATER)
    chain = [("w", marked), ("r1", r1), ("r2", r2), ("w", plural), ("d", f"w IN ({later})")]
    chain += [("w", f"CASE WHEN d THEN w ELSE {e} END") for e in (_longest("w", past), mended, soft, second, third, fourth, fifth)]
    return [*chain, ("stem", f"CASE WHEN length(word) <= 2 OR word IN ({kept}) THEN word {special} ELSE lower(w) END")]


_STATE = ("word", "w", "r1", "r2", "d")


def stem(word: str) -> str:
    """A Spark SQL expression: the stem of a lower-case word. Each step's state is bound by a lambda, so that it is made once."""
    state = f"named_struct('word', {word}, 'w', {word}, 'r1', 0, 'r2', 0, 'd', false)"
    for name, e in steps("regexp_like"):
        # names outside of quoted patterns are fields of the state
        e = "".join(part if i % 2 else re.sub(r"\b(word|w|r1|r2|d)\b", r"s.\1", part) for i, part in enumerate(re.split(r"('[^']*')", e)))
        fields = ", ".join(f"'{f}', {e if f == name else f's.{f}'}" for f in _STATE)
        state = f"transform(array({state}), s -> {e if name == 'stem' else f'named_struct({fields})'})[0]"
    return state


def stems(words: DataFrame) -> DataFrame:
    """word, stem of lower-case words (word)."""
    return words.select("word", F.expr(stem("word")).alias("stem"))


def stems_sql(words: str) -> str:
    """DuckDB SQL for ``stems`` of a table expression with a column ``word``."""
    q = f"SELECT word, word AS w, 0 AS r1, 0 AS r2, false AS d FROM {words}"
    for name, e in steps("regexp_matches"):
        q = f"SELECT * EXCLUDE ({name}), {e} AS {name} FROM ({q})" if name != "stem" else f"SELECT word, {e} AS stem FROM ({q})"
    return q
