"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is cross-parsed whole against each: from the start of a
phrase follow the automaton for the longest match, across words, then start the next phrase. The language that needs the
fewest phrases, normalised as phrases x log2(training length) / text length (bits a character), wins.

Many texts are parsed at once, in stretches of ``STRETCH`` letters side by side: first as if a phrase began with each stretch,
then, for stretches that the text before enters within a phrase, from that state on, until both parsings are in the same state
at the same letter; from there they are one. Where they don't meet within a stretch, the next one is parsed again. So the result
is that of one parsing from the first letter to the last.

A worker holds one automaton a language as a table of at most ``TABLE`` entries of 4 bytes, and the driver ``rows`` texts a language:
both grow with the number of different languages (not with documents), which is taken to be a few hundred at most.

Training rows: a bounded sample of ``rows`` documents a language, one for each hash bucket of ids: the one with the smallest
hash among those of ``longest`` characters or fewer, else the shortest. Their texts are taken whole, as is every text that is
classified. Texts are reduced to lower-case letters (Unicode category L) with single spaces.

Defined cases: null text and text without letters give ``und`` with score 0; without training rows all are ``und``; rows with
null lang or null doc_id aren't learned from (a null id is no held-out row either); a doc_id that repeats is learned from once;
ties go to the smaller lang; repeated rows each give a row; an empty table gives an empty table; extra columns are ignored.
score = 1 - best / second best (1 with one language).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc, pieces

ROWS, LONGEST = 32, 2000
#: Table entries of an automaton at most, and the letters of a stretch.
TABLE, STRETCH = 1 << 24, 256
UNKNOWN = "und"


def normalised(texts) -> pa.Array:
    """Each text's lower-case words of letters with single spaces between, of an Arrow array or list of texts."""
    array = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(array, "")), r"[^\pL]+", " "), " ")


def letters(text: str | None) -> str:
    return normalised([text])[0].as_py()


def automaton(text: str) -> dict:
    """The suffix automaton of a text: a state is the dict of its next states, and the start is returned."""
    states, link, length = [{}], [-1], [0]
    last = 0
    for ch in text:
        cur = len(states)
        states.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and ch not in states[p]:
            states[p][ch] = cur
            p = link[p]
        if p != -1:
            q = states[p][ch]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(states)
                states.append(dict(states[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and states[p].get(ch) == q:
                    states[p][ch] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    for s in states:  # from numbers to the states themselves
        for ch, to in s.items():
            s[ch] = states[to]
    return states[0]


def phrases(start: dict, text: str) -> int:
    """Phrases of the cross-parsing of a text; a letter that the automaton lacks is a phrase."""
    n, s, first = 1, start, start.get
    for ch in text:
        t = s.get(ch)
        if t is None:
            n += s is not start
            t = first(ch)
            if t is None:
                n += 1
                t = start
        s = t
    return n - (s is start)


class Table:
    """An automaton as an array of next states by letter, which parses many texts at once."""

    def __init__(self, start: dict):
        number, order = {id(start): 0}, [start]
        for state in order:
            for to in state.values():
                if id(to) not in number:
                    number[id(to)] = len(order)
                    order.append(to)
        self.alphabet = sorted({ch for state in order for ch in state})
        self.start, self.next = start, None  # where the table would be too large, the automaton itself stays
        if len(order) * (len(self.alphabet) + 1) <= TABLE:
            column = {ch: i for i, ch in enumerate(self.alphabet)}
            self.next = np.full((len(order), len(self.alphabet) + 1), -1, np.int32)  # the last column is for other letters
            for i, state in enumerate(order):
                for ch, to in state.items():
                    self.next[i, column[ch]] = number[id(to)]
            self.column = np.full(0x110000, len(self.alphabet), np.int32)
            self.column[[ord(ch) for ch in self.alphabet]] = range(len(self.alphabet))
            self.start = None

    def _step(self, state: np.ndarray, ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, phrases begun) of many parsings by a letter each."""
        to = self.next[state, ch]
        begun = np.zeros(len(state), np.int32)
        miss = np.nonzero(to < 0)[0]
        if len(miss):
            again = self.next[0, ch[miss]]
            begun[miss] = (state[miss] != 0).astype(np.int32) + (again < 0)
            to[miss] = np.maximum(again, 0)
        return to, begun

    def phrases(self, texts: list[str]) -> np.ndarray:
        """As :func:`phrases` of each text."""
        if self.next is None:
            return np.array([phrases(self.start, t) for t in texts], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = self.column[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        parts = -(-sizes // STRETCH)
        if not parts.sum():
            return np.zeros(len(texts), np.int64)
        text = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(sizes) - sizes, parts) + number * STRETCH
        size = np.minimum(sizes[text] - number * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")  # stretches that end drop off the end
        live = np.searchsorted(-size[order], -np.arange(STRETCH), side="left")  # stretches longer than k
        deep = int(size.max())
        states, counts = np.zeros((deep, len(text)), np.int32), np.zeros((deep, len(text)), np.int32)
        state, n = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
        for k in range(deep):
            at = order[: live[k]]
            state[at], more = self._step(state[at], flat[begin[at] + k])
            n[at] += more
            states[k], counts[k] = state, n
        guess_end, guess_n = state.copy(), n.copy()
        # stretches entered within a phrase: parsed from the true state until both parsings meet
        entered = np.zeros(len(text), np.int32)
        todo = np.arange(len(text))[number > 0]
        while True:
            true = state[todo - 1]
            todo = todo[true != entered[todo]]
            if not len(todo):
                break
            entered[todo] = state[todo - 1]
            at, now, count = todo, entered[todo], np.zeros(len(todo), np.int32)
            for k in range(deep):
                ended = size[at] <= k
                if ended.any():
                    state[at[ended]], n[at[ended]] = now[ended], count[ended]
                    at, now, count = at[~ended], now[~ended], count[~ended]
                if not len(at):
                    break
                now, more = self._step(now, flat[begin[at] + k])
                count = count + more
                met = now == states[k, at]
                if met.any():
                    there = at[met]
                    state[there], n[there] = guess_end[there], count[met] + guess_n[there] - counts[k, there]
                    at, now, count = at[~met], now[~met], count[~met]
            state[at], n[at] = now, count
            todo = todo + 1  # the stretches after those whose end may have changed
            todo = todo[todo < len(text)]
            todo = todo[number[todo] > 0]
        total = np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)
        last = np.cumsum(parts) - 1
        some = parts > 0
        total[some] += 1 - (state[last[some]] == 0)
        return total


class Classifier:
    """The automata of all languages."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in samples]
        self.tables = [Table(automaton(text)) for _, text in samples]
        self.bits = np.array([math.log2(len(text) + 1) for _, text in samples])

    def classify(self, texts) -> tuple[list[str], np.ndarray]:
        """(languages, scores) of an Arrow array or list of texts."""
        plain = normalised(texts).to_pylist()
        if not plain or not self.langs:
            return [UNKNOWN] * len(plain), np.zeros(len(plain))
        size = np.array([len(t) for t in plain])
        costs = np.stack([t.phrases(plain) for t in self.tables], axis=1) * self.bits / np.maximum(size, 1)[:, None]
        order = np.argsort(costs, axis=1, kind="stable")
        rows = np.arange(len(costs))
        none = size == 0
        best = costs[rows, order[:, 0]]
        score = 1 - best / np.where(none, 1.0, costs[rows, order[:, 1]]) if len(self.langs) > 1 else np.ones(len(costs))
        return [UNKNOWN if x else self.langs[i] for i, x in zip(order[:, 0], none)], np.where(none, 0.0, score)


_built: dict = {}


def classifier(samples: list[tuple[str, str]]) -> Classifier:
    """Built once in a worker process."""
    mark = zlib.crc32(repr(samples).encode("utf-8", "surrogatepass"))
    if mark not in _built:
        _built.clear()
        _built[mark] = Classifier(samples)
    return _built[mark]


def train(docs: DataFrame, learn, rows: int = ROWS, longest: int = LONGEST) -> list[tuple[str, str]]:
    """(lang, training text) of the rows for which ``learn`` (a column) holds."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).where(F.col("text").rlike(r"\p{L}"))
    key = F.struct(F.greatest(F.length("text"), F.lit(longest)).alias("size"), h.alias("h"))
    chosen = known.groupBy("lang", F.pmod(F.shiftright(h, 7), F.lit(rows)).alias("b")).agg(F.min(key).alias("k")).collect()
    if not chosen:
        return []
    # one text for each chosen id, however often it stands in the table
    wanted = known.where(h.isin(sorted({r["k"]["h"] for r in chosen}))).groupBy("lang", h.alias("h")).agg(F.min(F.struct(F.length("text"), "text")).alias("t"))
    texts = {(r["lang"], r["h"]): r["t"]["text"] for r in wanted.select("lang", "h", "t").collect()}
    by: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["b"])):
        by.setdefault(r["lang"], []).append(letters(texts[r["lang"], r["k"]["h"]]))
    return [(lang, " " + " ".join(parts)) for lang, parts in sorted(by.items())]


def learnable():
    return F.pmod(doc_crc(F.col("doc_id")), F.lit(4)) != 2


def identify(docs: DataFrame, samples: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learns from rows that aren't held out unless samples are given."""
    samples = train(docs, learnable()) if samples is None else samples

    def run(batches):
        ready = classifier(samples)
        for b in batches:
            for part in pieces(b, 2):
                langs, scores = ready.classify(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.pmod(doc_crc(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, languages: tuple[str, ...] | None = None, certain: float = 0.0) -> DataFrame:
    """Documents in one of ``languages`` (None: in any learned one), columns kept. Documents without letters (``und``) go, and those
    whose score is below ``certain``. A null ``lang`` is filled with the language found. Without training rows all documents stay as they are."""
    samples = train(docs, learnable())
    if not samples:  # nothing is known of any language, so nothing can be rejected
        return docs
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        ready = classifier(samples)
        for b in batches:
            for part in pieces(b, text):
                found, scores = ready.classify(part.column(text))
                keep = [x != UNKNOWN and s >= certain and (languages is None or x in languages) for x, s in zip(found, scores)]
                filled = pc.coalesce(part.column(lang), pa.array(found, part.column(lang).type))
                yield part.set_column(lang, part.schema.field(lang), filled).filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots or the like don't matter
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
