"""Toxicity by a weighted lexicon.

Texts are lower-cased and folded (homoglyphs of other scripts and digits used as letters become Latin letters), an
Aho-Corasick automaton finds all lexicon entries at word starts, exception phrases cover harmless uses, and the summed
weights, alone and normalised by length, give the score through a logistic curve.

The lexicon is a fixed list of insults and what labelled text teaches: words and word beginnings (stems) whose smoothed
log-odds between toxic and other training documents, over at least ``support`` toxic documents, reach ``odds``; the log-odds
are the weights; all of them are taken, and how many there can be is bounded by the sample. Training rows are a bounded sample of ``sample`` labelled documents (smallest hashes of ids); half of it
teaches the lexicon and the other half the curve.

Defined cases: null or empty text scores like a text without hits; null labels and ids aren't learned from; a document labelled
more than once counts by its largest label, and of an id with several texts the one with the smallest hash is learned from, once; repeated rows each give a row; without training rows the fixed list and a fixed
curve hold; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc

SAMPLE, SUPPORT, ODDS = 20_000, 4, 3.0
STEMS = (4, 5, 6, 8)
#: Insults, with weights.
INSULTS = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "scum": 4.0, "loser": 3.0, "trash": 2.0, "worthless": 2.0, "pathetic": 2.0, "disgusting": 2.0, "clown": 2.0, "imbecile": 4.0, "bastard": 4.0, "asshole": 5.0, "bitch": 4.0, "shit": 4.0, "fuck": 5.0, "retard": 4.0, "vermin": 3.0}
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "trash folder", "idiot proof", "idiot-proof", "disgusting smell", "sore loser board", "shiitake")
#: Letters of other scripts that look like Latin ones, and signs used as letters.
FOLD = dict(zip("аеорсухіјѕԁһӏոցԛԝɡαεικνορτυχⅰⅼ０１３４５７", "aeopcyxijsdhlngqwgaeikvoptuxiloieast")) | {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "​": "", "‌": "", "‍": "", "­": ""}
_FOLD = {ord(k): v for k, v in FOLD.items()}
_SIGNS = re.compile(r"[@$!](?![^\W\d_])|[$]{2,}|!{2,}")
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str | None) -> str:
    """Lower case, folded; signs that no letter follows stay signs."""
    if not text:
        return ""
    t = text.lower()
    if "@" in t or "$" in t or "!" in t:
        t = _SIGNS.sub(" ", t)
    return t.translate(_FOLD)


def features(text: str | None, stems=STEMS) -> set[str]:
    """Words (ended by a space) and word beginnings of a text."""
    words = set(_WORD.findall(folded(text)))
    return {w + " " for w in words if len(w) > 2} | {w[:k] for w in words for k in stems if len(w) >= k}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for e in {folded(x) for x in exceptions}:
            self.automaton.add_word(e, (0.0, len(e), True, False))
        for entry, weight in weights.items():
            word = entry.rstrip(" ")
            if word and (word not in self.automaton or not self.automaton.get(word)[2]):
                old = self.automaton.get(word, None)
                self.automaton.add_word(word, (max(weight, old[0]) if old else weight, len(word), False, entry.endswith(" ") and (not old or old[3])))
        if len(self.automaton):
            self.automaton.make_automaton()

    def measure(self, text: str | None) -> tuple[float, float]:
        """(log of 1 + summed weights, log of 1 + summed weights a thousand characters)."""
        t = folded(text)
        if not t or not len(self.automaton):
            return 0.0, 0.0
        hits, covered, best = [], [], {}
        for end, (weight, size, exception, whole) in self.automaton.iter(t):
            start = end + 1 - size
            if start and t[start - 1].isalpha():
                continue
            if (whole or exception) and end + 1 < len(t) and t[end + 1].isalpha():
                continue
            if exception:
                covered.append((start, end))
            else:
                hits.append((start, weight))
        covered.sort()
        begins, reach = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
        for start, weight in hits:
            before = bisect_right(begins, start)  # exceptions that begin no later; one of them covers the hit if any reaches so far
            if not before or reach[before - 1] < start:
                best[start] = max(weight, best.get(start, 0.0))  # a word counts once, by its heaviest entry
        total = sum(best.values())
        return math.log1p(total), math.log1p(1000.0 * total / len(t))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """h, text, toxic of a bounded sample of the rows to learn from."""
    y = labels.select(F.col("doc_id").alias("id"), "toxic").where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    y = y.where(F.pmod(doc_crc(F.col("id")), F.lit(5)) != 0).withColumn("h", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)))
    y = y.orderBy("h", "id").limit(sample)
    # one text for each id, whichever repeats: the one with the smallest hash
    known = docs.select("doc_id", "text").join(F.broadcast(y), F.col("doc_id") == F.col("id"))  # ``sample`` rows at most
    one = known.groupBy("id", "h", F.col("toxic").cast("int").alias("toxic")).agg(F.min(F.struct(F.xxhash64("text").alias("th"), "text")).alias("t"))
    return one.select("h", "t.text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, support: int = SUPPORT, odds: float = ODDS) -> tuple[dict[str, float], tuple[float, float, float]]:
    """(lexicon, curve (bias, weight of sum, weight of density))."""
    from .common import saved

    rows = saved(_labelled(docs, labels, sample), "labelled")

    def count(batches):
        toxic, other = {}, {}
        for b in batches:
            for t, y in zip(b.column(0), b.column(1)):
                into = toxic if y.as_py() else other
                for f in features(t.as_py()):
                    into[f] = into.get(f, 0) + 1
        keys = list(toxic.keys() | other.keys())
        for at in range(0, len(keys), 20000):
            k = keys[at : at + 20000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([toxic.get(x, 0) for x in k], pa.int64()), pa.array([other.get(x, 0) for x in k], pa.int64())], names=["f", "t", "c"])

    teach = rows.where(F.col("h") % 2 == 0)
    n = {r["toxic"]: r["n"] for r in teach.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, nc = n.get(1, 0), n.get(0, 0)
    weights = dict(INSULTS)
    if nt and nc:
        counts = teach.select("text", "toxic").mapInArrow(count, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        lift = F.log((F.col("t") + 0.1) / (nt + 0.2)) - F.log((F.col("c") + 1.0) / (nc + 2.0))
        need = max(support, math.ceil(0.005 * nt))
        strong = counts.where(F.col("t") >= need).withColumn("w", lift).where(F.col("w") >= odds)
        weights |= {r["f"]: r["w"] for r in strong.select("f", "w").collect()}

    def measure(batches):
        lexicon = Lexicon(weights)
        for b in batches:
            out = [lexicon.measure(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64())], names=["y", "s", "d"])

    fit = rows.where(F.col("h") % 2 == 1).select("text", "toxic").mapInArrow(measure, "y int, s double, d double").collect()
    return weights, logistic(np.array([[1.0, r["s"], r["d"]] for r in fit]), np.array([r["y"] for r in fit]))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method; a fixed curve where there are too few rows or one class."""
    if len(y) < 20 or y.min() == y.max():
        return (-2.5, 2.0, 0.2)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, 0.05, 0.05])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return tuple(float(v) for v in w)


def score(docs: DataFrame, weights: dict[str, float], curve: tuple[float, float, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches):
        lexicon = Lexicon(weights)
        for b in batches:
            out = []
            for t in b.column(2):
                s, d = lexicon.measure(t.as_py())
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, curve[0] + curve[1] * s + curve[2] * d)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array([int(p >= 0.5) for p in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(doc_crc(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    weights, curve = learn(docs, labels, sample)
    return score(docs, weights, curve)
