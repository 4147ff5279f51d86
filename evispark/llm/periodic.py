"""Periodic run detection: maximal repetitions of words, found through difference-cover LCE queries on a harmonic grid.

A run of period q that is at least 4 q words long holds, for its period, three or more grid places g, g + q, g + 2q, ... (multiples
of q) in a row whose word equals the word q further on. So the grid of period q has n / q places, all grids together n log n
(harmonic sum); places that agree ask for a longest common extension to the right, and the first of a stretch for one to the left.

An extension (LCE) of two places compares a few words until both places, moved on by the same step, are in the difference cover
D of Z_v: such a step below v exists for any two places. Only suffixes at places of the cover are sorted (by ranks of v words,
doubled until they are all different); the common prefix of two of them is a range minimum over the common prefixes of
neighbours, answered by a sparse table. To the left the same structure is built on the reversed words. The structures are built
for the documents of a batch whose grids agree anywhere, all of them side by side: separators that equal nothing stand between.

Of stretches that several periods find, the smallest period is the run's (a stretch of period p and 4 p words whose smallest period
is q has q | p, so it is found for q too).

Work is one pass over the documents, each whole in one task; n words need memory for some dozen integers each and n log n time.

Defined cases: null or empty texts have no words and no runs; a null doc_id is kept and its words stay as they are; repeated rows
each give a row; ties by smallest start, then period; very long texts are taken whole; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces

#: A run has LEAST words and REPEATS periods or more.
LEAST, REPEATS = 6, 4
#: A difference cover: any step modulo V is the difference of two of these places.
V, COVER = 13, (0, 1, 3, 9)


class Extensions:
    """Longest common extensions to the right of places in one array of integers (0 or more; negative numbers are unique)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words.astype(np.int64), -1 - np.arange(n + 1, n + 1 + 2 * V, dtype=np.int64)])
        member = np.zeros(V, dtype=bool)
        member[list(COVER)] = True
        #: step[a, b]: the least step that takes places of residues a and b into the cover together
        self.step = np.array([[next(d for d in range(V) if member[(a + d) % V] and member[(b + d) % V]) for b in range(V)] for a in range(V)])
        self.residue_at = np.full(V, -1)
        self.residue_at[list(COVER)] = np.arange(len(COVER))
        self._sort(n)

    def _sort(self, n: int) -> None:
        """Ranks of the sampled suffixes, the common prefixes of neighbours, and the sparse table over them."""
        blocks = n // V + 1
        places = (np.arange(blocks)[:, None] * V + np.array(COVER)).ravel()  # sample s stands at places[s]
        places = places[places <= n]
        self.count = len(places)
        rank = self._named(np.stack([self.words[places + k] for k in range(V)]))
        levels, reach = [rank], 1  # samples s and s + len(COVER) * reach stand V * reach words apart
        while reach * V <= n and rank.max() + 1 < len(rank):
            moved = np.full(len(rank), -1, dtype=np.int64)
            shift = len(COVER) * reach
            moved[: len(rank) - shift] = rank[shift:]
            rank = self._named(np.stack([rank, moved]))
            levels.append(rank)
            reach *= 2
        order = np.empty(len(rank), dtype=np.int64)
        order[rank] = np.arange(len(rank))
        self.rank = rank
        # common prefixes of neighbours, from the longest blocks down to single words
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            level, span = levels[k], len(COVER) << k
            while True:
                fits = (a < len(level)) & (b < len(level))
                same = np.zeros(len(a), dtype=bool)
                same[fits] = level[a[fits]] == level[b[fits]]
                if not same.any():
                    break
                a[same] += span
                b[same] += span
                common[same] += V << k
                if k < len(levels) - 1:
                    break  # twice the block would have matched one level up
        at_a, at_b = places[order[:-1]] + common, places[order[1:]] + common
        common += self._direct(at_a, at_b, np.full(len(at_a), V))
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    @staticmethod
    def _named(columns: np.ndarray) -> np.ndarray:
        """Ranks (from 0, equal for equal) of the columns' tuples, first row first."""
        order = np.lexsort(columns[::-1])
        new = np.ones(columns.shape[1], dtype=np.int64)
        new[1:] = (columns[:, order[1:]] != columns[:, order[:-1]]).any(axis=0)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank

    def _direct(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree from places a and b on, at most ``limit`` (V or fewer)."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(limit > 0)
        top = len(self.words) - 1
        for k in range(V):
            if not len(live):
                break
            live = live[self.words[np.minimum(a[live] + k, top)] == self.words[np.minimum(b[live] + k, top)]]
            out[live] += 1
            live = live[limit[live] > k + 1]
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of words that agree from a and from b on (places differ)."""
        if not len(a):
            return np.zeros(0, dtype=np.int64)
        step = self.step[a % V, b % V]
        out = self._direct(a, b, step)
        far = np.flatnonzero(out == step)
        at_a, at_b = a[far] + step[far], b[far] + step[far]
        known = (at_a <= len(self.words) - 2 * V - 1) & (at_b <= len(self.words) - 2 * V - 1)
        far, at_a, at_b = far[known], at_a[known], at_b[known]
        x = self.rank[at_a // V * len(COVER) + self.residue_at[at_a % V]]
        y = self.rank[at_b // V * len(COVER) + self.residue_at[at_b % V]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        more = np.empty(len(far), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            more[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << int(k))])
        out[far] += more
        return out


def _grid(words: np.ndarray, lengths: np.ndarray):
    """(period, places g) for every period: grid places g of one array of documents, longest first, whose word and the two grid
    places' words after it equal the word a period further on. ``words`` ends with a separator after each document."""
    ends = np.cumsum(lengths + 1)
    period, last = 1, len(lengths)
    while last:
        last = int(np.searchsorted(-lengths, -max(LEAST, REPEATS * period), side="right"))
        if not last:
            break
        part = words[: ends[last - 1]]
        same = part[: len(part) - period : period] == part[period::period]
        if period == 1:
            hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        else:
            hits = np.flatnonzero(same[:-2])
            hits = hits[same[hits + 1] & same[hits + 2]]
        if len(hits):
            yield period, hits * period
        period += 1


def _blocks(grid, size: int = 1 << 19):
    """The grids of many periods in arrays (periods, places) of about ``size`` places, periods ascending."""
    ps, gs, total = [], [], 0
    for period, g in grid:
        ps.append(np.full(len(g), period))
        gs.append(g)
        total += len(g)
        if total >= size:
            yield np.concatenate(ps), np.concatenate(gs)
            ps, gs, total = [], [], 0
    if total:
        yield np.concatenate(ps), np.concatenate(gs)


def runs_of(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document, an array of integers 0 or more, in order of start and period."""
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= LEAST]
    if not len(order):
        return out

    def laid(which):
        """The documents in one array, a separator that equals nothing after each; their starts."""
        ends = np.cumsum(lengths[which] + 1)
        line = np.empty(ends[-1], dtype=np.int64)
        for d, end in zip(which, ends):
            line[end - 1 - lengths[d] : end - 1] = documents[d]
        line[ends - 1] = -1 - np.arange(len(which))
        return line, ends - 1 - lengths[which]

    # only documents whose grids agree somewhere need their suffixes sorted
    line, starts = laid(order)
    hit = np.zeros(len(order), dtype=bool)
    for _, g in _grid(line, lengths[order]):
        hit[np.searchsorted(starts, g, side="right") - 1] = True
    order = order[hit]
    if not len(order):
        return out
    line, starts = laid(order)
    right, left = Extensions(line), Extensions(line[::-1])
    found = set()
    for p, g in _blocks(_grid(line, lengths[order])):
        ahead = right(g, g + p)
        inside = np.zeros(len(g), dtype=bool)  # the stretch goes on from the grid place before
        inside[1:] = (p[1:] == p[:-1]) & (np.diff(g) == p[1:]) & (ahead[:-1] >= p[1:])
        first = ~inside & (ahead > 2 * p)  # at least L - p - (p - 1) words of a stretch of L >= 4p are ahead of its first place
        p, g, ahead = p[first], g[first], ahead[first]
        back = left(len(line) - g, len(line) - g - p)
        start, length = g - back, ahead + back + p
        good = length >= np.maximum(LEAST, REPEATS * p)
        for s, n, q in zip(start[good].tolist(), length[good].tolist(), p[good].tolist()):
            if (s, n) not in found:  # a smaller period has found it before
                found.add((s, n))
                d = int(np.searchsorted(starts, s, side="right")) - 1
                out[int(order[d])].append((s - int(starts[d]), n, q))
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def planted(words: list, doc_id) -> list:
    """The words of a document, with the repetition that the digest of its id asks for."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the run of greatest exponent (start, length, period, exponent_milli), and the hashes of the runs and the kept words."""
    start = length = period = milli = None
    kept = words
    if runs:
        start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        milli = 1000 * length // period
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in runs:
            drop[s + q] += 1
            drop[s + n] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mapped(docs: DataFrame, change, make, schema: str) -> DataFrame:
    """Rows that ``make(doc_id, words, runs)`` gives for each document; ``change(words, doc_id)`` alters its words before."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                ids = part.column(0).to_pylist()
                texts = part.column(1).to_pylist()
                words = [change((t or "").encode("utf-8", "surrogatepass").split(), i) for i, t in zip(ids, texts)]
                number: dict[bytes, int] = {}
                coded = [np.fromiter((number.setdefault(w, len(number)) for w in ws), dtype=np.int64, count=len(ws)) for ws in words]
                rows = [r for i, ws, rs in zip(ids, words, runs_of(coded)) for r in make(i, ws, rs)]
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096]), types)], names=names)

    types = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _as_they_are(words, _):
    return words


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period, text: a row for each run of each document, text being its first period's words."""

    def make(doc_id, words, found):
        return [(doc_id, s, n, q, b" ".join(words[s : s + q]).decode("utf-8", "surrogatepass")) for s, n, q in found]

    return _mapped(docs, _as_they_are, make, "doc_id long, start long, length long, period long, text string")


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_dropped: each document's words joined by one space, of every run only the first period."""

    def make(doc_id, words, found):
        drop = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, q in found:
            drop[s + q] += 1
            drop[s + n] -= 1
        keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
        return [(doc_id, b" ".join(words[i] for i in keep).decode("utf-8", "surrogatepass"), len(words) - len(keep))]

    return _mapped(docs, _as_they_are, make, "doc_id long, text string, n_dropped long")


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of ``digest`` for each document, with planted repetitions."""
    return _mapped(docs, planted, lambda i, words, found: [(i, *digest(words, found))], f"doc_id long, {FIELDS}")
