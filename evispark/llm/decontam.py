"""Benchmark decontamination by latent semantic retrieval.

1. Statistics: document frequencies of the benchmark's words over all documents.
2. Factorisation: the benchmark's passages as TF-IDF rows, dealt into blocks of about ``ITEMS_IN_BLOCK`` by a hash, and a
   randomised SVD of each block as Spark jobs (a random start, power rounds G <- A'(A G) summed over partitions in fixed-point
   numbers, so that every run sums alike, a small QR after each, and the eigenvectors of what is left). As many latent directions are
   kept as there are passages, ``RANK`` at most: passages are nearly independent, so fewer would lose more of them than step 3 can spare.
3. Retrieval: every document is read in windows of its own of a power of two of words, for each item one of at least twice its
   length, each half over the next, so that a passage as long as the item lies whole in a window. A window is folded in
   (projected) and its latent cosine with each item taken; all at the cosine threshold are candidates. So are all whose product
   with the item may be what the LCS share needs: words that make up that share of an item weigh so much at least (the item's
   lightest words that suffice). The product isn't taken word by word: it is the latent product plus that of the two parts
   that the kept directions lose, which is at most the product of their lengths. So the directions decide what is checked (the
   better they fit the items, the less is lost and the fewer windows can reach an item's need), and no pair that passes in a
   window is skipped whatever they are. Windows are skipped before that where even their words that items call for weigh too
   little (items of like needs are looked at together). Term counts are taken as 0 or 1; a word outside the benchmark has the weight of a word never
   seen, which counts in cosines.
4. Checks on all candidates: longest common subsequence of the item and the text around the window (share of the item's words)
   and of the item's answer, its last third. Paraphrases pass; chance overlaps do not.

The corpus never goes to the driver. Of the benchmark a pass of ``BLOCKS_IN_PASS`` blocks does (at most about 2,048 items and 8 MB
of text, unless one item is longer); a larger benchmark takes more passes, one after another, each written to the shared folder.

Words are runs of ASCII letters and digits (lower-cased) or non-ASCII characters. Defined cases: null or empty texts have no
passages; benchmark rows with null text or fewer than ``LEAST_WORDS`` words match nothing (they would stand in clean texts, too); null ids are carried along; repeated rows each give their rows;
empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, pieces, saved

COSINE, LCS, ANSWER = 0.45, 0.6, 0.5
#: Weights are log((documents + SMOOTH) / (1 + frequency)), CAP at most: a passage that many documents share keeps its place beside rare words.
SMOOTH, CAP = 1000, 6.0
#: Items of fewer words aren't searched for.
LEAST_WORDS = 5
RANK, ITEMS_IN_BLOCK, BYTES_IN_BLOCK, BLOCKS_IN_PASS, POWER = 320, 256, 1 << 20, 8, 2
WORDS_AT_ONCE, LEVELS = 1 << 15, 1
#: The share of an item's places whose rarest words tell which windows are looked at; any share above 1 - LCS skips without loss.
RARE = 0.7
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def masks(a: list) -> dict:
    """The places of each word of ``a``, as bits."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    return at


def lcs(at: dict, n: int, b: list, need: int = 0) -> int:
    """Length of the longest common subsequence of ``b`` and ``n`` words with the given masks (bit-parallel); 0 if too few words are shared for ``need``."""
    hits = [hit for hit in map(at.get, b) if hit]
    if len(hits) < need:
        return 0
    row = full = (1 << n) - 1
    for hit in hits:
        both = row & hit
        row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """(documents, frequency of each vocabulary word)."""

    def run(batches):
        known, n, seen = set(vocabulary), 0, {}
        for b in batches:
            for t in b.column(0):
                n += 1
                for w in known.intersection(words_of(t.as_py())):
                    seen[w] = seen.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["w", "n"])

    rows = docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["w"]): r["n"] for r in rows}
    return df.pop(b"", 0), df


def latent_directions(passages: DataFrame, idf: dict[bytes, float], rank: int, power: int = POWER) -> tuple[list[bytes], np.ndarray]:
    """(words, directions (words, rank)): distributed randomised SVD of TF-IDF passages (item_id, text), each of length 1."""
    words = sorted(idf)
    where = {w: i for i, w in enumerate(words)}
    weight = np.array([idf[w] for w in words])
    rows = passages.repartition(4, "item_id", "text").sortWithinPartitions("item_id", "text").select("text")

    def times(g: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros_like(g)
            for b in batches:
                for t in b.column(0):
                    ws = words_of(t.as_py())
                    if len(ws) >= LEAST_WORDS:
                        at = np.unique([where[w] for w in ws])
                        x = weight[at]
                        x = x / np.linalg.norm(x)
                        total[at] += np.outer(x, x @ g[at])
            used = np.nonzero(total.any(axis=1))[0]
            fixed = np.round(total[used] * (1 << 40)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(fixed), pa.list_(pa.int64()))], names=["w", "row"])

        parts = rows.mapInArrow(run, "w long, row array<long>")
        summed = parts.select("w", F.posexplode("row")).groupBy("w", "pos").agg(F.sum("col").alias("v")).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("r"))
        out = np.zeros_like(g)
        for r in summed.select("w", F.col("r.v").alias("v")).collect():
            out[r["w"]] = np.array(r["v"], np.float64) / (1 << 40)
        return out

    sketch = min(rank + rank // 4 + 16, len(words))
    g = np.linalg.qr(np.random.default_rng(11).standard_normal((len(words), sketch)))[0]
    for _ in range(power):
        g = np.linalg.qr(times(g))[0]
    # the best directions within the sketch
    values, turn = np.linalg.eigh(g.T @ times(g))
    return words, g @ turn[:, np.argsort(-values)[:rank]]


def _passes(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's passes: item_id, text, block."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    size = b.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["n"] // ITEMS_IN_BLOCK), -(-size["bytes"] // BYTES_IN_BLOCK))
    b = b.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    return [b.where(F.col("block").between(at, at + BLOCKS_IN_PASS - 1)) for at in range(0, blocks, BLOCKS_IN_PASS)]


def _model(docs: DataFrame, part: DataFrame, rank: int | None = None) -> dict | None:
    """One pass: the items, their words' weights, and the latent models of its blocks."""
    rows = [(r["block"], r["item_id"], words_of(r["text"])) for r in part.collect()]
    rows = sorted((r for r in rows if len(r[2]) >= LEAST_WORDS), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    if not rows:
        return None
    n, df = document_frequencies(docs, sorted({w for *_, ws in rows for w in ws}))
    idf = lambda w: min(CAP, math.log((n + SMOOTH) / (1 + df.get(w, 0))) + 0.1)
    weights, latent = {w: idf(w) for *_, ws in rows for w in ws}, []
    for number in sorted({r[0] for r in rows}):
        own = [k for k, r in enumerate(rows) if r[0] == number]
        mine = {w: weights[w] for k in own for w in rows[k][2]}
        words, v = latent_directions(part.where(F.col("block") == number), mine, rank or min(RANK, len(own)))
        latent.append((np.array(own), words, *fitted([rows[k][2] for k in own], words, mine, v)))
    return {"items": [(i, ws) for _, i, ws in rows], "weights": weights, "latent": latent, "other": idf(b"")}


def fitted(items: list[list[bytes]], words: list[bytes], weights: dict[bytes, float], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, latent coordinates of the items, which count as of length 1)."""
    place = {w: i for i, w in enumerate(words)}
    coordinates = []
    for ws in items:
        i = np.unique([place[w] for w in ws])
        x = np.array([weights[words[j]] for j in i])
        coordinates.append((x @ v[i]) / np.linalg.norm(x))
    return v.astype(np.float32), np.array(coordinates, np.float32)


def least_weight(counts: list[int], squares: list[float], need: float) -> float:
    """The least that distinct words standing at ``need`` places of an item weigh together (words may be taken in part: a lower bound)."""
    total = 0.0
    for c, q in sorted(zip(counts, squares), key=lambda x: x[1] / x[0]):
        if need <= 0:
            break
        total += q * min(1.0, need / c)
        need -= c
    return total if need <= 0 else math.inf


class Matcher:
    """Finds the items of a pass in documents."""

    def __init__(self, model: dict, cosine: float, share: float, answer: float):
        self.items, self.limits = model["items"], (cosine, share, answer)
        vocabulary = list(model["weights"])
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.weight = np.array([*model["weights"].values(), model["other"]], np.float32)  # the last is for any other word
        self.other = len(vocabulary)
        self.square = self.weight.astype(np.float64) ** 2
        self.width = np.array([1 << max(4, math.ceil(math.log2(2 * len(ws)))) for _, ws in self.items])
        self.floor, rare_floor, rarest = np.zeros(len(self.items)), np.zeros(len(self.items)), []
        for k, (_, ws) in enumerate(self.items):
            need = math.ceil(share * len(ws) - 1e-9)
            count = Counter(self.number[w] for w in ws)
            self.floor[k] = least_weight(list(count.values()), [self.square[w] for w in count], need)
            # rarest words at RARE of the item's places: what the LCS lacks without them, they must bring
            rare, places = [], 0
            for w in sorted(count, key=lambda w: (-self.square[w], w)):
                if places >= max(RARE, 1.1 - share) * len(ws):
                    break
                rare.append(w)
                places += count[w]
            rare_floor[k] = least_weight([count[w] for w in rare], [self.square[w] for w in rare], need - (len(ws) - places))
            rarest.append(rare)
        # items of one width that need about as much are looked at together: (width, floor, words called for, latent tables)
        level = np.floor(np.log2(np.maximum(rare_floor, 1e-3)) * LEVELS).astype(int)
        self.groups = []
        for width, lv in sorted(set(zip(self.width.tolist(), level.tolist()))):
            members = np.nonzero((self.width == width) & (level == lv))[0]
            called = np.zeros(self.other + 1, bool)
            for k in members:
                called[rarest[k]] = True
            self.groups.append((width, rare_floor[members].min(), called, []))
        self.ever = np.logical_or.reduce([g[2] for g in self.groups])
        self.masks = [(masks([self.number[w] for w in ws]), masks([self.number[w] for w in ws[-max(1, -(-len(ws) // 3)) :]])) for _, ws in self.items]
        self.checked = 0  # candidates that went to the checks
        for own, words, v, coordinates in model["latent"]:
            inside = np.zeros((self.other + 1, 1), np.float32)  # squares of the words that the directions know
            inside[[self.number[w] for w in words], 0] = self.square[[self.number[w] for w in words]]
            lost = np.sqrt(np.maximum(0.0, 1.0 - (coordinates.astype(np.float64) ** 2).sum(axis=1)))  # what the directions lose of an item of length 1
            length = np.array([math.sqrt(self.square[list(self.masks[k][0])].sum()) for k in own])
            table = np.zeros((self.other + 1, v.shape[1]), np.float32)
            table[[self.number[w] for w in words]] = v * np.array([model["weights"][w] for w in words], np.float32)[:, None]
            table = np.hstack([table, inside])
            at = {k: j for j, k in enumerate(own)}
            for group, (width, lv) in zip(self.groups, sorted(set(zip(self.width.tolist(), level.tolist())))):
                mine = np.array([k for k in own if self.width[k] == width and level[k] == lv], int)
                if len(mine):
                    some = [at[k] for k in mine]
                    group[3].append((mine, table, coordinates[some], lost[some], length[some]))

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its (item_id, cosine, lcs, answer), best for each item."""
        docs = [words_of(t) for t in texts]
        lengths = np.array([len(d) for d in docs])
        found: list[dict] = [{} for _ in docs]
        n = int(lengths.sum())
        if n:
            ids = np.fromiter(map(self.number.get, chain.from_iterable(docs), repeat(self.other)), np.int32, n)
            del docs
            starts = np.concatenate([[0], np.cumsum(lengths)])
            places = np.nonzero(self.ever[ids])[0]  # words that any item calls for
            word, owner = ids[places], np.searchsorted(starts, places, side="right") - 1
            weight, inside = self.square[word], places - starts[owner]
            for width, rare_floor, called, latent in self.groups:
                step = width // 2
                windows = np.maximum(1, -(-(lengths - width) // step) + 1) * (lengths > 0)
                first = np.concatenate([[0], np.cumsum(windows)])
                mine = called[word]
                d, half, w = owner[mine], inside[mine] // step, weight[mine]
                # a half belongs to the window that it begins and to the one before; repeats count once in a window's vector, so this is at least what it holds
                left, right = half < windows[d], half > 0
                held = np.bincount((first[d] + half)[left], w[left], first[-1]) + np.bincount((first[d] + half - 1)[right], w[right], first[-1])
                at = np.nonzero(held >= rare_floor * (1 - 1e-6))[0]
                doc = np.searchsorted(first, at, side="right") - 1
                begins = starts[doc] + step * (at - first[doc])
                ends = np.minimum(begins + width, starts[doc + 1])
                parts = -(-len(at) * width // WORDS_AT_ONCE)
                for part in np.array_split(np.arange(len(at)), parts) if parts else []:
                    self._search(ids, starts, doc[part], begins[part], ends[part], width, latent, found)
        return [[(self.items[k][0], *v) for k, v in sorted(f.items())] for f in found]

    def _search(self, ids, starts, doc, begins, ends, width, latent, found):
        places = begins[:, None] + np.arange(width)
        rows = np.where(places < ends[:, None], ids[np.minimum(places, len(ids) - 1)], -1)
        spare = (rows == self.other).sum(axis=1) * self.square[-1]  # other words are taken as distinct
        rows.sort(axis=1)
        fresh = (rows >= 0) & (rows != self.other)
        fresh[:, 1:] &= rows[:, 1:] != rows[:, :-1]
        counts = fresh.sum(axis=1)
        flat, first = rows[fresh], np.cumsum(counts) - counts
        norm = np.sqrt(np.add.reduceat(self.square[flat], first) + spare)
        for own, table, coordinates, lost, length in latent:
            folded = np.add.reduceat(table[flat], first, axis=0)
            z, known = folded[:, :-1], folded[:, -1]  # latent coordinates, and the square of the length of what the directions know
            rest = np.sqrt(np.maximum(0.0, known - (z * z).sum(axis=1)))
            product = z @ coordinates.T
            bound = (product + rest[:, None] * lost) * length
            i, j = np.nonzero((product >= (self.limits[0] - 1e-3) * norm[:, None]) | (bound >= self.floor[own] * (1 - 2e-3)))
            # a matrix product may round by its shape: what it lets through is decided pair by pair, so that every partitioning decides alike
            exact = (z[i].astype(np.float64) * coordinates[j]).sum(axis=1)
            cos, bound = exact / norm[i], (exact + rest[i] * lost[j]) * length[j]
            for at in np.nonzero((cos >= self.limits[0]) | (bound >= self.floor[own[j]] * (1 - 1e-3)))[0]:
                self._check(ids, starts, int(doc[i[at]]), int(begins[i[at]]), int(ends[i[at]]), int(own[j[at]]), float(cos[at]), found)

    def _check(self, ids, starts, d, begin, end, k, cos, found):
        self.checked += 1
        (item, tail), m = self.masks[k], len(self.items[k][1])
        words = ids[max(begin - m, starts[d]) : min(end + m, starts[d + 1])].tolist()
        share = lcs(item, m, words, math.ceil(self.limits[1] * m - 1e-9)) / m
        if share < self.limits[1]:
            return
        n = max(1, -(-m // 3))
        answer = lcs(tail, n, words) / n
        if answer >= self.limits[2]:
            found[d][k] = max(found[d].get(k, (0.0, 0.0, 0.0)), (round(cos, 6), round(share, 6), round(answer, 6)), key=lambda v: (v[1], v[0]))


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = LCS, answer: float = ANSWER, rank: int | None = None) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: a row for each document and benchmark item found in it."""
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    parts = _passes(benchmark)
    for part in parts:
        if model := _model(docs, part, rank):
            found = rows.mapInArrow(_finder(model, (cosine, share, answer)), schema)
            out.append(found if len(parts) == 1 else saved(found, "found"))
    return reduce(DataFrame.unionAll, out) if out else docs.sparkSession.createDataFrame([], schema)


def _finder(model: dict, limits: tuple):
    def run(batches):
        matcher = Matcher(model, *limits)
        for b in batches:
            for part in pieces(b, 1):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [(i, *hit) for i, hits in zip(ids, matcher.find(texts)) for hit in hits]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = LCS, answer: float = ANSWER, rank: int | None = None) -> DataFrame:
    """Documents in which no benchmark item was found, columns kept. Each pass works on what the one before it left."""
    parts, left = _passes(benchmark), docs
    for part in parts:
        if model := _model(docs, part, rank):
            left = filter_rows(left, _clean(model, (cosine, share, answer)))
            left = left if len(parts) == 1 else saved(left, "clean")
    return left


def _clean(model: dict, limits: tuple):
    def predicate():
        matcher = Matcher(model, *limits)
        return lambda texts: [not hits for hits in matcher.find(texts)]

    return predicate
