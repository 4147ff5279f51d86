"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of ``books`` code words, one of each full-dimensional codebook. Codebooks are trained in turn by
k-means on the residuals of a bounded sample (``sample`` vectors, the smallest hashes of ids). Every vector is encoded by a
beam search over the codebooks; its code and the norm of its reconstruction are stored. A query's inner products with all
code words make a lookup table; table sums over codes, divided by stored norms, score all vectors in blocks, and the best
``keep`` of each query are reranked by exact cosine in double precision, which the tasks add while code and vector are at hand. Table scores count to ``PLACES`` decimals: among
vectors that the codes can't tell apart so (many near copies, say), the exact cosine decides who is kept, whatever their number.

Codes stay where they are: a batch of ``QUERIES_AT_ONCE`` queries at most goes to all tasks, each streams its codes past it and
holds each query's best so far, and only those are shuffled. More queries take more passes, whose finds are written out.

Vectors are scaled by a power of two first, which loses nothing, so that squares of very large or small components neither
overflow nor vanish.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with null vec_id or a
dimension other than the most common one (their cosine with the others has no meaning); rows that repeat a vec_id each count, as queries and as candidates (of each other, too); fewer candidates than asked for are all returned; ties go to
the smaller vec_id; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, scratch_dir

BOOKS, WORDS, BEAM, SAMPLE, KEEP, ROUNDS, PLACES = 16, 256, 4, 10_000, 300, 8, 2
CODES_IN_BLOCK, QUERIES_AT_ONCE = 4096, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, x (array of double, scaled to components of 2 at most): the vectors that take part, every row under a number of its
    own (which holds once the rows are written), so that rows that share a vec_id all count."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    x = x.where(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))).where(F.exists("x", lambda v: v != 0.0))
    largest = F.array_max(F.transform("x", lambda v: F.abs(v)))
    scale = F.array(F.pow(F.lit(2.0), F.floor(F.log2(largest)).cast("double")))  # as a lambda's variable, it is worked out once a vector
    x = x.select("vec_id", F.get(F.transform(scale, lambda s: F.transform("x", lambda v: v / s)), 0).alias("x"))
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return x.where(F.size("x") == (common["d"] if common else 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "x")


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (books, words, d), each by k-means on what the ones before it leave."""
    rest, out = sample.astype(np.float32), []
    draw = np.random.default_rng(5)
    for _ in range(books):
        k = min(words, len(rest))
        c = rest[draw.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)
            n = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            full = n > 0
            c[full] = np.add.reduceat(rest[order], starts[full], axis=0) / n[full, None]
        near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)
        rest = rest - c[near]
        out.append(np.concatenate([c, np.zeros((words - k, c.shape[1]), np.float32)]))
    return np.stack(out)


def _least(flat: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k smallest values (``flat`` is overwritten): k scans are cheaper than sorting for a small k."""
    rows, out = np.arange(len(flat)), np.empty((len(flat), k), np.int64)
    for i in range(k):
        out[:, i] = flat.argmin(axis=1)
        flat[rows, out[:, i]] = np.inf
    return out


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes (n, books) uint8, norms of the reconstructions), by beam search."""
    n, d = x.shape
    rest, codes, loss = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8), None
    for c in codebooks:
        b = rest.shape[1]
        cost = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ c.T).reshape(n, b, -1) + (c * c).sum(1)
        flat = cost.reshape(n, -1)
        best = _least(flat.copy(), min(beam, flat.shape[1]))
        from_, word = best // len(c), best % len(c)
        rest = np.take_along_axis(rest, from_[:, :, None], 1) - c[word]
        codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        loss = np.take_along_axis(flat, best, 1)
    win = loss.argmin(1)
    codes = codes[np.arange(n), win]
    whole = sum(codebooks[m][codes[:, m]] for m in range(len(codebooks)))
    return codes, np.linalg.norm(whole, axis=1).astype(np.float32)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def encoded(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """row, vec_id, code (binary), norm, x (the vector itself, to tell ties apart)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                codes, norms = encode(_units(_matrix(part.column(2))), codebooks)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.maximum(norms, 1e-9)), part.column(2)], names=["row", "vec_id", "code", "norm", "x"])

    return vectors.select("row", "vec_id", "x").mapInArrow(run, "row long, vec_id long, code binary, norm float, x array<double>")


def _top(rough: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best and of all that tie with the last of them."""
    return np.nonzero(rough >= np.partition(rough, len(rough) - keep)[len(rough) - keep])[0] if len(rough) > keep else np.arange(len(rough))


def _better(held: tuple, more: tuple, keep: int) -> tuple:
    """(rows, ids, rough, exact) of the ``keep`` best of both, by rough score, then exact score, then smaller id."""
    rows, ids, rough, exact = (np.concatenate(c) for c in zip(held, more))
    order = np.lexsort((rows, ids, -exact, -rough))[:keep]
    return rows[order], ids[order], rough[order], exact[order]


def candidates(codes: DataFrame, queries: DataFrame, codebooks: np.ndarray, keep: int = KEEP) -> DataFrame:
    """query, query_id, vec_id, score (query: the row of it): the ``keep`` best by table scores of each query over all codes, with exact scores."""
    passes = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    path = f"{scratch_dir(codes.sparkSession)}/candidates-{uuid.uuid4().hex}"
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("rough"), F.desc("exact"), "vec_id", "row"))
    for at in range(passes):
        batch = queries.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(passes)) == at).select("row", "vec_id", "x").collect() if passes > 1 else queries.select("row", "vec_id", "x").collect()
        for part in range(0, len(batch), 2 * QUERIES_AT_ONCE):  # a hash deals evenly; were it not to, this bounds what goes out
            some = sorted(batch[part : part + 2 * QUERIES_AT_ONCE])
            rows = codes.mapInArrow(_scan([(r["row"], r["vec_id"]) for r in some], np.array([r["x"] for r in some]), codebooks, keep), "query long, query_id long, row long, vec_id long, rough float, exact double").where("query != row")
            best = rows.withColumn("n", place).where(F.col("n") <= keep).select("query", "query_id", "vec_id", F.col("exact").alias("score"))
            if passes == 1 and len(batch) <= 2 * QUERIES_AT_ONCE:
                return best
            best.write.mode("append").parquet(path)
    schema = "query long, query_id long, vec_id long, score double"
    return codes.sparkSession.read.schema(schema).parquet(path) if passes > 1 else codes.sparkSession.createDataFrame([], schema)


def _scan(queries: list[tuple[int, int]], vectors: np.ndarray, codebooks: np.ndarray, keep: int):
    books = len(codebooks)

    def run(batches):
        unit = _units(vectors)
        tables = np.einsum("qd,mkd->mkq", unit.astype(np.float32), codebooks)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0))] * len(unit)
        floor = np.full(len(unit), -np.inf, np.float32)
        held: list = []

        def take() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            rows, ids = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
            x = _units(_matrix(table.column("x").combine_chunks()))
            code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, books)
            score = np.zeros((len(ids), len(unit)), np.float32)
            for m in range(books):
                score += tables[m][code[:, m]]
            score = np.round(score / table.column("norm").to_numpy()[:, None], PLACES).T
            for k in np.nonzero((score >= floor[:, None]).any(axis=1))[0]:
                some = np.nonzero(score[k] >= floor[k])[0]
                some = some[_top(score[k][some], keep + 1)]
                # summed row by row, so that equal vectors get equal values and tie
                exact = (x[some] * unit[k]).sum(axis=1)
                best[k] = _better(best[k], (rows[some], ids[some], score[k][some], exact), keep + 1)
                if len(best[k][0]) > keep:
                    floor[k] = best[k][2][-1]

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CODES_IN_BLOCK:
                take()
        if sum(x.num_rows for x in held):
            take()
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            columns = [*(np.repeat(np.array(c, np.int64), sizes) for c in zip(*queries)), *(np.concatenate(c) for c in zip(*best))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "query_id", "row", "vec_id", "rough", "exact"])

    return run


def search(vectors: DataFrame, is_query, k: int = 5, books: int = BOOKS, sample: int = SAMPLE, keep: int = KEEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each usable vector for which ``is_query`` (a column of vec_id) holds."""
    spark = vectors.sparkSession
    x = saved(usable(vectors), "vectors")
    fit = np.array([r["x"] for r in x.orderBy(F.xxhash64("vec_id", "x"), "row").limit(sample).select("x").collect()], dtype=np.float64)
    if not len(fit):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codebooks = train(_units(fit), books)
    codes = saved(encoded(x, codebooks), "codes")
    scored = candidates(codes, x.where(is_query), codebooks, keep)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
