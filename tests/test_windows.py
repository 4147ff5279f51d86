"""Token windows with limits on spans and bytes, against a token-by-token form of the rule, and the SQL table function."""

import random

import pytest

from evispark.operators import ingest as I
from evispark.operators import windows as M


def stepwise(body, header, width, overlap, max_spans, max_bytes):
    """(first token, tokens, spans) of each window, a token at a time. ``body``, ``header``: (span, tokens, bytes)."""
    size = {s: n for s, _, n in [*body, *header]}
    of = [s for s, n, _ in body for _ in range(n)]
    room, out, start = width - sum(n for _, n, _ in header), [], 0
    while start < len(of):
        seen = list(dict.fromkeys(s for s, _, _ in header))
        end = start
        while end < len(of) and end - start < room:
            new = [] if of[end] in seen else [of[end]]
            if end > start and (len(seen) + len(new) > max_spans or sum(size[s] for s in seen + new) > max_bytes):
                break
            seen += new
            end += 1
        out.append((start, end - start, seen))
        if end == len(of):
            return out
        start = max(start + 1, end - overlap)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_mapped_windows(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    width, overlap, max_spans, max_bytes = rng.choice([(12, 3, 4, 90), (9, 0, 2, 1000), (40, 8, 64, 60), (10, 9, 3, 50)])
    for block in range(25):
        at, body, header = 0, [], []
        for k in range(rng.randint(0, 14)):
            n = rng.choice([0, 1, 1, 2, 5, 20])
            text = " - ".join(f"w{rng.randrange(99)}é" for _ in range(n)) or "--"
            is_head = k < 2 and rng.random() < 0.3 and n < 3
            span = f"s{k}" if rng.random() < 0.9 or not header else header[0][0]
            if any(s == span for s, _, _ in body):
                continue
            if span != f"s{k}":
                text = next(t for b, _, s, t, _ in rows if b == block and s == span)
                n = header[0][1]
            rows.append((block, at, span, text, is_head))
            (header if is_head else body).append((span, n, len(text.encode())))
            at += 1
        want[block] = stepwise([b for b in body if b[1]], header, width, overlap, max_spans, max_bytes)
    df = spark.createDataFrame(rows, "block int, line_no int, span_id string, text string, header boolean")
    got = {}
    for r in M.mapped_windows(df, ["block"], width, overlap, max_spans, max_bytes, least=1).orderBy("block", "win").collect():
        assert r["reason"] is None
        got.setdefault(r["block"], []).append((r["first_token"], r["n_tokens"], r["span_ids"]))
    assert got == {b: w for b, w in want.items() if w}


def test_long_headers_and_odd_lines(spark):
    rows = [(1, 0, "h", "a b c d", True), (1, 1, "x", "w " * 9, False), (2, 0, "h", "a", True), (2, 1, "x", None, False), (3, 0, "x", "one two", None), (3, 1, "big", "word" * 9000, False), (3, 2, "y", "three", False)]
    df = spark.createDataFrame(rows, "block int, line_no int, span_id string, text string, header boolean")
    got = [(r["block"], r["win"], r["n_tokens"], r["span_ids"], r["reason"]) for r in M.mapped_windows(df, ["block"], 10, 1, least=7).orderBy("block", "win").collect()]
    # a line over the byte limit is taken alone, as a window's first; the header of block 1 leaves too little
    assert got == [(1, None, None, None, "chunk_prefix_too_long"), (3, 0, 2, ["x"], None), (3, 1, 1, ["x"], None), (3, 2, 1, ["big"], None), (3, 3, 1, ["y"], None)]
    assert M.mapped_windows(df.limit(0), ["block"]).count() == 0


def test_windows_without_limits_equal_plain_ones(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n)) or None) for i, n in enumerate([0, 1, 9, 10, 11, 18, 19, 300])], "doc_id int, text string")
    want = {tuple(r) for r in I.token_windows(docs, ["doc_id"], 10, 2).collect()}
    M.register_windows(spark)
    got = spark.sql("SELECT d.doc_id, w.* FROM {d} d, LATERAL token_windows(d.text, 10, 2) w", d=docs)
    assert {tuple(r) for r in got.collect()} == want


def test_a_batch_of_blocks_is_never_python_objects_at_once(spark, monkeypatch):
    import pyarrow as pa

    lines = spark.createDataFrame([(d, i, f"{i}", "one two three " * 40) for d in range(3) for i in range(20)], "doc_id long, line_no long, span_id string, text string")
    held = {}

    def kept(self, run, schema):
        held.update(run=run, blocks=self.toArrow().combine_chunks().to_batches()[0])
        return self

    monkeypatch.setattr(type(lines), "mapInArrow", kept)
    M.mapped_windows(lines, ["doc_id"])

    class Batch:
        num_rows = held["blocks"].num_rows

        def slice(self, start, n):
            assert n == 1
            return held["blocks"].slice(start, n)

    monkeypatch.setattr(M, "AT_ONCE", 5_000)
    out = list(held["run"]([Batch()]))
    assert len(out) > 3 and max(b.num_rows for b in out) < 5  # windows are passed on as they come
    assert pa.Table.from_batches(out).group_by("doc_id").aggregate([("win", "count")]).column(1).to_pylist() == [7, 7, 7]
