"""Token windows that know their spans: limits on the spans and source bytes behind a window, and a table function for SQL.

Tokens never cross lines, so each token has one span, and a window's end follows from running sums over the lines: the width in
tokens, the first line that would bring a span too many, or the first that would bring too many bytes, whichever comes first. The
next window begins ``overlap`` tokens before that end, so its place depends on all windows before it; the fold runs over a block's
lines inside a task.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from .ingest import LEAST_BODY, OVERLAP, WIDTH

MAX_SPANS, MAX_BYTES = 64, 16_384
TOO_LONG = "chunk_prefix_too_long"
#: Characters of windows that a task holds before it passes them on.
AT_ONCE = 4_000_000


def bounds(counts: list[int], sizes: list[int], width: int, overlap: int, spans_left: int, bytes_left: int, known: list[bool] | None = None):
    """(first token, end, first line, last line) of each window over lines of ``counts`` tokens (1 or more) and ``sizes`` bytes.

    ``spans_left`` and ``bytes_left`` are what headers leave of the limits; lines that are ``known`` (a header's span) cost nothing.
    A window's first token is always taken, but no other where headers and its line are over a limit already.
    """
    known = known or [False] * len(counts)
    upto = [0, *accumulate(counts)]  # tokens before each line
    cost = [0, *accumulate(0 if k else 1 for k in known)]
    weight = [0, *accumulate(0 if k else n for k, n in zip(known, sizes))]
    start, total = 0, upto[-1]
    while start < total:
        first = bisect_right(upto, start) - 1
        # the last line that still keeps within both limits (sums never fall), the first line at least
        within = min(bisect_right(cost, cost[first] + spans_left), bisect_right(weight, weight[first] + bytes_left)) - 2
        end = min(start + width, upto[within + 1], total) if within >= first else start + 1
        yield start, end, first, bisect_right(upto, end - 1) - 1
        if end == total:
            return
        start = max(start + 1, end - overlap)


def mapped_windows(lines: DataFrame, keys: list[str], width: int = WIDTH, overlap: int = OVERLAP, max_spans: int = MAX_SPANS, max_bytes: int = MAX_BYTES, least: int = LEAST_BODY) -> DataFrame:
    """keys, win, first_token, n_tokens, text, span_ids, reason: the windows of each block of lines.

    ``lines``: keys, ``line_no`` (order), ``span_id`` (string), ``text``, and ``header`` (boolean) where lines are repeated before every window:
    their tokens are taken off the width, their spans come first and count towards the limits. A header that leaves fewer than
    ``least`` tokens gives one row without a window that says so. Blocks without body tokens give no row; lines without tokens
    are no window's source. Blocks are gathered whole: they are regions of one document.
    """
    head = F.col("header") if "header" in lines.columns else F.lit(False)
    row = F.struct("line_no", F.coalesce(head, F.lit(False)).alias("header"), F.col("span_id").cast("string").alias("span_id"), tokens_of("text").alias("toks"), F.octet_length("text").alias("n_bytes"))
    blocks = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("lines"))
    given = [f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*given, "win long, first_token long, n_tokens long, text string, span_ids array<string>, reason string"])

    def one(block: list[dict]):
        heads, body = [x for x in block if x["header"]], [x for x in block if not x["header"] and x["toks"]]
        head_tokens = [t for x in heads for t in x["toks"]]
        head_spans = list(dict.fromkeys(x["span_id"] for x in heads))
        sizes = {x["span_id"]: x["n_bytes"] for x in block}
        room = width - len(head_tokens)
        if room < least:
            return [(None, None, None, None, None, TOO_LONG)]
        toks = [t for x in body for t in x["toks"]]
        spent = sum(sizes[s] for s in head_spans)
        found = bounds([len(x["toks"]) for x in body], [x["n_bytes"] for x in body], room, overlap, max_spans - len(head_spans), max_bytes - spent, [x["span_id"] in head_spans for x in body])
        return ((i, a, z - a, " ".join(head_tokens + toks[a:z]), list(dict.fromkeys([*head_spans, *(x["span_id"] for x in body[f : t + 1])])), None) for i, (a, z, f, t) in enumerate(found))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(made)
        shown = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        for b in batches:
            out, held = [], 0
            for i in range(b.num_rows):  # one block at a time as Python objects, however many lie in a batch
                [row] = b.slice(i, 1).to_pylist()
                for w in one(row["lines"]):
                    out.append(tuple(row[k] for k in keys) + w)
                    held += len(w[3] or "")
                    if held > AT_ONCE:
                        yield shown(out)
                        out, held = [], 0
            if out:
                yield shown(out)

    made = lines.sparkSession.createDataFrame([], schema).schema
    return blocks.mapInArrow(run, schema)


def tokens_of(column: str):
    """Tokens as they are written (case kept); none of a null."""
    return F.coalesce(F.regexp_extract_all(F.col(column), F.lit(f"({TOKEN})"), 1), F.array().cast("array<string>"))


def register_windows(spark: SparkSession, name: str = "token_windows") -> None:
    """A table function for SQL: ``SELECT ... FROM docs, LATERAL token_windows(text, 384, 32)`` gives win, first_token, n_tokens, text."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="win long, first_token long, n_tokens long, text string")
    class Windows:
        def eval(self, text: str, width: int, overlap: int):
            import regex

            toks = regex.findall(TOKEN, text or "")
            for i, (a, z, _, _) in enumerate(bounds([len(toks)] if toks else [], [0], width, overlap, 1, 0)):
                yield i, a, z - a, " ".join(toks[a:z])

    spark.udtf.register(name, Windows)


