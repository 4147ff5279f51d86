"""From documents to spans, fragments, blocks and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BREAKS, TOKEN, byte_prefix, stripped

MAX_LINES, MAX_LINE_BYTES, FRAGMENT_BYTES = 200_000, 65_536, 4_096
FIXED_BYTES, STRUCTURAL_BYTES = 1_200, 1_800
WIDTH, OVERLAP, LEAST_BODY = 384, 32, 64


def line_spans(docs: DataFrame) -> DataFrame:
    """doc_id, source, line_no, text, section: a row for each line that isn't blank, with the last ``#`` heading."""
    raw = docs.select("doc_id", "source", F.posexplode(F.split(F.regexp_replace("text", "^\\x{FEFF}", ""), BREAKS)).alias("pos", "raw"))
    lines = raw.select("doc_id", "source", (F.col("pos") + 1).alias("line_no"), stripped(F.col("raw")).alias("text")).where("text != ''")
    heading = F.when(F.col("text").startswith("#"), F.left(stripped(F.regexp_replace("text", "^[# ]+", "")), F.lit(200)))
    upto = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(upto), F.lit("")))


def reject_oversize(docs: DataFrame, max_lines: int = MAX_LINES, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """doc_id, n_lines, longest, reason (null if accepted): a violation rejects the whole file."""
    lines = F.split("text", BREAKS)
    longest = F.array_max(F.transform(lines, lambda t: F.octet_length(t)))
    empty = ~F.exists(lines, lambda t: stripped(t) != "")
    reason = F.when(F.size(lines) > max_lines, "too_many_lines").when(longest > max_bytes, "line_too_long").when(empty, "no_text")
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_lines"), longest.cast("long").alias("longest"), reason.alias("reason"))


def with_ordinal(spans: DataFrame) -> DataFrame:
    """Span ordinal per source by page (nulls first), line, piece."""
    keys = [F.col(c).asc_nulls_first() for c in ("page", "line_no", "piece") if c in spans.columns]
    return spans.withColumn("ordinal", F.row_number().over(W.partitionBy("doc_id").orderBy(*keys)))


def text_pieces(text: Column, limit: int) -> Column:
    """A text as an array of pieces of at most ``limit`` (4 or more) UTF-8 bytes: as many whole characters as fit, shortened to end
    after a blank or tab if one of them begins in the second half."""
    start = F.struct(F.coalesce(text, F.lit("")).alias("rest"), F.array().cast("array<string>").alias("pieces"))
    most = F.ceil(F.octet_length(text) / (limit // 2)) + 1  # every piece but the last is longer than half the limit

    def step(state, _):
        head = byte_prefix(state["rest"], limit)
        upto = F.regexp_extract(head, r"(?s)^(.*[ \t])", 1)
        piece = F.when(F.octet_length(state["rest"]) <= limit, state["rest"]).when(F.octet_length(upto) > limit // 2, upto).otherwise(head)
        more = F.struct(F.substring(state["rest"], F.length(piece) + 1, F.length(state["rest"])).alias("rest"), F.concat(state["pieces"], F.array(piece)).alias("pieces"))
        return F.when(state["rest"] == "", state).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), most), start, step, lambda state: state["pieces"])


def fragment_spans(spans: DataFrame, limit: int = FRAGMENT_BYTES) -> DataFrame:
    """Adds piece and cuts spans over ``limit`` UTF-8 bytes into the pieces that :func:`text_pieces` makes."""
    narrow = spans.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "section", "text")
    long = F.octet_length("text") > limit
    cut = narrow.where(long).select("doc_id", "line_no", "section", F.posexplode(text_pieces(F.col("text"), limit)).alias("piece", "text"))
    return with_ordinal(narrow.where(~long).select("doc_id", "line_no", "section", F.lit(0).alias("piece"), "text").unionByName(cut))


def regions(spans: DataFrame) -> DataFrame:
    """Adds region: a number that rises where the section changes (gaps and islands)."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    changed = F.when(F.lag("section").over(w).eqNullSafe(F.col("section")), 0).otherwise(1)
    return spans.withColumn("changed", changed).withColumn("region", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("changed")


def pack_blocks(spans: DataFrame, limit: int, by_section: bool, texts: bool = False) -> DataFrame:
    """doc_id, region, block, first_line, last_line, n_spans, n_bytes: greedy blocks within each region; a span costs its bytes + 1.
    ``texts`` adds text, a block's lines.

    A document's lines lie in one partition in order; a task goes over them once and holds the open block alone, so neither many
    small documents nor one of many lines cost more than their lines.
    """
    r = regions(spans) if by_section else spans.withColumn("region", F.lit(1))
    rows = r.select("doc_id", F.col("region").cast("long").alias("region"), F.col("line_no").cast("long").alias("line_no"), F.octet_length("text").cast("long").alias("n"), *(["text"] if texts else []))
    schema = "doc_id long, region long, block long, first_line long, last_line long, n_spans long, n_bytes long" + (", text string" if texts else "")

    def fold(batches):
        import pyarrow as pa

        types = [pa.int64()] * 7 + [pa.string()] * texts
        names = [c.split()[0] for c in schema.split(", ")]
        done, held, key, block, first, last, size = [], [], None, 0, 0, 0, 0
        count = 0

        def close():
            if count:
                done.append((*key, block, first, last, count, size, "\n".join(held))[: len(names)])

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
            done.clear()
            return out

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for i, (doc, region, line, n) in enumerate(zip(*columns[:4])):
                if (doc, region) != key or size + n + 1 > limit:
                    close()
                    block = block + 1 if (doc, region) == key else 1
                    key, first, count, size, held = (doc, region), line, 0, 0, []
                last, count, size = line, count + 1, size + n + 1
                if texts:
                    held.append(columns[4][i])
            if done:
                yield flushed()
        close()
        if done:
            yield flushed()

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "region", "line_no").mapInArrow(fold, schema)


def token_windows(blocks: DataFrame, keys: list[str], width: int = WIDTH, overlap: int = OVERLAP) -> DataFrame:
    """keys, win, first_token, n_tokens, text: windows of ``width`` tokens, ``overlap`` shared with the one before; none without tokens."""
    stride = width - overlap
    t = blocks.withColumn("toks", F.regexp_extract_all("text", F.lit(f"({TOKEN})"), 1)).where(F.size("toks") > 0)
    last = F.ceil(F.greatest(F.size("toks") - width, F.lit(0)) / stride)
    x = t.select(*keys, "toks", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("win"))
    part = F.slice("toks", (F.col("win") * stride + 1).cast("int"), F.lit(width))
    return x.select(*keys, "win", (F.col("win") * stride).alias("first_token"), F.size(part).cast("long").alias("n_tokens"), F.array_join(part, " ").alias("text"))


def headed_windows(blocks: DataFrame, keys: list[str], header: str, width: int = WIDTH, overlap: int = OVERLAP, least: int = LEAST_BODY) -> DataFrame:
    """keys, win, first_token, n_tokens, text, reason: windows that repeat the block's header, whose tokens are taken off the width.

    A header that leaves fewer than ``least`` tokens to the body gives one row without a window, whose reason says so; a null
    header has no tokens; a block without body tokens gives no row.
    """
    toks = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(f"({TOKEN})"), 1)
    t = blocks.select(*keys, toks(header).alias("_head"), toks("text").alias("_toks")).where(F.size("_toks") > 0)
    t = t.withColumn("_body", F.lit(width) - F.size("_head"))
    fits, stride = F.col("_body") >= least, F.col("_body") - overlap
    last = F.ceil(F.greatest(F.size("_toks") - F.col("_body"), F.lit(0)) / stride)
    x = t.withColumn("win", F.explode(F.when(fits, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array(F.lit(None).cast("long")))))
    first = F.col("win") * stride
    part = F.slice("_toks", (first + 1).cast("int"), F.col("_body"))
    text = F.array_join(F.concat("_head", part), " ")
    return x.select(*keys, "win", first.alias("first_token"), F.when(fits, F.size(part)).cast("long").alias("n_tokens"), F.when(fits, text).alias("text"), F.when(~fits, "chunk_prefix_too_long").alias("reason"))


def line_classes(spans: DataFrame) -> DataFrame:
    """Adds kind: identity (stand-alone header), heading, row (table) or prose, by the rules of structural chunking."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    table = F.col("text").contains("|") | F.col("text").contains("\t")
    fields = F.transform(F.split(F.replace(F.lower("text"), F.lit("\t"), F.lit("|")), r"\|"), lambda f: F.trim(f))
    explicit = F.exists(fields, lambda f: f.isin("patient", "subject") | f.startswith("patient:") | f.startswith("subject:"))
    before, after = F.lag("section").over(w), F.lead("text").over(w)
    first = F.lag("line_no").over(w).isNull()
    x = spans.withColumn("before", before).withColumn("first", first).withColumn("after", after)
    identity = table & (F.length("text") <= 200) & (F.col("first") | (F.col("before") != F.col("section")) | explicit) & F.col("after").isNotNull() & ~(F.col("after").contains("|") | F.col("after").contains("\t"))
    upper = (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))
    heading = ~table & ((F.col("text").startswith("#") & (F.length("text") < 200)) | (F.col("text").endswith(":") & (F.length("text") < 200)) | (upper & (F.length("text") < 120)))
    return x.withColumn("kind", F.when(identity, "identity").when(heading, "heading").when(table, "row").otherwise("prose")).drop("before", "first", "after")


def structural_context(spans: DataFrame) -> DataFrame:
    """Lines with the headers they are chunked under: document_header, section_header, table_header (line numbers), run (prose run).

    An identity row resets the other two, a heading resets the table, and a table's first row is its header.
    """
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    x = line_classes(spans)
    at = lambda kind: F.when(F.col("kind") == kind, F.col("line_no"))
    x = x.withColumn("document_header", F.last(at("identity"), True).over(w)).withColumn("heading", F.last(at("heading"), True).over(w))
    x = x.withColumn("section_header", F.when(F.col("heading") > F.coalesce("document_header", F.lit(0)), F.col("heading")))
    reset = F.greatest(F.coalesce("document_header", F.lit(0)), F.coalesce("heading", F.lit(0)))
    x = x.withColumn("epoch", reset)
    e = W.partitionBy("doc_id", "epoch").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("table_header", F.first(at("row"), True).over(e))
    x = x.withColumn("table_header", F.when(F.col("kind") == "row", F.col("table_header")))
    steps = F.when(F.col("kind") == "prose", 0).otherwise(1)
    return x.withColumn("run", F.sum(steps).over(w)).drop("heading", "epoch")


def uncovered(spans: DataFrame, used: DataFrame) -> DataFrame:
    """Spans that no chunk holds (anti-join on doc_id, line_no)."""
    return spans.join(used, ["doc_id", "line_no"], "left_anti")


def check_publication(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_spans, n_chunks, variants, orphans, ok: what would keep a source from being published."""
    s = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"))
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("variant").alias("variants"))
    known = spans.select("doc_id", F.col("line_no").alias("first_line"))
    o = chunks.join(known, ["doc_id", "first_line"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("orphans"))
    j = s.join(c, "doc_id", "left").join(o, "doc_id", "left").na.fill(0, ["n_chunks", "variants", "orphans"])
    return j.withColumn("ok", (F.col("variants") == 2) & (F.col("orphans") == 0) & (F.col("n_chunks") > 0))


def register_sources(new: DataFrame, key: list[str], facts: list[str], order: str) -> DataFrame:
    """Idempotent registration: the first row of each key is kept, later ones are replays if their facts agree, else conflicts."""
    w = W.partitionBy(*key).orderBy(order)
    same = F.lit(True)
    for f in facts:
        same = same & F.first(f).over(w).eqNullSafe(F.col(f))
    n = F.row_number().over(w)
    return new.withColumn("outcome", F.when(n == 1, "kept").when(same, "replay").otherwise("conflict"))
