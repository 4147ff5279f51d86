"""Queries on span-aware token windows, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import windows as M
from .evidence_queries import SPANS, docs
from .frames import table

#: Limits that bite on the given tables' lines, beside the default ones.
TIGHT = dict(width=96, overlap=16, max_spans=6, max_bytes=1_500)


def lines(spark, d):
    """The lines of each document as one block; a line's number is its span's id."""
    return I.line_spans(docs(spark, d)).select("doc_id", "line_no", F.col("line_no").alias("span_id"), "text")


def shown(w):
    return w.select("doc_id", "win", "first_token", "n_tokens", F.md5("text").alias("h"), F.array_join("span_ids", ",").alias("span_ids"))


def mapped(spark, d):
    return shown(M.mapped_windows(lines(spark, d), ["doc_id"]))


def capped(spark, d):
    return shown(M.mapped_windows(lines(spark, d), ["doc_id"], **TIGHT))


def from_sql(spark, d):
    """Windows by the table function, called for each row of a table."""
    M.register_windows(spark)
    rows = spark.sql("SELECT t.doc_id, w.win, w.first_token, w.n_tokens, md5(w.text) AS h FROM {docs} t, LATERAL token_windows(t.text, 384, 32) w", docs=table(spark, d, "documents"))
    return rows


def windows_sql(width: int, overlap: int, max_spans: int, max_bytes: int) -> str:
    """Windows one after another by a recursive CTE; a table of the token at which each line's limits end a window is made before."""
    return rf"""WITH RECURSIVE {SPANS}, counted AS (SELECT doc_id, line_no, regexp_extract_all(text, '[\pL\pN]+') AS toks, strlen(text) AS n FROM spans),
l AS (SELECT *, row_number() OVER w - 1 AS i, sum(len(toks)) OVER w - len(toks) AS tok, sum(n) OVER w AS upto FROM counted WHERE len(toks) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
total AS (SELECT doc_id, sum(len(toks)) AS total, flatten(list(toks ORDER BY line_no)) AS toks FROM l GROUP BY doc_id),
stop AS (SELECT a.doc_id, a.tok, a.tok + len(a.toks) AS past, a.n > {max_bytes} AS over, coalesce(min(b.tok), max(total)) AS stop FROM l a JOIN total t ON t.doc_id = a.doc_id
  LEFT JOIN l b ON b.doc_id = a.doc_id AND b.i > a.i AND (b.i - a.i + 1 > {max_spans} OR b.upto - a.upto + a.n > {max_bytes}) GROUP BY ALL),
w AS (SELECT doc_id, 0 AS win, 0::HUGEINT AS a, CASE WHEN over THEN 1 ELSE least({width}, stop) END AS z FROM stop WHERE tok = 0
  UNION ALL SELECT w.doc_id, win + 1, greatest(a + 1, z - {overlap}), CASE WHEN over THEN greatest(a + 1, z - {overlap}) + 1 ELSE least(greatest(a + 1, z - {overlap}) + {width}, stop) END FROM w JOIN total t ON t.doc_id = w.doc_id JOIN stop s ON s.doc_id = w.doc_id AND greatest(a + 1, z - {overlap}) >= tok AND greatest(a + 1, z - {overlap}) < past WHERE z < total)
SELECT w.doc_id, win, a::BIGINT AS first_token, (z - a)::BIGINT AS n_tokens, md5(array_to_string(list_slice(any_value(t.toks), a::BIGINT + 1, z::BIGINT), ' ')) AS h, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS span_ids
FROM w JOIN total t ON t.doc_id = w.doc_id JOIN l ON l.doc_id = w.doc_id AND l.tok < z AND l.tok + len(l.toks) > a GROUP BY w.doc_id, win, a, z"""


QUERIES = {
    "c3_mapped_windows": (mapped, windows_sql(384, 32, 64, 16384)),
    "c3_capped_windows": (capped, windows_sql(**TIGHT)),
    "c3_windows_in_sql": (from_sql, r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\pL\pN]+') AS toks FROM documents), w AS (SELECT doc_id, toks, unnest(range(0, 1 + greatest(0, ceil((len(toks) - 384) / 352))::BIGINT)) AS win FROM t WHERE len(toks) > 0)
SELECT doc_id, win, win * 352 AS first_token, len(list_slice(toks, win * 352 + 1, win * 352 + 384)) AS n_tokens, md5(array_to_string(list_slice(toks, win * 352 + 1, win * 352 + 384), ' ')) AS h FROM w"""),
}
