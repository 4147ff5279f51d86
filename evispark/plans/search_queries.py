"""Queries on English text search, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import english
from ..functions.text import identifiers, longest, tokens
from ..operators import retrieval as R
from ..operators import search as X
from ..operators import textsearch as S
from ..sources.shared import written
from .evidence_queries import CHUNKS, FUSED, ID_SQL, POOL, SPANS, TOK, asked, chunks, docs
from .frames import table


def questions(spark, d):
    """A question with phrases, an alternative and an excluded word for each benchmark item, made of its words."""
    t = tokens(F.col("text"))
    part = lambda a, n: F.array_join(F.slice(t, a, n), " ")
    text = F.concat(F.lit('"'), part(3, 3), F.lit('" '), part(8, 1), F.lit(' or "'), part(10, 4), F.lit('" -'), part(16, 1), F.lit(' "of "'))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))


QUESTION = f"questions AS (SELECT item_id AS query_id, '\"' || array_to_string(list_slice(t, 3, 5), ' ') || '\" ' || coalesce(t[8], '') || ' or \"' || array_to_string(list_slice(t, 10, 13), ' ') || '\" -' || coalesce(t[16], '') || ' \"of \"' AS text FROM (SELECT item_id, {TOK.format('text')} AS t FROM benchmark))"
_STOP = "(" + ", ".join(f"'{w}'" for w in english.STOP) + ")"


def bagged(spark, d, q):
    """Bags of the stems of queries ``q``."""
    return written(S.bags(written(chunks(spark, d)), S.query_terms(q)))


def h2_english(spark, d):
    q = asked(spark, d)
    return R.bm25_bags(S.query_terms(q), bagged(spark, d, q)).select("query_id", "chunk_id", "score", "rank")


def h5_quoted(spark, d):
    q = questions(spark, d)
    return S.phrase_lane(q, None, None, bagged=bagged(spark, d, q)).select("query_id", "chunk_id", "place")


def h6_cover(spark, d):
    q = questions(spark, d)
    return S.relevance_bags(S.parsed(q), bagged(spark, d, q))


def h1_dense(spark, d):
    """The dense lane: the 100 nearest vectors of each query within its collection (label), exact."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("collection"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    q = v.where("chunk_id % 20 = 0").select("collection", F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"))
    return R.dense_lane(q, v, 100).select("query_id", "chunk_id", "rank")


def identified(spark, d):
    """(documents' identifiers, questions of them): each document's identifiers, its first word or its last. Texts are searched once."""
    t = tokens(F.col("text"))
    ids = written(docs(spark, d).select("doc_id", "source", identifiers(F.col("text")).alias("ids"), F.get(t, F.lit(0)).alias("a"), F.get(t, F.size(t) - 1).alias("z")))
    text = F.concat(F.array_join(longest(F.col("ids")), " or "), F.lit(" or "), F.col("a"), F.lit(" or "), F.col("z"))
    return ids, ids.where("size(ids) > 0").select(F.col("doc_id").alias("query_id"), text.alias("text"))


def h4_ranked(spark, d):
    ids, q = identified(spark, d)
    c = docs(spark, d).select(F.col("source").alias("collection"), F.col("doc_id").alias("chunk_id"), "source", "text")
    held = ids.select(F.col("doc_id").alias("chunk_id"), "source", F.explode("ids").alias("identifier"))
    return S.literal_lane(q, c, held=held).select("query_id", "chunk_id", "place")


def h8_english(spark, d):
    """The hybrid pool of the questions' BM25 and phrase lanes on stems; phrase hits are protected."""
    q = questions(spark, d)
    some = bagged(spark, d, q)
    each = [("bm25", R.bm25_bags(S.query_terms(q), some)), ("phrase", S.phrase_lane(q, None, None, bagged=some).withColumn("rank", F.col("place")))]
    rows = [x.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.lit(name).alias("branch")) for name, x in each]
    return X.search("V1", written(rows[0].unionByName(rows[1]))).select("query_id", "chunk_id", "score", "branches", "place")


def toks_sql(chunks_sql: str) -> str:
    """toks (chunk_id, collection, pos, term): stems of all tokens but stop words."""
    return f"""rawtoks AS (SELECT collection, chunk_id, unnest({TOK.format('text')}) AS word, generate_subscripts({TOK.format('text')}, 1) - 1 AS pos FROM {chunks_sql}), words AS (SELECT DISTINCT word FROM rawtoks WHERE word NOT IN {_STOP}
UNION SELECT word FROM (SELECT unnest({TOK.format('text')}) AS word FROM benchmark) WHERE word NOT IN {_STOP}), stemmed AS ({english.stems_sql('words')}), toks AS (SELECT collection, chunk_id, pos, stem AS term FROM rawtoks JOIN stemmed USING (word)),
posted AS (SELECT collection, chunk_id, term, count(*) AS tf FROM toks GROUP BY ALL), lens AS (SELECT collection, chunk_id, sum(tf) AS len FROM posted GROUP BY ALL), stats AS (SELECT collection, count(*) AS n, avg(len) AS avg_len FROM lens GROUP BY ALL),
dfs AS (SELECT collection, term, count(*) AS df FROM posted GROUP BY ALL)"""


def bm25_sql(name: str, queries: str, k: int = 100) -> str:
    """``name`` (query_id, chunk_id, score, rank): BM25 over stems of queries (query_id, text)."""
    return f"""{name}_t AS (SELECT DISTINCT query_id, stem AS term FROM (SELECT query_id, unnest({TOK.format('text')}) AS word FROM {queries}) JOIN stemmed USING (word)),
{name}_s AS (SELECT query_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
FROM posted p JOIN {name}_t USING (term) JOIN dfs USING (collection, term) JOIN stats USING (collection) JOIN lens USING (collection, chunk_id) GROUP BY query_id, p.chunk_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def parsed_sql(queries: str) -> str:
    """elements (query_id, alt, item, negated, at, term) of queries (query_id, text)."""
    return rf"""raws AS (SELECT query_id, unnest(regexp_extract_all(text, '(-?"[^"]*"|[^\s"]+)')) AS raw, generate_subscripts(regexp_extract_all(text, '(-?"[^"]*"|[^\s"]+)'), 1) - 1 AS item FROM {queries}),
alts AS (SELECT *, count(*) FILTER (lower(raw) = 'or') OVER (PARTITION BY query_id ORDER BY item) AS alt FROM raws), eltoks AS (SELECT query_id, alt, item, raw LIKE '-%' AS negated, unnest({TOK.format('raw')}) AS word, generate_subscripts({TOK.format('raw')}, 1) - 1 AS ofs FROM alts WHERE lower(raw) <> 'or'),
elements AS (SELECT query_id, alt, item, negated, ofs, stem AS term FROM eltoks JOIN stemmed USING (word) QUALIFY bool_or(NOT negated) OVER (PARTITION BY query_id, alt))"""


#: Covers by brute force: for each place an item ends, the least of the items' latest beginnings up to it.
COVERS = """sizes AS (SELECT query_id, alt, item, negated, count(*) AS n, min(ofs) AS lo, max(ofs) AS hi FROM elements GROUP BY ALL),
places AS (SELECT e.query_id, e.alt, e.item, e.negated, chunk_id, pos - ofs AS start, count(*) AS k FROM elements e JOIN toks USING (term) GROUP BY ALL),
occ AS (SELECT p.query_id, p.alt, p.item, p.negated, chunk_id, start + lo AS a, start + hi AS z FROM places p JOIN sizes s ON s.query_id = p.query_id AND s.alt = p.alt AND s.item = p.item WHERE k = n),
good AS (SELECT * FROM occ o WHERE NOT negated AND NOT EXISTS (SELECT 1 FROM occ b WHERE b.negated AND b.query_id = o.query_id AND b.alt = o.alt AND b.chunk_id = o.chunk_id)),
need AS (SELECT query_id, alt, count(*) AS need FROM sizes WHERE NOT negated GROUP BY ALL),
latest AS (SELECT e.query_id, e.alt, e.chunk_id, e.z, o.item, max(o.a) AS a FROM (SELECT DISTINCT query_id, alt, chunk_id, z FROM good) e JOIN good o ON o.query_id = e.query_id AND o.alt = e.alt AND o.chunk_id = e.chunk_id AND o.z <= e.z GROUP BY ALL),
ends AS (SELECT l.query_id, l.alt, chunk_id, z, min(a) AS a FROM latest l JOIN need n ON n.query_id = l.query_id AND n.alt = l.alt GROUP BY l.query_id, l.alt, chunk_id, z HAVING count(*) = max(need)),
stretches AS (SELECT DISTINCT query_id, chunk_id, a, z FROM ends),
minimal AS (SELECT * FROM stretches s WHERE NOT EXISTS (SELECT 1 FROM stretches t WHERE t.query_id = s.query_id AND t.chunk_id = s.chunk_id AND t.a >= s.a AND t.z <= s.z AND (t.a > s.a OR t.z < s.z))),
relevance AS (SELECT query_id, chunk_id, count(*) AS n_covers, round(sum(0.1 / (2 + z - a - held)), 6) AS relevance FROM (SELECT m.query_id, m.chunk_id, a, z, count(*) AS held FROM minimal m JOIN (SELECT DISTINCT query_id, term FROM elements) e ON e.query_id = m.query_id JOIN toks t ON t.chunk_id = m.chunk_id AND t.term = e.term AND t.pos BETWEEN m.a AND m.z GROUP BY ALL) GROUP BY ALL)"""
PHRASE_SQL = rf"""two AS (SELECT query_id * 2 + phrase_no AS query_id, text FROM (SELECT query_id, unnest(list_slice(regexp_extract_all(text, '"([^"\n]{{3,120}})"', 1), 1, 2)) AS text, generate_subscripts(list_slice(regexp_extract_all(text, '"([^"\n]{{3,120}})"', 1), 1, 2), 1) - 1 AS phrase_no FROM questions)),
{bm25_sql('pool100', 'two')}, elements AS (SELECT query_id, 0 AS alt, 0 AS item, false AS negated, ofs, stem AS term FROM (SELECT query_id, unnest({TOK.format('text')}) AS word, generate_subscripts({TOK.format('text')}, 1) - 1 AS ofs FROM two) JOIN stemmed USING (word)), {COVERS},
confirmed AS (SELECT * FROM (SELECT r.query_id, r.chunk_id, row_number() OVER (PARTITION BY r.query_id ORDER BY relevance DESC, r.chunk_id) AS pos FROM relevance r JOIN pool100 p ON p.query_id = r.query_id AND p.chunk_id = r.chunk_id) WHERE pos <= 20),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos, lane) AS k FROM (SELECT query_id // 2 AS query_id, query_id % 2 AS lane, pos, chunk_id FROM confirmed)),
phrase AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, lane, chunk_id) AS rank FROM firsts WHERE k = 1) WHERE rank <= 20)"""

HEAD = f"WITH {SPANS}, {CHUNKS}, {toks_sql('chunks')}"
_DOC_IDS = ID_SQL.replace("page_id", "chunk_id").replace("html", "text").replace("FROM pages", "FROM (SELECT doc_id AS chunk_id, text FROM documents)")
_ASKED_IDS = ID_SQL
for _name in ("found", "low", "cut", "ranked"):
    _ASKED_IDS = _ASKED_IDS.replace(f"{_name} AS", f"q{_name} AS").replace(f"FROM {_name}", f"FROM q{_name}")
_ASKED_IDS = _ASKED_IDS.replace("page_id", "query_id").replace("html", "text").replace("FROM pages", "FROM asked4")
RANKED = f"""WITH {_DOC_IDS}, per AS (SELECT chunk_id, string_agg(t, ' or ' ORDER BY r) AS ids FROM ranked WHERE r <= 8 GROUP BY chunk_id),
asked4 AS (SELECT doc_id AS query_id, ids || ' or ' || t[1] || ' or ' || t[-1] AS text FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents) JOIN per ON per.chunk_id = doc_id), whole AS (SELECT source AS collection, doc_id AS chunk_id, text FROM documents),
{toks_sql('whole')}, {parsed_sql('asked4')}, {COVERS}, {_ASKED_IDS},
h AS (SELECT q.query_id, q.r - 1 AS term_no, c.chunk_id, d.source, row_number() OVER (PARTITION BY q.query_id, q.r ORDER BY coalesce(v.relevance, 0) DESC, d.source, c.chunk_id) AS pos FROM qranked q JOIN cut c ON c.t = q.t JOIN documents d ON d.doc_id = c.chunk_id LEFT JOIN relevance v ON v.query_id = q.query_id AND v.chunk_id = c.chunk_id WHERE q.r <= 8),
l AS (SELECT *, min(pos) OVER (PARTITION BY query_id, term_no, source) AS lane, row_number() OVER (PARTITION BY query_id, term_no, source ORDER BY pos) AS inlane FROM h WHERE pos <= 100),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, term_no ORDER BY inlane, lane, chunk_id) AS p FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p, term_no) AS f FROM a WHERE p <= 100)
SELECT query_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, term_no, chunk_id) AS place FROM b WHERE f = 1) WHERE place <= 20"""

QUERIES = {
    "h1_dense_lane": (h1_dense, "SELECT query_id, chunk_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0) WHERE rank <= 100"),
    "h2_bm25_english": (h2_english, f"{HEAD}, {bm25_sql('bm25', '(SELECT item_id AS query_id, text FROM benchmark)')} SELECT query_id, chunk_id, score, rank FROM bm25"),
    "h4_literal_ranked": (h4_ranked, RANKED),
    "h5_quoted_phrases": (h5_quoted, f"{HEAD}, {QUESTION}, {PHRASE_SQL} SELECT query_id, chunk_id, rank AS place FROM phrase"),
    "h8_english_pool": (h8_english, f"""{HEAD}, {QUESTION}, {bm25_sql('bm25', 'questions')}, {PHRASE_SQL}, literal AS (SELECT * FROM phrase WHERE false),
lane_rows AS (SELECT query_id, chunk_id, rank, 'bm25' AS branch FROM bm25 UNION ALL SELECT query_id, chunk_id, rank, 'phrase' FROM phrase), {FUSED}, {POOL} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM pool"""),
    "h6_cover_density": (h6_cover, f"{HEAD}, {QUESTION}, {parsed_sql('questions')}, {COVERS} SELECT * FROM relevance"),
}
