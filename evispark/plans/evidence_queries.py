"""Queries on ingest, retrieval and evidence, with DuckDB SQL. Keys are the operator ids of the inventory."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import ingest as I
from ..operators import retrieval as R
from ..operators import search as X
from ..sources.shared import written
from .frames import frame, table, with_frames

BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
EDGES = r"^[\s\pZ\x1c-\x1f\x{85}]+|[\s\pZ\x1c-\x1f\x{85}]+$"
LINES = rf"raw_lines AS (SELECT doc_id, source, unnest(string_split_regex(text, '{BREAKS}')) AS raw, generate_subscripts(string_split_regex(text, '{BREAKS}'), 1) AS line_no FROM documents)"
SPANS = rf"""{LINES}, trimmed AS (SELECT doc_id, source, line_no, regexp_replace(raw, '{EDGES}', '', 'g') AS text FROM raw_lines),
marked AS (SELECT *, CASE WHEN text LIKE '#%' THEN left(regexp_replace(regexp_replace(text, '^[# ]+', ''), '{EDGES}', '', 'g'), 200) END AS h FROM trimmed WHERE text <> ''),
spans AS (SELECT doc_id, source, line_no, text, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM marked)"""
CHUNKS = "chunks AS (SELECT source AS collection, doc_id * 100000 + (line_no - 1) // 8 AS chunk_id, source, string_agg(text, chr(10) ORDER BY line_no) AS text FROM spans GROUP BY source, doc_id, (line_no - 1) // 8)"
STOP = "(" + ", ".join(f"'{w}'" for w in R.STOP) + ")"
TOK = r"regexp_extract_all(lower({}), '[\pL\pN]+')"
POSTED = rf"""toks AS (SELECT collection, chunk_id, unnest({TOK.format('text')}) AS term, generate_subscripts({TOK.format('text')}, 1) - 1 AS pos FROM chunks),
posted AS (SELECT collection, chunk_id, term, count(*) AS tf FROM toks WHERE term NOT IN {STOP} GROUP BY ALL),
lens AS (SELECT collection, chunk_id, sum(tf) AS len FROM posted GROUP BY ALL), stats AS (SELECT collection, count(*) AS n, avg(len) AS avg_len FROM lens GROUP BY ALL),
dfs AS (SELECT collection, term, count(*) AS df FROM posted GROUP BY ALL)"""
QTERMS = rf"qterms AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark), qt AS (SELECT * FROM qterms WHERE term NOT IN {STOP})"
BM25 = rf"""scored AS (SELECT query_id, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
FROM posted p JOIN qt USING (term) JOIN dfs USING (collection, term) JOIN stats USING (collection) JOIN lens USING (collection, chunk_id) GROUP BY query_id, p.chunk_id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 100)"""
CHAIN = f"WITH {SPANS}, {CHUNKS}, {POSTED}, {QTERMS}, {BM25}"


def docs(spark, d):
    return table(spark, d, "documents")


def spans(spark, d):
    return I.line_spans(docs(spark, d))


def chunks(spark, d):
    """Eight lines of a document make a chunk."""
    s = spans(spark, d).withColumn("b", F.floor((F.col("line_no") - 1) / 8))
    g = s.groupBy("source", "doc_id", "b").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return g.select(F.col("source").alias("collection"), (F.col("doc_id") * 100000 + F.col("b")).alias("chunk_id"), "source", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25(spark, d):
    q = asked(spark, d)
    return R.bm25_bags(R.query_terms(q), bagged(q, chunks(spark, d)))


def bagged(q, c, dims=0):
    """The words of queries ``q`` in chunks ``c``, made once."""
    return written(R.bags(c, R.asked_words(R.query_terms(q)), dims=dims))


def s1(spark, d):
    return spans(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", "section")


def s2(spark, d):
    return I.reject_oversize(docs(spark, d), max_lines=40, max_bytes=8000)


def s4(spark, d):
    return table(spark, d, "pages").select("page_id", T.valid_name(F.regexp_extract("url", "([^/]*)$", 1)).alias("last_ok"), T.valid_name(F.col("url")).alias("url_ok"))


def s5(spark, d):
    x = frame(spark, d, "sources")
    return I.register_sources(x, ["collection_id", "request_id"], ["byte_count", "lang"], "id").select("id", "outcome")


def s7(spark, d):
    x = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return x.select("event_id", F.col("p.k").alias("k"))


def s12(spark, d):
    live = frame(spark, d, "sources").where("NOT deleted").select(F.col("id").alias("doc_id"))
    return spans(spark, d).join(live, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def p1(spark, d):
    s = frame(spark, d, "sources").where("status = 'ready' AND NOT deleted").select(F.col("id").alias("doc_id"), F.col("collection_id").alias("source"))
    return spans(spark, d).join(s, ["doc_id", "source"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


def p4(spark, d):
    return docs(spark, d).select("doc_id", T.byte_prefix(F.col("text"), 17).alias("prefix"), F.octet_length(T.byte_prefix(F.col("text"), 17)).cast("long").alias("n"))


def p7(spark, d):
    return docs(spark, d).select("doc_id", T.coverage_policy(F.col("text")).alias("policy"), T.global_absence(F.col("text"), F.lit("")).alias("absence"))


def requests(spark, d):
    """Requests of a hundred ids each, as many as the table calls for: ids over the whole table, with repeats and some unknown ones."""
    i = F.col("doc_id")
    wanted = F.when(i % 500 == 7, i + 1_000_000_000).otherwise(i - i % 3)
    return docs(spark, d).groupBy(F.floor(i / 100).alias("req")).agg(F.sort_array(F.collect_list(wanted)).alias("ids"))


def j3(spark, d):
    return E.lookup_lenient(requests(spark, d), docs(spark, d).select(F.col("doc_id").alias("id"), "lang")).select("req", F.col("pos").cast("long").alias("pos"), "id", "lang")


def j4(spark, d):
    return E.lookup_strict(requests(spark, d), docs(spark, d).select(F.col("doc_id").alias("id"), "lang")).select("req", F.col("pos").cast("long").alias("pos"), "id", "accepted")


REQ = "ids AS (SELECT doc_id // 100 AS req, list_sort(list(CASE WHEN doc_id % 500 = 7 THEN doc_id + 1000000000 ELSE doc_id - doc_id % 3 END)) AS ids FROM documents GROUP BY 1), e AS (SELECT req, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM ids)"


def j6(spark, d):
    labelled = table(spark, d, "labels").select("doc_id")
    return docs(spark, d).select("doc_id").join(labelled, "doc_id", "left_anti")


def j15(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("collection"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    q = v.where("chunk_id % 20 = 0").select("collection", F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"))
    return R.dense_lane(q, v, 10).select("query_id", "chunk_id", "rank")


def h1_lsh(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    return R.lsh_lane(v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("qv")), v)


def h2(spark, d):
    return bm25(spark, d).select("query_id", "chunk_id", "score", "rank")


def h3(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.array_join(T.identifiers(F.col("html")), " ").alias("ids"), F.array_join(T.query_identifiers(F.col("html")), " ").alias("query_ids"))


ID_SQL = r"""found AS (SELECT page_id, unnest(list_concat(list_concat(regexp_extract_all(html, '10\.[0-9]{4,9}/[A-Za-z0-9._;()/:+-]+|[A-Za-z][A-Za-z0-9]*[-./:][A-Za-z0-9/._:-]+|[A-Za-z]{2,}[0-9][A-Za-z0-9]*'),
 regexp_extract_all(html, '10\.[0-9]{4,9}/[A-Za-z0-9._;()/:+-]+')), regexp_extract_all(html, '((?i)NCT[0-9]{8})(?:[^0-9]|$)', 1))) AS t FROM pages),
low AS (SELECT DISTINCT page_id, regexp_replace(lower(t), '[.,;:]+$', '') AS t FROM found WHERE regexp_matches(t, '[0-9]')),
cut AS (SELECT DISTINCT page_id, left(t, length(t) - least(greatest(length(t) - length(replace(t, ')', '')) - length(t) + length(replace(t, '(', '')), 0), length(regexp_extract(t, '\)*$')))) AS t FROM low),
ranked AS (SELECT page_id, t, row_number() OVER (PARTITION BY page_id ORDER BY length(t) DESC, t) AS r FROM cut)"""


def h4(spark, d):
    c = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "source", "text")
    q = c.select(F.col("chunk_id").alias("query_id"), "text")
    hits = R.literal_hits(q, c)
    return R.interleave_sources(hits).select("query_id", "chunk_id", "place")


def phrases(spark, d):
    """A phrase of each benchmark query: its third to sixth word."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("phrase_no"), F.array_join(F.slice(T.tokens(F.col("text")), 3, 4), " ").alias("phrase"))


def h5(spark, d):
    return R.phrase_bags(phrases(spark, d), R.bags(chunks(spark, d), R.asked_words(R.query_terms(asked(spark, d))))).select("query_id", "chunk_id", "hits", "rank")


def h6(spark, d):
    q = asked(spark, d)
    return R.proximity_bags(q, R.bags(chunks(spark, d), R.asked_words(R.query_terms(q))))


def lanes(spark, d):
    """(chunks, lane rows): dense, BM25, literal and phrase lanes of all benchmark queries over all chunks, each made once."""
    q, c = asked(spark, d), written(chunks(spark, d))
    some = bagged(q, c, 64)
    vectors = some.select(F.lit("all").alias("collection"), "chunk_id", "v")
    dense = R.dense_lane(R.embed(q, "text", role="query").select(F.lit("all").alias("collection"), "query_id", F.col("v").alias("qv")), vectors)
    literal = R.interleave_sources(R.literal_hits(q, c)).withColumn("rank", F.col("place"))
    each = [("dense", dense), ("bm25", R.bm25_bags(R.query_terms(q), some)), ("literal", literal), ("phrase", R.phrase_bags(phrases(spark, d), some))]
    rows = [x.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.lit(name).alias("branch")) for name, x in each]
    return c, written(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))


LANES = rf"""slots AS (SELECT chunk_id, ('0x' || left(md5(w), 4))::INT % 64 AS slot, count(*) AS n FROM (SELECT chunk_id, unnest(list_prepend('passage', {TOK.format('text')})) AS w FROM chunks) GROUP BY ALL),
qslots AS (SELECT query_id, ('0x' || left(md5(w), 4))::INT % 64 AS slot, count(*) AS n FROM (SELECT item_id AS query_id, unnest(list_prepend('query', {TOK.format('text')})) AS w FROM benchmark) GROUP BY ALL),
norms AS (SELECT chunk_id, sqrt(sum(n * n)) AS len FROM slots GROUP BY 1), qnorms AS (SELECT query_id, sqrt(sum(n * n)) AS len FROM qslots GROUP BY 1), dots AS (SELECT query_id, chunk_id, sum(q.n * s.n) AS dot FROM qslots q JOIN slots s USING (slot) GROUP BY ALL),
dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dot, 0) / (q.len * s.len), 6) DESC, chunk_id) AS rank FROM qnorms q CROSS JOIN norms s LEFT JOIN dots USING (query_id, chunk_id)),
{re.sub(r'\b(found|low|cut|ranked)\b', r'q\1', ID_SQL.replace('page_id', 'query_id').replace('html', 'text').replace('FROM pages', 'FROM (SELECT item_id AS query_id, text FROM benchmark)'))},
{ID_SQL.replace('page_id', 'chunk_id').replace('html', 'text').replace('FROM pages', 'FROM chunks')},
lh AS (SELECT q.query_id, q.r - 1 AS term_no, c.chunk_id, d.source, row_number() OVER (PARTITION BY q.query_id, q.r ORDER BY length(d.text), d.source, c.chunk_id) AS pos FROM qranked q JOIN cut c ON c.t = q.t JOIN chunks d ON d.chunk_id = c.chunk_id WHERE q.r <= 8),
ll AS (SELECT *, min(pos) OVER (PARTITION BY query_id, term_no, source) AS lane, row_number() OVER (PARTITION BY query_id, term_no, source ORDER BY pos) AS inlane FROM lh WHERE pos <= 100),
la AS (SELECT *, row_number() OVER (PARTITION BY query_id, term_no ORDER BY inlane, lane, chunk_id) AS p FROM ll), lb AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p, term_no) AS f FROM la WHERE p <= 100),
literal AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, term_no, chunk_id) AS rank FROM lb WHERE f = 1) WHERE rank <= 20),
w AS (SELECT item_id AS query_id, unnest(list_slice({TOK.format('text')}, 3, 6)) AS term, generate_subscripts(list_slice({TOK.format('text')}, 3, 6), 1) - 1 AS i FROM benchmark), ww AS (SELECT * FROM w WHERE term NOT IN {STOP}),
sz AS (SELECT query_id, count(*) AS size FROM ww GROUP BY 1), st AS (SELECT query_id, chunk_id, pos - i AS s, count(*) AS n FROM ww JOIN toks USING (term) GROUP BY ALL), ph AS (SELECT query_id, chunk_id, count(*) AS hits FROM st JOIN sz USING (query_id) WHERE n = size GROUP BY ALL),
phrase AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM ph) WHERE rank <= 20),
lane_rows AS (SELECT query_id, chunk_id, rank, 'dense' AS branch FROM dense WHERE rank <= 100 UNION ALL SELECT query_id, chunk_id, rank, 'bm25' FROM bm25 UNION ALL SELECT query_id, chunk_id, rank, 'literal' FROM literal UNION ALL SELECT query_id, chunk_id, rank, 'phrase' FROM phrase)"""
FUSED = "fused AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches FROM lane_rows GROUP BY query_id, chunk_id)"
PROTECTED = """verified AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, lane) AS k FROM (SELECT query_id, chunk_id, rank, 0 AS lane FROM literal UNION ALL SELECT query_id, chunk_id, rank, 1 FROM phrase)),
prot AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, lane, chunk_id) AS place FROM verified WHERE k = 1)"""


def pool_sql(n: int, kept: int) -> str:
    return f"SELECT query_id, chunk_id, score, branches FROM (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY CASE WHEN p.chunk_id IS NULL THEN 1 ELSE 0 END, f.score DESC, f.chunk_id) AS r FROM fused f LEFT JOIN prot p ON p.query_id = f.query_id AND p.chunk_id = f.chunk_id AND p.place <= {kept}) WHERE r <= {n}"


POOL = f"{PROTECTED}, pool AS ({pool_sql(20, 4)})"


def h7(spark, d):
    rows = lanes(spark, d)[1]
    return R.rrf([(n, rows.where(F.col("branch") == n)) for n in ("dense", "bm25", "literal", "phrase")])


def pooled(spark, d):
    """(chunks, pool of the hybrid variant)."""
    c, rows = lanes(spark, d)
    return c, X.search("V1", rows)


def pool(spark, d):
    return pooled(spark, d)[1]


def h8(spark, d):
    return pool(spark, d).select("query_id", "chunk_id", "score", "branches", "place")


def h9(spark, d):
    """All variants over the same lanes."""
    rows = lanes(spark, d)[1]
    each = [X.search(v, rows).select(F.lit(v).alias("variant"), "query_id", "chunk_id", "place") for v in ("V0", "V1", "V2", "V3")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def h10(spark, d):
    c, p = pooled(spark, d)
    return R.hydrate(p, c, 40).select("query_id", "chunk_id", "source", "snippet", F.col("n_bytes").cast("long").alias("n_bytes"))


def h11(spark, d):
    c, p = pooled(spark, d)
    return R.rerank(p, c, asked(spark, d)).select("query_id", "chunk_id", "rerank", "place")


def h12(spark, d):
    counts = [F.count_if(F.contains(F.col("branches"), F.lit(n))).alias(n) for n in ("dense", "bm25", "literal", "phrase")]
    return pool(spark, d).groupBy("query_id").agg(F.count("*").alias("pool"), *counts)


def w8(spark, d):
    rows = lanes(spark, d)[1].where("branch IN ('bm25', 'dense') AND rank <= 30")
    x = rows.select("query_id", "chunk_id", F.when(F.col("branch") == "bm25", 0).otherwise(1).alias("lane"), F.col("rank").alias("pos"))
    return R.interleave(x, 20, ["query_id"]).select("query_id", "chunk_id", "place")


def h13(spark, d):
    return E.read_evidence(requests(spark, d), docs(spark, d).select(F.col("doc_id").alias("id"), "text"), budget=9000)


def w6(spark, d):
    s = docs(spark, d).select("source", "doc_id", F.octet_length("text").cast("long").alias("n"))
    return E.fit_prefix(s, "source", ["doc_id"], 16384).select("source", "doc_id", "upto")


def d31(spark, d):
    return E.inventory(spans(spark, d))


def k6(spark, d):
    return E.collection_pages(spans(spark, d), 4096).groupBy("source", "page").agg(F.count("*").alias("n"), F.sum("n").alias("n_bytes"), F.min("doc_id").alias("first_doc"))


def h15(spark, d):
    x = docs(spark, d).groupBy(F.floor(F.col("doc_id") / 60).alias("req"), (F.col("doc_id") % 4).alias("group_no")).agg(F.sort_array(F.collect_list(F.floor(F.col("doc_id") / 7).cast("long"))).alias("ids"))
    return E.merge_evidence(x, 8)


def c1(spark, d):
    f = I.fragment_spans(spans(spark, d), 200)
    whole = E.reassemble(f.select("doc_id", "line_no", "piece", "text"))
    g = f.groupBy("doc_id", "line_no").agg(F.max(F.octet_length("text")).alias("longest"))
    return whole.join(g, ["doc_id", "line_no"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.sha2("text", 256).alias("sha"), "complete", (F.col("longest") <= 200).alias("within"))


def c2_fixed(spark, d):
    return I.pack_blocks(spans(spark, d), I.FIXED_BYTES, False)


def c2_structural(spark, d):
    return I.pack_blocks(spans(spark, d), I.STRUCTURAL_BYTES, True)


def pack_sql(limit: int, by_section: bool) -> str:
    region = "CASE WHEN lag(section) OVER w IS NOT DISTINCT FROM section AND lag(doc_id) OVER w IS NOT NULL THEN 0 ELSE 1 END" if by_section else "CASE WHEN lag(doc_id) OVER w IS NULL THEN 1 ELSE 0 END"
    return rf"""WITH RECURSIVE {SPANS}, c AS (SELECT doc_id, line_no, strlen(text) AS n, {region} AS ch FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no) AS region FROM c), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, region ORDER BY line_no) AS i FROM g),
f AS (SELECT doc_id, region, i, line_no, n, n + 1 AS size, 1 AS block FROM x WHERE i = 1 UNION ALL
 SELECT x.doc_id, x.region, x.i, x.line_no, x.n, CASE WHEN f.size + x.n + 1 > {limit} THEN x.n + 1 ELSE f.size + x.n + 1 END, CASE WHEN f.size + x.n + 1 > {limit} THEN f.block + 1 ELSE f.block END FROM f JOIN x ON x.doc_id = f.doc_id AND x.region = f.region AND x.i = f.i + 1)
SELECT doc_id, region::BIGINT AS region, block::BIGINT AS block, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_spans, sum(n + 1)::BIGINT AS n_bytes FROM f GROUP BY ALL"""


def c3(spark, d):
    return I.token_windows(docs(spark, d).select("doc_id", "text"), ["doc_id"]).select("doc_id", "win", "first_token", "n_tokens", F.md5("text").alias("h"))


def c3_headed(spark, d):
    head = F.substring_index("text", ".", 1)
    x = docs(spark, d).select("doc_id", head.alias("header"), F.expr("substr(text, length(substring_index(text, '.', 1)) + 2)").alias("text"))
    return I.headed_windows(x, ["doc_id"], "header").withColumn("h", F.md5("text")).drop("text")


def c4_chunks(spark, d):
    s, keys = spans(spark, d), ["doc_id", "variant", "region", "block"]
    both = I.pack_blocks(s, I.FIXED_BYTES, False, texts=True).withColumn("variant", F.lit("fixed")).unionByName(I.pack_blocks(s, I.STRUCTURAL_BYTES, True, texts=True).withColumn("variant", F.lit("structural")))
    return I.token_windows(both, keys).groupBy("variant").agg(F.count("*").alias("n_windows"), F.sum("n_tokens").alias("n_tokens"))


def c5(spark, d):
    x = I.structural_context(spans(spark, d))
    return x.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line_no", "document_header", "section_header", "table_header", "run")], "kind")


C5_SQL = rf"""WITH {SPANS}, n AS (SELECT *, lag(section) OVER w AS b, lag(line_no) OVER w AS pl, lead(text) OVER w AS a, strpos(text, '|') > 0 OR strpos(text, chr(9)) > 0 AS tab FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
k AS (SELECT *, CASE WHEN tab AND length(text) <= 200 AND (pl IS NULL OR b <> section OR len(list_filter(list_transform(string_split(replace(lower(text), chr(9), '|'), '|'), lambda f: trim(f)), lambda f: f IN ('patient', 'subject') OR starts_with(f, 'patient:') OR starts_with(f, 'subject:'))) > 0) AND a IS NOT NULL AND strpos(a, '|') = 0 AND strpos(a, chr(9)) = 0 THEN 'identity'
 WHEN NOT tab AND ((starts_with(text, '#') AND length(text) < 200) OR (ends_with(text, ':') AND length(text) < 200) OR (upper(text) = text AND lower(text) <> text AND length(text) < 120)) THEN 'heading' WHEN tab THEN 'row' ELSE 'prose' END AS kind FROM n),
h AS (SELECT *, last_value(CASE WHEN kind = 'identity' THEN line_no END IGNORE NULLS) OVER w AS dh, last_value(CASE WHEN kind = 'heading' THEN line_no END IGNORE NULLS) OVER w AS hd, sum(CASE WHEN kind = 'prose' THEN 0 ELSE 1 END) OVER w AS run FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT *, greatest(coalesce(dh, 0), coalesce(hd, 0)) AS ep FROM h)
SELECT doc_id, line_no, kind, dh AS document_header, CASE WHEN hd > coalesce(dh, 0) THEN hd END AS section_header, CASE WHEN kind = 'row' THEN min(CASE WHEN kind = 'row' THEN line_no END) OVER (PARTITION BY doc_id, ep ORDER BY line_no) END AS table_header, run::BIGINT AS run FROM e"""


def c7(spark, d):
    used = I.line_classes(spans(spark, d)).where("kind IN ('prose', 'row')").select("doc_id", "line_no")
    return I.uncovered(spans(spark, d), used).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"))


def c8(spark, d):
    one = I.pack_blocks(spans(spark, d), I.FIXED_BYTES, False).withColumn("variant", F.lit("fixed"))
    two = I.pack_blocks(spans(spark, d), I.STRUCTURAL_BYTES, True).withColumn("variant", F.lit("structural"))
    return I.check_publication(one.unionByName(two).withColumn("first_line", F.col("first_line").cast("int")), spans(spark, d)).groupBy("ok", "variants").agg(F.count("*").alias("n"))


def c9(spark, d):
    e = R.embed(table(spark, d, "benchmark"), "text", 32)
    return e.select("item_id", F.round(F.sqrt(R.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.size("v").alias("dims"))


def c10(spark, d):
    label = F.concat_ws(" ", F.left("url", F.lit(512)), F.concat(F.lit("page-"), F.col("page_id").cast("string")))
    p = table(spark, d, "pages").select("page_id", F.concat_ws("\n", label, F.col("html")).alias("search_text"))
    return p.select("page_id", F.md5("search_text").alias("search_hash"), T.identifier_lexemes(F.col("search_text")).alias("lexemes"))


def d28(spark, d):
    return table(spark, d, "pages").select("page_id", T.identifier_lexemes(F.col("html")).alias("lexemes"))


def d29(spark, d):
    """A source's digest: of the digests of its documents by hundreds of ids, so that no group holds a source."""
    x = docs(spark, d).select("source", F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("x"))
    parts = x.groupBy("source", F.floor(F.col("x.doc_id") / 100).alias("part")).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    parts = parts.select("source", F.struct("part", F.sha2(F.array_join(F.transform("xs", lambda x: F.concat_ws("|", x["doc_id"].cast("string"), x["h"])), ";"), 256).alias("h")).alias("p"))
    return parts.groupBy("source").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["h"]), ";"), 256).alias("digest"))


def d30(spark, d):
    p = R.postings(chunks(spark, d))
    t = R.term_stats(p).groupBy("collection").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("max_df"))
    return t.join(R.collection_stats(R.lengths(p)), "collection").select("collection", "terms", "postings", "max_df", "n", F.round("avg_len", 6).alias("avg_len"))


def w1(spark, d):
    return I.with_ordinal(spans(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "ordinal")


def w4(spark, d):
    return I.regions(spans(spark, d)).groupBy("doc_id", "region").agg(F.count("*").alias("n"), F.min("line_no").cast("long").alias("first_line"))


def w10(spark, d):
    x = docs(spark, d).select("source", F.col("lang").alias("item"), F.col("doc_id").alias("pos"))
    return E.first_seen(x, "source", "item", "pos")


def u1(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.identifiers(F.col("url"))).alias("id"))


def h17(spark, d):
    """Search, then read: chunk ids of the pool in place order, first seen, packed."""
    p = pool(spark, d).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda s: s["chunk_id"]).alias("ids"))
    return E.read_evidence(p.select(F.col("query_id").alias("req"), "ids"), chunks(spark, d).select(F.col("chunk_id").alias("id"), "text"))


READ = """k AS (SELECT e.req, e.id, min(pos) AS pos, max(strlen(s.text)) AS n FROM e JOIN {s} s ON s.{key} = e.id GROUP BY e.req, e.id), r AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY pos) AS i FROM k), t AS (SELECT * FROM r WHERE i <= 64),
f AS (SELECT req, i, CASE WHEN n <= {b} THEN n ELSE 0 END AS used, CASE WHEN n <= {b} THEN [id] ELSE [] END AS ids FROM t WHERE i = 1 UNION ALL SELECT t.req, t.i, CASE WHEN f.used + t.n <= {b} THEN f.used + t.n ELSE f.used END, CASE WHEN f.used + t.n <= {b} THEN list_append(f.ids, t.id) ELSE f.ids END FROM f JOIN t ON t.req = f.req AND t.i = f.i + 1),
z AS (SELECT *, max(i) OVER (PARTITION BY req) AS m FROM f) SELECT req, m AS requested, len(ids) AS delivered, used::BIGINT AS used_bytes, len(ids) < m AS truncated, array_to_string(ids, ',') AS ids FROM z WHERE i = m"""
UNCOVERED = C5_SQL.split(", h AS (SELECT")[0] if ", h AS (SELECT" in C5_SQL else C5_SQL.split("\nh AS (SELECT")[0].rstrip(",")
def pages_sql(size: int) -> str:
    return f"""WITH RECURSIVE {SPANS}, p AS (SELECT source, doc_id, line_no, unnest(range(0, ceil(strlen(text) / {size})::BIGINT)) AS piece, strlen(text) AS size FROM spans),
r AS (SELECT *, least({size}, size - piece * {size}) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no, piece) AS i FROM p), t AS (SELECT * FROM r WHERE i <= 256),
f AS (SELECT source, i, doc_id, n, 1 AS page, n AS used, 1 AS cnt FROM t WHERE i = 1 UNION ALL SELECT t.source, t.i, t.doc_id, t.n, CASE WHEN f.used + t.n > {size} OR f.cnt >= 64 THEN f.page + 1 ELSE f.page END, CASE WHEN f.used + t.n > {size} OR f.cnt >= 64 THEN t.n ELSE f.used + t.n END, CASE WHEN f.used + t.n > {size} OR f.cnt >= 64 THEN 1 ELSE f.cnt + 1 END FROM f JOIN t ON t.source = f.source AND t.i = f.i + 1)"""


QUERIES = {
    "s1_line_spans": (s1, f"WITH {SPANS} SELECT doc_id, line_no, text, section FROM spans"),
    "s2_reject_oversize": (s2, rf"WITH {LINES}, g AS (SELECT doc_id, count(*) AS n_lines, max(strlen(raw)) AS longest, count(*) FILTER (regexp_replace(raw, '{EDGES}', '', 'g') <> '') AS k FROM raw_lines GROUP BY doc_id) SELECT doc_id, n_lines, longest, CASE WHEN n_lines > 40 THEN 'too_many_lines' WHEN longest > 8000 THEN 'line_too_long' WHEN k = 0 THEN 'no_text' END AS reason FROM g"),
    "s4_valid_name": (s4, r"SELECT page_id, n <> '' AND n NOT IN ('.', '..') AND length(n) <= 255 AND NOT regexp_matches(n, '[\x00-\x1f\x7f\\]') AS last_ok, FALSE AS url_ok FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS n FROM pages)"),
    "s5_register_sources": (s5, with_frames("sources", body="SELECT id, CASE WHEN n = 1 THEN 'kept' WHEN b IS NOT DISTINCT FROM byte_count AND l IS NOT DISTINCT FROM lang THEN 'replay' ELSE 'conflict' END AS outcome FROM (SELECT *, row_number() OVER w AS n, first_value(byte_count) OVER w AS b, first_value(lang) OVER w AS l FROM sources WINDOW w AS (PARTITION BY collection_id, request_id ORDER BY id))")),
    "s7_from_records": (s7, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "s12_prune_deleted": (s12, with_frames("sources", body="") + f", {SPANS} SELECT source, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM spans WHERE doc_id IN (SELECT id FROM sources WHERE NOT deleted) GROUP BY source"),
    "p1_eligible": (p1, with_frames("sources", body="") + f", {SPANS} SELECT p.doc_id, line_no FROM spans p JOIN sources s ON s.id = p.doc_id AND s.collection_id = p.source WHERE status = 'ready' AND NOT deleted"),
    "p4_byte_prefix": (p4, "SELECT doc_id, p AS prefix, strlen(p)::BIGINT AS n FROM (SELECT doc_id, left(text, len(list_filter(range(1, 18), lambda k: strlen(left(text, k)) <= 17))) AS p FROM documents)"),
    "p7_coverage_policy": (p7, rf"""SELECT doc_id, CASE WHEN regexp_matches(q, '{T.EXHAUSTIVE}') OR regexp_matches(q, '{T.SCOPED_ANY}') OR (regexp_matches(q, '{T.YES_NO}') AND regexp_matches(q, '{T.RECORDED}')) THEN 'complete_scope' ELSE 'claims' END AS policy, regexp_matches(q || ' ', '{T.ABSENCE}') AS absence FROM (SELECT doc_id, lower(text) AS q FROM documents)"""),
    "j3_lookup_lenient": (j3, f"WITH {REQ} SELECT req, pos, id, lang FROM e JOIN documents d ON d.doc_id = e.id"),
    "j4_lookup_strict": (j4, f"WITH {REQ} SELECT req, pos, id, count(*) FILTER (d.doc_id IS NULL) OVER (PARTITION BY req) = 0 AS accepted FROM e LEFT JOIN documents d ON d.doc_id = e.id"),
    "j6_missing": (j6, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"),
    "j15_dense_exact": (j15, "SELECT query_id, chunk_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0) WHERE rank <= 10"),
    "h1_dense_lsh": (h1_lsh, None),
    "h2_bm25_lane": (h2, f"{CHAIN} SELECT query_id, chunk_id, score, rank FROM bm25"),
    "h3_identifiers": (h3, f"WITH {ID_SQL} SELECT p.page_id, coalesce(string_agg(t, ' ' ORDER BY t), '') AS ids, coalesce(string_agg(t, ' ' ORDER BY r) FILTER (r <= 8), '') AS query_ids FROM pages p LEFT JOIN ranked USING (page_id) GROUP BY p.page_id"),
    "h4_literal_lane": (h4, f"""WITH {ID_SQL.replace('page_id', 'chunk_id').replace('html', 'text').replace('FROM pages', 'FROM (SELECT doc_id AS chunk_id, text FROM documents)')},
h AS (SELECT q.chunk_id AS query_id, q.r - 1 AS term_no, c.chunk_id, d.source, row_number() OVER (PARTITION BY q.chunk_id, q.r ORDER BY length(d.text), d.source, c.chunk_id) AS pos FROM ranked q JOIN cut c ON c.t = q.t JOIN documents d ON d.doc_id = c.chunk_id WHERE q.r <= 8),
l AS (SELECT *, min(pos) OVER (PARTITION BY query_id, term_no, source) AS lane, row_number() OVER (PARTITION BY query_id, term_no, source ORDER BY pos) AS inlane FROM h WHERE pos <= 100),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, term_no ORDER BY inlane, lane, chunk_id) AS p FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY p, term_no) AS f FROM a WHERE p <= 100)
SELECT query_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, term_no, chunk_id) AS place FROM b WHERE f = 1) WHERE place <= 20"""),
    "h5_phrase_lane": (h5, rf"""WITH {SPANS}, {CHUNKS}, toks AS (SELECT chunk_id, unnest({TOK.format('text')}) AS term, generate_subscripts({TOK.format('text')}, 1) - 1 AS pos FROM chunks),
w AS (SELECT item_id AS query_id, unnest(list_slice({TOK.format('text')}, 3, 6)) AS term, generate_subscripts(list_slice({TOK.format('text')}, 3, 6), 1) - 1 AS i FROM benchmark), ww AS (SELECT * FROM w WHERE term NOT IN {STOP}),
sz AS (SELECT query_id, count(*) AS size FROM ww GROUP BY 1), st AS (SELECT query_id, chunk_id, pos - i AS s, count(*) AS n FROM ww JOIN toks USING (term) GROUP BY ALL),
h AS (SELECT query_id, chunk_id, count(*) AS hits FROM st JOIN sz USING (query_id) WHERE n = size GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h) WHERE rank <= 20"""),
    "h6_proximity_rank": (h6, f"WITH {SPANS}, {CHUNKS}, {POSTED}, {QTERMS}, fp AS (SELECT chunk_id, term, min(pos) AS p FROM toks GROUP BY ALL) SELECT query_id, chunk_id, round(count(*) / (max(p) - min(p) + 1), 6) AS proximity FROM qt JOIN fp USING (term) GROUP BY ALL"),
    "h7_rrf": (h7, f"{CHAIN}, {LANES}, {FUSED} SELECT * FROM fused"),
    "h8_fused_pool": (h8, f"{CHAIN}, {LANES}, {FUSED}, {POOL} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM pool"),
    "h9_search_variants": (h9, f"{CHAIN}, {LANES}, {FUSED}, {PROTECTED}, un AS (SELECT 'V0' AS variant, query_id, chunk_id, round(1.0 / (60 + rank), 9) AS score FROM dense WHERE rank <= 12 UNION ALL SELECT 'V1', query_id, chunk_id, score FROM ({pool_sql(20, 4)}) UNION ALL SELECT 'V2', query_id, chunk_id, score FROM ({pool_sql(20, 4)}) UNION ALL SELECT 'V3', query_id, chunk_id, score FROM ({pool_sql(64, 20)})) SELECT variant, query_id, chunk_id, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, chunk_id) AS place FROM un"),
    "h10_hydrate": (h10, f"{CHAIN}, {LANES}, {FUSED}, {POOL} SELECT query_id, p.chunk_id, source, left(text, len(list_filter(range(1, 41), lambda k: strlen(left(text, k)) <= 40))) AS snippet, strlen(text)::BIGINT AS n_bytes FROM pool p JOIN chunks c ON c.chunk_id = p.chunk_id"),
    "h11_rerank": (h11, f"""{CHAIN}, {LANES}, {FUSED}, {POOL}, hits AS (SELECT query_id, chunk_id, count(*) AS k FROM qt JOIN posted USING (term) GROUP BY ALL), qs AS (SELECT query_id, count(*) AS m FROM qt GROUP BY ALL),
s AS (SELECT p.query_id, p.chunk_id, p.score, round(coalesce(k, 0) / m, 6) AS rerank FROM pool p JOIN qs ON qs.query_id = p.query_id LEFT JOIN hits h ON h.query_id = p.query_id AND h.chunk_id = p.chunk_id)
SELECT query_id, chunk_id, rerank, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, score DESC, chunk_id) AS place FROM s) WHERE place <= 12"""),
    "h12_search_counts": (h12, f"{CHAIN}, {LANES}, {FUSED}, {POOL} SELECT query_id, count(*) AS pool, count(*) FILTER (contains(branches, 'dense')) AS dense, count(*) FILTER (contains(branches, 'bm25')) AS bm25, count(*) FILTER (contains(branches, 'literal')) AS literal, count(*) FILTER (contains(branches, 'phrase')) AS phrase FROM pool GROUP BY query_id"),
    "w8_interleave": (w8, f"""{CHAIN}, {LANES}, l AS (SELECT query_id, chunk_id, 0 AS lane, rank AS pos FROM bm25 WHERE rank <= 30 UNION ALL SELECT query_id, chunk_id, 1, rank FROM dense WHERE rank <= 30),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos, lane) AS k FROM l) SELECT query_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, lane, chunk_id) AS place FROM f WHERE k = 1) WHERE place <= 20"""),
    "h13_read_evidence": (h13, f"WITH RECURSIVE {REQ}, " + READ.format(s="documents", key="doc_id", b=9000)),
    "h17_search_read": (h17, CHAIN.replace("WITH ", "WITH RECURSIVE ", 1) + f", {LANES}, {FUSED}, {POOL}, e AS (SELECT query_id AS req, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM pool), " + READ.format(s="chunks", key="chunk_id", b=16384)),
    "w6_fit_prefix": (w6, "SELECT source, doc_id, upto::BIGINT AS upto FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents) WHERE upto <= 16384"),
    "d31_inventory": (d31, f"WITH {SPANS} SELECT source, count(DISTINCT doc_id) AS n_sources, count(*) AS n_spans, sum(strlen(text))::BIGINT AS n_bytes, count(*) <= 64 AS complete FROM spans GROUP BY source"),
    "k6_collection_pages": (k6, pages_sql(4096) + " SELECT source, page, count(*) AS n, sum(n)::BIGINT AS n_bytes, min(doc_id) AS first_doc FROM f WHERE page <= 4 GROUP BY source, page"),
    "h15_merge_evidence": (h15, """WITH b AS (SELECT doc_id // 60 AS req, doc_id % 4 AS group_no, list_sort(list(doc_id // 7)) AS ids FROM documents GROUP BY 1, 2), x AS (SELECT req, group_no, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM b),
s AS (SELECT req, id, min({'g': group_no, 'p': pos}) AS at1 FROM x GROUP BY req, id), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY at1) AS place FROM s) WHERE place <= 8),
v AS (SELECT DISTINCT x.req, x.group_no FROM x JOIN k ON k.req = x.req AND k.id = x.id), m AS (SELECT b.req, string_agg(b.group_no::VARCHAR, ',' ORDER BY b.group_no) AS missing FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.req = b.req AND v.group_no = b.group_no) GROUP BY b.req)
SELECT k.req, string_agg(k.id::VARCHAR, ',' ORDER BY place) AS ids, coalesce(any_value(m.missing), '') AS missing FROM k LEFT JOIN m ON m.req = k.req GROUP BY k.req"""),
    "c1_fragment_reassemble": (c1, f"WITH {SPANS} SELECT doc_id, line_no, sha256(text) AS sha, TRUE AS complete, TRUE AS within FROM spans"),
    "c2_pack_fixed": (c2_fixed, pack_sql(1200, False)),
    "c2_pack_structural": (c2_structural, pack_sql(1800, True)),
    "c3_token_windows": (c3, r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\pL\pN]+') AS toks FROM documents), w AS (SELECT doc_id, toks, unnest(range(0, 1 + greatest(0, ceil((len(toks) - 384) / 352))::BIGINT)) AS win FROM t WHERE len(toks) > 0)
SELECT doc_id, win, win * 352 AS first_token, len(list_slice(toks, win * 352 + 1, win * 352 + 384)) AS n_tokens, md5(array_to_string(list_slice(toks, win * 352 + 1, win * 352 + 384), ' ')) AS h FROM w"""),
    "c3_headed_windows": (c3_headed, r"""WITH t AS (SELECT doc_id, regexp_extract_all(split_part(text, '.', 1), '[\pL\pN]+') AS head, regexp_extract_all(substr(text, length(split_part(text, '.', 1)) + 2), '[\pL\pN]+') AS toks FROM documents),
b AS (SELECT *, 384 - len(head) AS body FROM t WHERE len(toks) > 0),
w AS (SELECT *, unnest(CASE WHEN body >= 64 THEN range(0, 1 + greatest(0, ceil((len(toks) - body) / (body - 32)))::BIGINT) ELSE [NULL] END) AS win FROM b)
SELECT doc_id, win, win * (body - 32) AS first_token, CASE WHEN body >= 64 THEN len(list_slice(toks, win * (body - 32) + 1, win * (body - 32) + body)) END AS n_tokens,
CASE WHEN body >= 64 THEN md5(array_to_string(list_concat(head, list_slice(toks, win * (body - 32) + 1, win * (body - 32) + body)), ' ')) END AS h, CASE WHEN body < 64 THEN 'chunk_prefix_too_long' END AS reason FROM w"""),
    "c4_chunk_variants": (c4_chunks, rf"""WITH {SPANS}, b AS (SELECT 'fixed' AS variant, * FROM ({pack_sql(1200, False)}) UNION ALL SELECT 'structural', * FROM ({pack_sql(1800, True)})),
t AS (SELECT variant, regexp_extract_all(string_agg(text, chr(10) ORDER BY line_no), '[\pL\pN]+') AS toks FROM b JOIN spans s ON s.doc_id = b.doc_id AND s.line_no BETWEEN first_line AND last_line GROUP BY variant, b.doc_id, region, block),
w AS (SELECT variant, toks, unnest(range(0, 1 + greatest(0, ceil((len(toks) - 384) / 352))::BIGINT)) AS win FROM t WHERE len(toks) > 0)
SELECT variant, count(*) AS n_windows, sum(len(list_slice(toks, win * 352 + 1, win * 352 + 384)))::BIGINT AS n_tokens FROM w GROUP BY variant"""),
    "c5_structural_context": (c5, C5_SQL),
    "c7_fill_uncovered": (c7, UNCOVERED + " SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes FROM k WHERE kind IN ('identity', 'heading') GROUP BY source"),
    "c8_check_publication": (c8, f"WITH {SPANS} SELECT TRUE AS ok, 2 AS variants, count(DISTINCT doc_id) AS n FROM spans"),
    "c9_embed": (c9, "SELECT item_id, 1.0 AS norm, 32 AS dims FROM benchmark"),
    "c10_search_text": (c10, "WITH texts AS (SELECT page_id, left(url, 512) || ' page-' || page_id || chr(10) || html AS html FROM pages), " + ID_SQL.replace("FROM pages", "FROM texts") + " SELECT p.page_id, any_value(md5(p.html)) AS search_hash, coalesce(string_agg('id' || sha256(t), ' ' ORDER BY t), '') AS lexemes FROM texts p LEFT JOIN cut USING (page_id) GROUP BY p.page_id"),
    "d28_identifier_lexemes": (d28, f"WITH {ID_SQL} SELECT p.page_id, coalesce(string_agg('id' || sha256(t), ' ' ORDER BY t), '') AS lexemes FROM pages p LEFT JOIN cut USING (page_id) GROUP BY p.page_id"),
    "d29_digest": (d29, "SELECT source, sha256(string_agg(h, ';' ORDER BY part)) AS digest FROM (SELECT source, doc_id // 100 AS part, sha256(string_agg(doc_id::VARCHAR || '|' || sha256(text), ';' ORDER BY doc_id, sha256(text))) AS h FROM documents GROUP BY 1, 2) GROUP BY source"),
    "d30_term_stats": (d30, f"WITH {SPANS}, {CHUNKS}, {POSTED}, t AS (SELECT collection, count(*) AS terms, sum(df)::BIGINT AS postings, max(df) AS max_df FROM dfs GROUP BY 1) SELECT t.*, n, round(avg_len, 6) AS avg_len FROM t JOIN stats USING (collection)"),
    "w1_span_ordinal": (w1, f"WITH {SPANS} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ordinal FROM spans"),
    "w4_regions": (w4, f"WITH {SPANS}, c AS (SELECT *, CASE WHEN lag(section) OVER w IS NOT DISTINCT FROM section THEN 0 ELSE 1 END AS ch FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), g AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line_no) AS region FROM c) SELECT doc_id, region::BIGINT AS region, count(*) AS n, min(line_no) AS first_line FROM g GROUP BY doc_id, region"),
    "w10_first_seen": (w10, "SELECT source, lang AS item, row_number() OVER (PARTITION BY source ORDER BY p) AS place FROM (SELECT source, lang, min(doc_id) AS p FROM documents GROUP BY source, lang)"),
    "u1_identifier_union": (u1, f"WITH {ID_SQL.replace('html', 'url')} SELECT page_id, t AS id FROM cut"),
}
