"""Forms that keep their cost in proportion to the rows: plans without a call for each group, bounded state, whole results."""

import os
import random

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from evispark.operators import ingest as I
from evispark.operators import retrieval as R
from evispark.plans import evidence_queries as Q
from evispark.plans import run_queries, stream_queries, timer_queries
from evispark.sources import files as S

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def greedy(lines, limit):
    blocks, size = [], 0
    for no, section, text in lines:
        n = len(text.encode()) + 1
        if not blocks or size + n > limit or section != blocks[-1][0]:
            blocks.append((section, []))
            size = 0
        blocks[-1][1].append((no, text))
        size += n
    return [(b[0][0], b[-1][0], "\n".join(t for _, t in b)) for _, b in blocks]


def test_blocks_hold_their_texts_in_one_sweep(spark):
    draw = random.Random(4)
    docs = {d: [(i + 1, f"s{i // 40}" if d % 2 else "", "wö" * draw.randint(1, 30)) for i in range(draw.choice((1, 3, 2500)))] for d in range(60)}
    rows = [(d, "a", no, text, section) for d, lines in docs.items() for no, section, text in lines]
    draw.shuffle(rows)
    s = spark.createDataFrame(rows, "doc_id long, source string, line_no int, text string, section string").repartition(3)
    packed = I.pack_blocks(s, 300, True, texts=True)
    got = sorted((r["doc_id"], r["first_line"], r["last_line"], r["text"]) for r in packed.collect())
    assert got == sorted((d, *b) for d, lines in docs.items() for b in greedy(lines, 300))
    assert all(len(r["text"].encode()) + 1 == r["n_bytes"] and r["text"].count("\n") + 1 == r["n_spans"] for r in packed.collect())
    assert "FlatMapGroupsInPandas" not in plan(packed)


def test_publication_and_variants_pack_without_a_call_for_each_region_or_a_join_of_lines_and_blocks(spark):
    assert "FlatMapGroupsInPandas" not in plan(Q.c8(spark, DATA))
    variants = plan(Q.c4_chunks(spark, DATA))
    assert "FlatMapGroupsInPandas" not in variants and "Join" not in variants


def test_originals_are_files_in_folders_whose_count_grows_with_them(spark, tmp_path):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(50)], "doc_id long, text string")
    folders = S.write_originals(docs, f"file://{tmp_path}/files", per_folder=20)
    assert len(folders) == 3
    got = S.scan_folders(spark, folders, f"file://{tmp_path}/scanned", lambda x: x.where("reason IS NULL").select("text", "size")).collect()
    assert sorted(r["text"] for r in got) == sorted(f"text {i}\n" for i in range(50))
    assert max(sum(f.endswith(".txt") for _, _, fs in os.walk(p[7:]) for f in fs) for p in folders) < 50


def test_originals_on_a_disk_are_written_by_tasks_and_are_files_only(spark, tmp_path):
    """Hadoop's local file system makes a checksum file beside each original and runs chmod for both."""
    docs = spark.createDataFrame([(i, f"text {i}\r\né") for i in range(50)], "doc_id long, text string")
    folders = S.write_originals(docs, f"file://{tmp_path}/files", per_folder=20)
    found = [os.path.join(top, f) for p in folders for top, _, fs in os.walk(p[7:]) for f in fs]
    assert len(found) == 50 and all(f.endswith(".txt") for f in found)
    assert sorted(open(f, "rb").read() for f in found) == sorted(f"text {i}\r\né\n".encode() for i in range(50))
    S.put_files(f"{tmp_path}/files", [Row(folder=0, id=7, content=b"old"), Row(folder=0, id=7, content=b"a task that runs again")])
    assert open(f"{tmp_path}/files/folder=0/part-7.txt", "rb").read() == b"a task that runs again\n"
    assert not [f for f in os.listdir(f"{tmp_path}/files/folder=0") if f.startswith(".")]


def test_originals_in_another_store_are_written_by_spark(spark, tmp_path, monkeypatch):
    assert [S.on_disk(spark, p) for p in ("file:///a/b", "file:/a/b", "/a/b", "hdfs://n:8020/a", "s3a://b/a", "viewfs://store/a")] == ["/a/b"] * 3 + [None] * 3
    monkeypatch.setattr(S, "on_disk", lambda spark, path: None)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    for per, n in ((20, 3), (100, 1)):
        folders = S.write_originals(docs, f"file://{tmp_path}/files{n}", per_folder=per)
        assert len(folders) == n
        got = S.scan_folders(spark, folders, f"file://{tmp_path}/scanned{n}", lambda x: x.where("reason IS NULL").select("text")).collect()
        assert sorted(r["text"] for r in got) == sorted(f"text {i}\n" for i in range(50))


def test_scan_of_originals_equals_its_sql_on_odd_tables(spark, tmp_path):
    odd = [(1, "a\nb"), (1, "a\nb"), (2, ""), (3, None), (None, None), (4, "\ufeffé\r\n"), (5, "𝄞" * 40_000)]
    for i, rows in enumerate((odd, [], [(1, None)])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{i}/documents.parquet/*.parquet'")
        f, sql = stream_queries.QUERIES["s3_scan_originals"]
        assert list(map(tuple, f(spark, f"{tmp_path}/{i}").collect())) == con.execute(sql).fetchall()


def test_coverage_is_unknown_where_no_claim_is_listed(spark, tmp_path):
    rows = [(1, 0, "a" * 19), (1, 1, "a" * 38), (2, 0, "a"), (3, 0, "a"), (3, 1, "a" * 19), (4, 0, "a" * 19), (4, 0, "a" * 19)]
    t = spark.createDataFrame([(*r[:2], "user", r[2]) for r in rows], "conv_id long, turn long, role string, text string")
    t.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    want = duckdb.connect()
    want.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, run_queries.j19(spark, str(tmp_path)).select("case_id", "covered").collect()))
    assert got == sorted(want.execute(run_queries.QUERIES["j19_judge_coverage"][1]).fetchall())
    assert got[0] == (1, None) and got[3] == (4, False)


def test_leases_take_a_table_in_any_order(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").where("event_id < 400")
    copies = e.join(spark.range(3).toDF("k")).withColumn("event_id", F.col("event_id") + 1000 * F.col("k")).drop("k")
    copies.orderBy(F.md5(F.col("event_id").cast("string"))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = timer_queries.r6_stream(spark, str(tmp_path), rows=500)
        names = ["item", "attempt", "event_id", "outcome"]
        got = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = con.execute(timer_queries.R6_SQL).fetchall()
    assert got == sorted(rows, key=repr) and len(got) > 500


def test_dense_lane_in_passes_keeps_ties_and_sends_few_rows(spark):
    draw = random.Random(2)
    vectors = [[round(draw.random(), 1), round(draw.random(), 1)] for _ in range(400)] + [[1.0, 0.0]] * 300
    v = spark.createDataFrame([(i % 2, i, x) for i, x in enumerate(vectors)], "collection int, chunk_id long, v array<double>").repartition(3)
    q = v.where("chunk_id % 20 = 0").select("collection", F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"))
    score = lambda a, b: round(a[0] * b[0] + a[1] * b[1], 6)
    want = []
    for n in range(0, 700, 20):
        best = sorted((i for i in range(n % 2, 700, 2)), key=lambda i: (-score(vectors[n], vectors[i]), i))[:7]
        want += [(n, i, r + 1) for r, i in enumerate(best)]
    for at_once in (8192, 10):
        got = R.dense_lane(q, v, 7, at_once=at_once)
        assert sorted(map(tuple, got.select("query_id", "chunk_id", "rank").collect())) == sorted(want)
    assert R._nearest(q, v.coalesce(1), 7).count() < 35 * 3 * 14


def test_lsh_lane_joins_no_pairs_and_finds_the_nearest(spark):
    got = Q.h1_lsh(spark, DATA)
    assert "Join" not in plan(got)
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.lit(1).alias("collection"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    exact = R.dense_lane(v.where("chunk_id % 20 = 0").select("collection", F.col("chunk_id").alias("query_id"), F.col("v").alias("qv")), v, 10)
    pairs = lambda df: {tuple(r) for r in df.select("query_id", "chunk_id").collect()}
    assert len(pairs(got) & pairs(exact)) >= 0.9 * len(pairs(exact))


def test_lanes_over_bags_equal_lanes_over_postings(spark, monkeypatch):
    draw = random.Random(6)
    words = "alpha beta the gamma delta of epsilon zeta 7 ÉTÉ".split()
    rows = [(f"c{i % 3}", i, " ".join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(300)] + [("c0", 301, None), (None, 302, "alpha beta")]
    c = spark.createDataFrame(rows + [("c2", 4, "alpha alpha beta zeta")], "collection string, chunk_id long, text string").repartition(5)  # chunk 4 stands in two collections
    q = spark.createDataFrame([(i, " ".join(draw.choices(words, k=draw.randint(1, 5)))) for i in range(30)] + [(30, "the of"), (31, "")], "query_id long, text string")
    terms, old = R.query_terms(q), R.postings(c)
    b = R.bags(c, R.asked_words(terms))
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    names = ["query_id", "chunk_id", "score", "rank"]
    want = rows_of(R.bm25_lane(q, old, 20).select(*names))
    assert rows_of(R.bm25_bags(terms, b, 20).select(*names)) == want and len(want) > 400
    p = q.select("query_id", F.lit(0).alias("phrase_no"), F.col("text").alias("phrase"))
    once, alone = b.where("chunk_id <> 4"), old.where("chunk_id <> 4")
    names4 = ["query_id", "chunk_id", "hits", "rank"]
    assert rows_of(R.phrase_bags(p, once).select(*names4)) == rows_of(R.phrase_lane(p, alone).select(*names4))
    assert rows_of(R.proximity_bags(q, once)) == rows_of(R.proximity_rank(q, alone))
    monkeypatch.setattr(R, "TERMS_TO_BROADCAST", 3)
    assert rows_of(R.bm25_bags(terms, b, 20).select(*names)) == want


def test_lanes_shuffle_no_postings(spark):
    """Chunks are scored where their words are counted: of the postings no row goes through a shuffle but sums and each task's best."""
    c = spark.createDataFrame([("a", i, f"alpha beta {i}") for i in range(50)], "collection string, chunk_id long, text string")
    q = spark.createDataFrame([(1, "alpha 7"), (2, "beta")], "query_id long, text string")
    b = R.bags(c, R.asked_words(R.query_terms(q)))
    assert "Exchange" not in plan(b) and "Exchange" not in plan(R.proximity_bags(q, b))
    lane = plan(R.bm25_bags(R.query_terms(q), b, 5))
    assert lane.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in lane
