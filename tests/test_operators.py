from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evispark.operators import costs as C
from evispark.operators import evaluation as V
from evispark.operators import evidence as E
from evispark.operators import guards as G
from evispark.operators import ingest as I
from evispark.operators import retrieval as R
from evispark.operators import runs as N
from evispark.streaming.streams import inventory_step, pair_step


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_line_spans(spark):
    rows = I.line_spans(docs(spark, "# Sample\n\n Alpha value 10 units \r\nx", "", None)).orderBy("doc_id", "line_no").collect()
    assert [(r["line_no"], r["text"], r["section"]) for r in rows] == [(1, "# Sample", "Sample"), (3, "Alpha value 10 units", "Sample"), (4, "x", "Sample")]


def test_reject_oversize(spark):
    rows = {r["doc_id"]: r["reason"] for r in I.reject_oversize(docs(spark, "a\nb\nc", "é" * 6, " \n ", "ok"), 2, 10).collect()}
    assert rows == {0: "too_many_lines", 1: "line_too_long", 2: "no_text", 3: None}


def test_fragments_rebuild_their_span(spark):
    text = "é" * 50 + " tail word " + "😀" * 30
    f = I.fragment_spans(I.line_spans(docs(spark, text, "short")), 40)
    assert f.agg(F.max(F.octet_length("text"))).first()[0] <= 40
    whole = {r["doc_id"]: (r["text"], r["complete"]) for r in E.reassemble(f).collect()}
    assert whole == {0: (text, True), 1: ("short", True)}
    assert [r["ordinal"] for r in f.where("doc_id = 0").orderBy("ordinal").collect()] == list(range(1, f.where("doc_id = 0").count() + 1))


def test_pieces_end_at_blanks_of_the_second_half(spark):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("aé日😀 \t\n") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["a" * 50, " " * 50, "", "😀" * 9]
    for limit in (8, 13):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", I.text_pieces(F.col("text"), limit).alias("p")).collect()
        for r in rows:
            assert "".join(r["p"]) == r["text"]
            rest = r["text"]
            for piece in r["p"]:
                # brute force: the longest of the prefixes that end after a blank of the second half, or else of all prefixes
                fits = [rest[:k] for k in range(1, len(rest) + 1) if len(rest[:k].encode()) <= limit]
                blanks = [x for x in fits if x[-1] in " \t" and len(x.encode()) > limit // 2]
                assert piece == (rest if fits and fits[-1] == rest else (blanks or fits)[-1])
                rest = rest[len(piece):]


def test_pack_blocks_breaks_on_size_and_section(spark):
    b = I.pack_blocks(I.line_spans(docs(spark, "aaaa\nbbbb\ncccc\n# h\ndddd")), 10, True).orderBy("first_line").collect()
    assert [(r["first_line"], r["last_line"]) for r in b] == [(1, 2), (3, 3), (4, 5)]


def test_token_windows(spark):
    w = I.token_windows(docs(spark, " ".join(f"w{i}" for i in range(25)), "..."), ["doc_id"], 10, 2).orderBy("win").collect()
    assert [(r["first_token"], r["n_tokens"]) for r in w] == [(0, 10), (8, 10), (16, 9)]


def test_headed_windows_take_the_header_off_the_width(spark):
    body = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "a b", body), (2, " ".join("abcdefg"), body), (3, None, "x"), (4, "h", "..."), (5, "h", None)]
    got = I.headed_windows(spark.createDataFrame(rows, "doc_id int, header string, text string"), ["doc_id"], "header", 10, 2, 4).orderBy("doc_id", "win").collect()
    assert [(r["doc_id"], r["first_token"], r["n_tokens"], r["reason"]) for r in got] == [(1, 0, 8, None), (1, 6, 8, None), (1, 12, 8, None), (1, 18, 7, None), (2, None, None, "chunk_prefix_too_long"), (3, 0, 1, None)]
    assert got[0]["text"] == "a b w0 w1 w2 w3 w4 w5 w6 w7" and got[3]["text"].startswith("a b w18")


def test_structural_context(spark):
    x = I.structural_context(I.line_spans(docs(spark, "patient: 7 | ward\nplain text\nHEAD\na | b\n1 | 2\nmore:"))).orderBy("line_no").collect()
    assert [r["kind"] for r in x] == ["identity", "prose", "heading", "row", "row", "heading"]
    assert [r["table_header"] for r in x] == [None, None, None, 4, 4, None]
    assert [r["section_header"] for r in x] == [None, None, 3, 3, 3, 6]


def test_interleave_is_round_robin(spark):
    rows = [(1, "a", 0, 1), (1, "b", 0, 2), (1, "a", 1, 1), (1, "c", 1, 2)]
    got = R.interleave(spark.createDataFrame(rows, "query_id int, chunk_id string, lane int, pos int"), 9, ["query_id"]).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b", "c"]


def test_bm25_or_semantics_and_rank(spark):
    chunks = spark.createDataFrame([("c", 1, "alpha beta"), ("c", 2, "alpha alpha gamma"), ("c", 3, "delta")], "collection string, chunk_id long, text string")
    q = spark.createDataFrame([(1, "alpha unknown")], "query_id int, text string")
    got = R.bm25_lane(q, R.postings(chunks)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 1]


def test_phrase_needs_adjacent_words(spark):
    chunks = spark.createDataFrame([("c", 1, "Alpha recorded 5 mg"), ("c", 2, "recorded Alpha 5 mg")], "collection string, chunk_id long, text string")
    p = spark.createDataFrame([(1, 0, "alpha recorded")], "query_id int, phrase_no int, phrase string")
    assert [r["chunk_id"] for r in R.phrase_lane(p, R.postings(chunks)).collect()] == [1]


def test_protected_rows_displace_but_do_not_move_up(spark):
    fused = spark.createDataFrame([(1, i, 1.0 / i, "x") for i in range(1, 6)], "query_id int, chunk_id int, score double, branches string")
    prot = spark.createDataFrame([(1, 5)], "query_id int, chunk_id int")
    got = R.fused_pool(fused, prot, 3).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == [1, 2, 5]


def test_dense_plan_has_no_cartesian_product(spark):
    v = spark.createDataFrame([(1, i, [1.0, float(i)]) for i in range(4)], "collection int, chunk_id int, v array<double>")
    q = v.select("collection", F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"))
    plan = R.dense_lane(q, v, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_embed_has_unit_norm(spark):
    r = R.embed(docs(spark, "a b c a"), "text", 16).first()["v"]
    assert abs(sum(x * x for x in r) - 1) < 1e-12


def test_rerank_with_a_scorer(spark):
    pool = spark.createDataFrame([("q", "t t"), ("q", "t")], "question string, text string")
    got = R.rerank_with(pool, lambda: lambda qs, ts: [float(len(t)) for t in ts]).collect()
    assert sorted(r["rerank"] for r in got) == [1.0, 3.0]


def test_pack_skip_and_exact_budget(spark):
    spans = spark.createDataFrame([(1, "é" * 8 + "a"), (2, "b" * 30), (3, "c")], "id long, text string")
    req = spark.createDataFrame([(1, [1, 2, 3, 1, 9])], "req int, ids array<long>")
    assert E.read_evidence(req, spans, 18).first()["ids"] == "1,3"
    assert E.read_evidence(req, spans, 17).first()["ids"] == "1"
    assert E.read_evidence(req, spans, 16).first()["ids"] == "3"


def test_fit_prefix_stops(spark):
    s = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 1)], "g string, i int, n int")
    assert [r["i"] for r in E.fit_prefix(s, "g", ["i"], 10).collect()] == [1]


def test_inventory_boundary(spark):
    rows = [("a", 1, "x")] * 64 + [("b", 1, "x")] * 65
    got = {r["source"]: r["complete"] for r in E.inventory(spark.createDataFrame(rows, "source string, doc_id int, text string")).collect()}
    assert got == {"a": True, "b": False}


def test_strict_lookup_rejects_the_request(spark):
    ids = spark.createDataFrame([(1, [1, 1]), (2, [1, 5])], "req int, ids array<int>")
    s = spark.createDataFrame([(1, "x")], "id int, t string")
    assert {(r["req"], r["accepted"]) for r in E.lookup_strict(ids, s).collect()} == {(1, True), (2, False)}
    assert E.lookup_lenient(ids, s).count() == 3


def test_retry_chain_missing_and_cycle(spark):
    rows = [(1, None), (2, 1), (3, 2), (7, 99), (8, 9), (9, 8)]
    got = {r["id"]: (r["root"], r["hops"], r["valid"]) for r in N.retry_root(spark.createDataFrame(rows, "id long, retry_of long")).collect()}
    assert got[1] == (1, 0, True) and got[3] == (1, 2, True)
    assert not got[7][2] and not got[8][2] and not got[9][2]


def test_pair_operations(spark):
    rows = [(1, 1, "start", 1), (1, 1, "end", 2), (1, 2, "start", 3), (1, 3, "end", 4), (1, 4, "start", 5), (1, 4, "end", 6), (1, 4, "end", 7)]
    got = {r["op"]: r["outcome"] for r in N.pair_operations(spark.createDataFrame(rows, "run_id int, op int, phase string, at int")).collect()}
    assert got == {1: "completed", 2: "open", 3: "orphan_end", 4: "duplicate_end"}


def test_stream_pairing_poisons_a_run():
    state, out = pair_step(None, [(1, "start"), (1, "end"), (2, "start")])
    assert out == [(1, "completed")] and state == (2, False)
    state, out = pair_step(state, [(3, "start"), (2, "end")])
    assert [o for _, o in out] == ["poisoned", "poisoned"] and state[1]


def test_operation_inventory_keeps_failed_and_open_ones():
    state, out = inventory_step(None, [(1, "start"), (1, "failed"), (2, "start")])
    assert out == ["unknown", "failed", "unknown"]
    state, out = inventory_step(state, [(2, "end"), (1, "start"), (3, "start")])
    assert out == ["completed", "poisoned", "poisoned"]  # an op can't start twice
    assert inventory_step(None, [(1, "end")])[1] == ["poisoned"]


def test_run_lifecycle(spark):
    runs = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True), (5, False)], "id long, fresh boolean")
    events = spark.createDataFrame([(1, 1, "done"), (1, 2, "bad"), (2, 3, "done"), (3, 4, "done"), (5, 5, "bad"), (4, 6, "x")], "run_id long, event_id long, kind string").withColumn("at", F.col("event_id"))
    got = {r["id"]: (r["state"], r["ignored"]) for r in N.run_lifecycle(runs.union(spark.createDataFrame([(6, True)], runs.schema)), events, ["done", "bad"], ["done"]).collect()}
    assert got == {1: ("done", 1), 2: ("scope_expired", 0), 3: ("scope_expired", 0), 4: ("running", 0), 5: ("bad", 0), 6: ("queued", 0)}


def test_call_cost_labels_and_long_context(spark):
    calls = [("a", "gpt-6-sol", 1000, 0, 0, 100), ("b", "x", 1, 0, 0, 1), ("c", "gpt-6-sol", None, 0, 0, 1), ("d", "gpt-6-sol", 5, 9, 0, 1), ("e", "gpt-6-sol", 50, 1, 1, 1), ("f", "gpt-6-luna", 272001, 1, 0, 10), ("g", "gpt-6-luna", 0, 0, 0, 0)]
    df = spark.createDataFrame(calls, "call string, model string, input_tokens long, cached_tokens long, write_tokens long, output_tokens long")
    got = {r["call"]: (r["cost"], r["limitation"]) for r in C.call_cost(df).collect()}
    assert got["a"] == (Decimal("0.003000000000"), None)
    assert got["b"][1] == "unsupported_model" and got["c"][1] == "missing_or_invalid_bucket" and got["d"][1] == "partitions_exceed_total" and got["e"][1] == "cache_write_unverified"
    assert got["f"][0] == 2 * (Decimal(272000) * Decimal("0.10") + Decimal("0.01")) / 10**6 + Decimal("1.5") * 10 * Decimal("0.50") / 10**6
    assert got["g"][0] == 0
    total = C.cost_group(C.call_cost(df).withColumn("k", F.lit(1)), ["k"]).first()
    assert total["total"] is None and total["known"] == 3


def test_judge_state_precedence(spark):
    rows = [("failed", None, "pass", True, None), ("completed", None, None, True, None), ("completed", "no_budget", None, True, None), ("completed", None, "pass", False, None), ("completed", None, "pass", True, None)]
    df = spark.createDataFrame(rows, "state string, judge_na_reason string, verdict string, coverage boolean, x string")
    assert [r["na_reason"] for r in V.judge_state(df).collect()] == ["failed", "missing_judge", "no_budget", "invalid_judge_coverage", None]


def test_evidence_availability_is_null_when_unknown(spark):
    df = spark.createDataFrame([(1, [[[1, 2], [3]]], [3]), (2, [[[1]], [[]]], [1]), (3, [[[1]]], None)], "case_id int, claims array<array<array<int>>>, available array<int>")
    got = {r["case_id"]: (r["known"], r["case_ok"]) for r in V.evidence_availability(df).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, None)}


def test_guard_labels(spark):
    c = "array<struct<text string, evidence_ids array<int>>>"
    rows = [(1, "supported", [("a", [1])], [1]), (2, "supported", [("a", [7])], [1]), (3, "partial", [("a", [])], [1]), (4, "supported", [], [1])]
    got = [r["violation"] for r in G.guard(spark.createDataFrame(rows, f"id int, status string, claims {c}, delivered array<int>")).orderBy("id").collect()]
    assert got == [None, "citation_outside_delivered", "claim_without_citation", "supported_without_claims"]


def test_bounded_history_keeps_newest(spark):
    m = spark.createDataFrame([(1, t, "user", "x" * 10) for t in range(6)], "conv_id int, turn int, role string, text string")
    got = N.bounded_history(m, 4, 25).orderBy("turn").collect()
    assert [(r["turn"], r["n_bytes"], r["omitted"]) for r in got] == [(2, 6, True), (3, 6, True), (4, 6, True), (5, 6, True)]


def test_bootstrap_is_reproducible(spark):
    p = spark.createDataFrame([(f"f{i % 5}", i % 3 == 0, i % 2 == 0) for i in range(40)], "family string, success_a boolean, success_b boolean")
    a, b = V.bootstrap_ci(p, "family", "s", 50).first(), V.bootstrap_ci(p, "family", "s", 50).first()
    assert a == b and a["low"] <= a["high"]


@pytest.mark.parametrize("quote,hit", [("one two three four five six seven eight", True), ("ne two three four five six seven eigh", True), ("two  three", True), ("nine ten", False)])
def test_quote_support(spark, quote, hit):
    q = spark.createDataFrame([(1, quote)], "item_id long, text string")
    d = spark.createDataFrame([(5, "zero one two three\nfour five six seven eight nine")], "doc_id long, text string")
    assert (V.quote_support(q, d).count() == 1) == hit


def test_retry_root_of_any_depth_within_a_conversation(spark):
    rows = [(i, i - 1 if i else None, 1) for i in range(301)] + [(1000, 1002, 1), (1001, 1000, 1), (1002, 1001, 1), (1003, 1000, 1), (2000, 5, 2), (2001, 2000, 2), (3000, 9999, 1)]
    got = {r["id"]: (r["root"], r["hops"], r["valid"]) for r in N.retry_root(spark.createDataFrame(rows, "id long, retry_of long, conv long"), conversation="conv").collect()}
    assert all(got[i] == (0, i, True) for i in range(301))
    assert all(got[i] == (None, None, False) for i in (1000, 1001, 1002, 1003, 2000, 2001, 3000))


@pytest.mark.parametrize("words", [1, 2, 3, 5, 6, 7, 12])
def test_quotes_of_any_length(spark, words):
    text = [f"word{i}" for i in range(4000)]
    quote = " ".join(text[1000 : 1000 + words])[2:-1] if words > 1 else text[1000]
    d = spark.createDataFrame([(1, "  ".join(text)), (2, "other " * 50), (3, None)], "doc_id long, text string")
    got = V.quote_support(spark.createDataFrame([(7, quote), (8, "not in any text of them all here")], "item_id long, text string"), d).collect()
    assert [(r["item_id"], r["doc_id"]) for r in got] == [(7, 1)]
