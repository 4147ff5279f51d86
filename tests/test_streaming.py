import json

from pyspark.sql import functions as F

from evispark.operators import ingest as I
from evispark.sources import files as S
from evispark.streaming import streams as X


def write_log(spark, folder, rows):
    spark.createDataFrame(rows, "run_id long, event_id long, kind string").coalesce(1).write.mode("append").parquet(folder)


def test_run_states_absorb_the_first_terminal_event(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = f"{tmp_path}/log"
    write_log(spark, log, [(1, 1, "view"), (1, 2, "completed"), (1, 3, "failed"), (2, 4, "view")])
    got = {}

    def take(batch, _):
        got.update({r["run_id"]: (r["state"], r["ignored"]) for r in batch.collect()})

    s = X.run_states(X.tail(spark, log, spark.read.parquet(log).schema))
    s.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {1: ("completed", 1), 2: ("running", 0)}


def test_requests_and_operations_over_batches(spark, tmp_path):
    schema = "k long, event_id long, body string, run_id long, op long, phase string"
    batches = [[(1, 1, "a", 1, 1, "start"), (1, 2, "a", 1, 1, "failed"), (2, 3, None, 1, 2, "start")], [(1, 4, "b", 2, 7, "end"), (2, 5, None, 1, 2, "end"), (2, 6, "c", 1, 3, "start")]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    s = X.tail(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema)
    got = X.drained(X.request_outcomes(s, ["k"], ["body"]), "append", f"{tmp_path}/c1", f"{tmp_path}/o1").collect()
    by_event = {r["event_id"]: r["outcome"] for r in got}
    assert by_event[1] == "created" and by_event[2] == "repeated" and by_event[4] == "conflict" and by_event[5] == "repeated" and by_event[6] == "conflict"
    ops = X.operation_inventory(X.drained(X.operation_changes(s), "append", f"{tmp_path}/c2", f"{tmp_path}/o2")).collect()
    assert {(r["run_id"], r["op"]): r["outcome"] for r in ops} == {(1, 1): "failed", (1, 2): "completed", (1, 3): "unknown", (2, 7): "poisoned"}


def test_ingest_is_idempotent_by_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb", "s"), (2, "c", "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs")
    build = lambda b: {"spans": I.line_spans(b).select("doc_id", "source", "line_no", "text")}
    for _ in range(2):  # the second run finds nothing new
        X.ingest(stream, f"{tmp_path}/lake", f"{tmp_path}/ck", build)
    assert S.published(spark, f"{tmp_path}/lake", "spans").count() == 3
    assert spark.read.parquet(f"{tmp_path}/lake/manifest").count() == 1


def test_every_batch_stays_readable(spark, tmp_path):
    docs = lambda *ids: spark.createDataFrame([(i, f"line {i}\nand more", "s") for i in ids], "doc_id long, text string, source string").coalesce(1)
    build = lambda b: {"spans": I.line_spans(b).select("doc_id", "source", "line_no", "text")}
    docs(0).write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(docs(0).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/docs")
    for more in ((), (1, 2), (3,)):
        if more:
            docs(*more).write.mode("append").parquet(f"{tmp_path}/docs")
        X.ingest(stream, f"{tmp_path}/lake", f"{tmp_path}/ck", build)
    every = lambda: sorted(r["doc_id"] for r in S.published(spark, f"{tmp_path}/lake", "spans", every=True).collect())
    assert every() == [0, 0, 1, 1, 2, 2, 3, 3]
    # a batch that is replayed after a crash replaces its own version and counts once
    S.publish(build(docs(3)), f"{tmp_path}/lake", version="batch-0000000002")
    assert every() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_replay_starts_after_the_cursor(spark):
    log = spark.createDataFrame([(i,) for i in (3, 1, 2)], "event_id int")
    assert [r["event_id"] for r in X.replay(log, 1).collect()] == [2, 3]


def test_scan_originals(spark, tmp_path):
    files = {"a.txt": b"\xef\xbb\xbfAlpha", "b.txt": b"\xff\xfe", "c.pdf": b"%PDF-1.7", "d.pdf": b"no", "e.txt": b"", "f.txt": b"x\x00y", "g.bin": b"z"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    # Spark's binary source leaves files of no bytes out
    got = {r["path"].rsplit("/", 1)[1]: (r["reason"], r["text"]) for r in S.scan_originals(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (None, "Alpha"), "b.txt": ("not_utf8", None), "c.pdf": (None, None), "d.pdf": ("type_mismatch", None), "f.txt": ("nul_byte", "x\x00y"), "g.bin": ("type_mismatch", None)}


def test_read_release_keeps_broken_files(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": 1, "corpus_id": "c", "document_count": 1, "documents": [{"doc_id": "d", "family_id": "f"}]}))
    (tmp_path / "questions.json").write_text(json.dumps([{"case_id": "q1", "turns": [{"role": "user", "text": "t"}]}]))
    (tmp_path / "gold.json").write_text("{broken")
    (tmp_path / "map.json").write_text(json.dumps({"schema_version": "1", "corpus_id": "c", "entries": [{"reference": {"doc_id": "d", "line_start": 1, "quote": "q"}, "source_sha256": "s", "outcome": "intact", "reviewed_by": "r", "extracted_locators": [{"line_start": 1, "text_sha256": "h"}]}]}))
    assert S.read_release(spark, str(tmp_path), str(tmp_path / "map.json"))["extraction"].select("entries.reference.doc_id", "entries.outcome").first() == (["d"], ["intact"])
    r = S.read_release(spark, str(tmp_path))
    assert "extraction" not in r
    assert r["manifest"].select(F.explode("documents.doc_id")).first()[0] == "d"
    assert r["questions"].first()["turns"][0]["text"] == "t"
    assert r["gold"].cache().where("_corrupt IS NOT NULL").count() == 1


def test_reports(spark, tmp_path):
    cells = spark.createDataFrame([("V3", 1, [1]), ("V0", 2, [2])], "variant string, n int, xs array<int>")
    S.write_report(cells, str(tmp_path))
    assert [r["variant"] for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()] == ["V0", "V3"]
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_requests_of_many_keys_go_round_in_groups(spark, tmp_path):
    """Groups of keys give what single keys give, over batches, for null keys and for keys that look alike once joined."""
    keys = [(None, "x"), ("", "x"), ("a|b", "c"), ("a", "b|c"), ("~", "x"), *((f"k{i}", "x") for i in range(200))]
    rows = [(n, *keys[n % len(keys)], None if n % 7 == 0 else f"body {n % 3 % 2}") for n in range(1_000)]
    fields = "event_id long, k string, l string, body string"
    for i in range(2):
        spark.createDataFrame(rows[500 * i : 500 * i + 500][::-1], fields).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = X.tail(spark, f"{tmp_path}/in/*", spark.createDataFrame([], fields).schema)
    got = {r["event_id"]: r["outcome"] for r in X.drained(X.request_outcomes(s, ["k", "l"], ["body"], parts=4), "append", f"{tmp_path}/c", f"{tmp_path}/o").collect()}
    first, want = {}, {}
    for n, k, l, body in rows:
        want[n] = "created" if (k, l) not in first else "repeated" if first[k, l] == body else "conflict"
        first.setdefault((k, l), body)
    assert got == want
