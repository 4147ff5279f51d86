"""Versioned tables: deletes, merges, old versions, untouched files, replays and conflicts over several batches."""

import pytest

from evispark.sources.versions import Store, delete_sources, register

SOURCES = "id long, collection_id string, status string"


def files(store, name, version=None):
    return store.manifest(version)[1][name]["folders"]


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    src = spark.createDataFrame([(i, "ab"[i % 2], "ready" if i % 3 else "failed") for i in range(20)], SOURCES)
    rows = spark.createDataFrame([(i, k, f"text {i} {k}") for i in range(20) for k in range(3)], "id long, line int, text string")
    counters = spark.createDataFrame([("a", 0, 10, 6, 4), ("b", 0, 10, 7, 3)], "collection_id string, revision long, source_count long, ready_count long, unavailable_count long")
    s.create({"sources": (src, ["id"]), "spans": (rows, ["id"]), "chunks": (rows.limit(0), ["id"]), "counters": (counters, ["collection_id"])}, buckets=8)
    return s


def test_deletes_rewrite_touched_buckets_only(spark, store):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    before = files(store, "spans")
    assert delete_sources(store, ids(3, 4, 99), ["spans", "chunks"]) == 1
    after, hit = files(store, "spans"), set(store.touched("spans", ids(3, 4)))
    assert {b for b in before if before[b] != after.get(b)} == hit and 0 < len(hit) < 8
    assert {r["id"] for r in store.read("spans").collect()} == set(range(20)) - {3, 4}
    assert store.read("spans", 0).count() == 60 and store.read("sources", 0).where("status = 'deleted'").count() == 0
    counts = lambda: sorted(tuple(r) for r in store.read("counters").collect())
    # 3 failed and 4 was ready
    assert counts() == [("a", 1, 9, 5, 4), ("b", 1, 9, 7, 2)]
    assert delete_sources(store, ids(3, 4, 99), ["spans", "chunks"]) == 1  # a replay, and unknown ids, change nothing
    assert delete_sources(store, ids(), ["spans"]) == 1
    assert delete_sources(store, ids(*range(20)), ["spans", "chunks"]) == 2
    assert store.read("spans").count() == 0 and store.read("spans", 1).count() == 54 and counts() == [("a", 10, 0, 0, 0), ("b", 10, 0, 0, 0)]
    assert store.read("sources").where("status = 'deleted'").count() == 20


def test_a_version_appears_whole_or_not_at_all(spark, store):
    version, tables = store.manifest()
    store.write("spans", store.read("spans").limit(1), ["id"], 8)  # a change that fails before its manifest
    assert store.manifest()[0] == version and store.read("spans").count() == 60
    store.commit(version + 1, tables)
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(version + 1, tables)  # another writer was first
    with pytest.raises(ValueError):
        store.create({})
    with pytest.raises(ValueError):
        store.manifest(77)


def test_registration_over_batches(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    schema, key, facts = "id long, c string, req string, sha string, title string", ["c", "req"], ["sha", "title"]
    none = spark.createDataFrame([], schema)
    s.create({"sources": (none, key), "conflicts": (none, key)}, buckets=4)
    batches = [
        [(1, "a", "r1", "x", None), (2, "a", "r1", "x", None), (3, "a", "r2", "y", "t"), (4, "b", "r1", "z", "t"), (5, "b", "r1", "other", "t")],
        [(6, "a", "r1", "x", None), (7, "a", "r2", "y", "changed"), (8, None, None, "n", "t"), (9, "a", "r3", "w", "t")],
        [(10, None, None, "n", "t"), (11, None, None, "m", "t"), (1, "a", "r1", "x", None)],
    ]
    want = [
        {1: ("kept", 1), 2: ("replay", 1), 3: ("kept", 3), 4: ("kept", 4), 5: ("conflict", 4)},
        {6: ("replay", 1), 7: ("conflict", 3), 8: ("kept", 8), 9: ("kept", 9)}, {10: ("replay", 8), 11: ("conflict", 8), 1: ("replay", 1)},
    ]
    for b, w in zip(batches, want):
        got = {r["id"]: (r["outcome"], r["kept_id"]) for r in register(s, spark.createDataFrame(b, schema), key, facts, "id").collect()}
        assert got == w
    assert sorted(r["id"] for r in s.read("sources").collect()) == [1, 3, 4, 8, 9] and sorted(r["id"] for r in s.read("conflicts").collect()) == [5, 7, 11]
    version = s.manifest()[0]
    for b in batches:  # replays of whole batches: no new rows, no conflict twice, no version
        assert "kept" not in {r["outcome"] for r in register(s, spark.createDataFrame(b, schema), key, facts, "id").collect()}
    assert s.manifest()[0] == version and s.read("sources", 0).count() == 0 and s.read("conflicts").count() == 3
