"""Versioned tables in buckets: copy-on-write deletes, merges of new rows, and readers that see one version whole.

A store is a folder. ``data/<table>/<version>/bucket=<b>`` holds files that never change once written; ``manifest/version=<n>`` lists, for
each table and bucket, the folder that version n reads. A version exists when its manifest (one file) has been committed, so
readers see all of it or nothing, and older versions stay readable. A change writes only the buckets that it touches and lists
the other buckets' folders as they are. A failed change leaves folders that no manifest names; its retry takes a new folder.

One writer at a time: two writers from the same version would both write version n + 1, and the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import written

BUCKETS = 64
MANIFEST = "name string, bucket int, folder string, keys array<string>, buckets int, columns string"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row; nulls count as a value."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), F.lit(buckets)).cast("int")


class Store:
    """A folder of versioned tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, dict]]:
        """(version, tables): of each table its keys, buckets, columns and the folder of each bucket; (-1, {}) before the first."""
        try:
            m = self.spark.read.schema(f"{MANIFEST}, version int").parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, {}
        if version is None:
            version = m.agg(F.max("version")).first()[0]
        tables: dict[str, dict] = {}
        for r in m.where(F.col("version") == version).collect():  # a row a table and bucket
            t = tables.setdefault(r["name"], {"keys": r["keys"], "buckets": r["buckets"], "columns": r["columns"], "folders": {}})
            if r["bucket"] is not None:
                t["folders"][r["bucket"]] = r["folder"]
        if not tables:
            raise ValueError(f"no version {version}")
        return version, tables

    def commit(self, version: int, tables: dict[str, dict]) -> int:
        """Writes the manifest of ``version``: from then on it exists. Refused if another writer has made it."""
        rows = []
        for name, t in tables.items():
            rows += [(name, b, f, t["keys"], t["buckets"], t["columns"]) for b, f in t["folders"].items()] or [(name, None, None, t["keys"], t["buckets"], t["columns"])]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.root}/manifest/version={version}")
        return version

    def write(self, name: str, rows: DataFrame, keys: list[str], buckets: int) -> dict:
        """Writes rows to new folders, one a bucket that has rows, and says which."""
        folder = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        kept = rows.withColumn("bucket", bucket_of(keys, buckets))
        kept.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        made = [r["bucket"] for r in self.spark.read.schema("bucket int").parquet(folder).distinct().collect()]
        return {"keys": keys, "buckets": buckets, "columns": rows.schema.json(), "folders": {b: f"{folder}/bucket={b}" for b in made}}

    def create(self, tables: dict[str, tuple[DataFrame, list[str]]], buckets: int = BUCKETS) -> int:
        """The first version: name -> (rows, keys)."""
        version, _ = self.manifest()
        if version >= 0:
            raise ValueError("the store exists")
        return self.commit(0, {name: self.write(name, rows, keys, buckets) for name, (rows, keys) in tables.items()})

    def read(self, name: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of a version (the latest by default), or some of its buckets."""
        t = self.manifest(version)[1][name]
        schema = StructType.fromJson(json.loads(t["columns"]))
        folders = [f for b, f in t["folders"].items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of a table that rows with its keys fall into: as many as the table has, at most."""
        t = self.manifest()[1][name]
        return sorted(r["b"] for r in rows.select(bucket_of(t["keys"], t["buckets"]).alias("b")).distinct().collect())

    def rewritten(self, tables: dict[str, dict], name: str, rows: DataFrame, touched: list[int]) -> dict:
        """The table's entry with the touched buckets replaced by what rows hold."""
        t = tables[name]
        new = self.write(name, rows, t["keys"], t["buckets"])
        return new | {"folders": {b: f for b, f in t["folders"].items() if b not in touched} | new["folders"]}


def delete_sources(store: Store, deleted: DataFrame, dependants: list[str], sources: str = "sources", counters: str = "counters") -> int:
    """Deletes sources (id): marks them, removes their rows from dependent tables (keyed by ``id``), and moves counters by deltas.

    A counter row (collection_id, revision, source_count, ready_count, unavailable_count) goes up a revision and down a source for
    each source that wasn't deleted before; ids that are unknown or deleted change nothing. Buckets without such a source are
    not rewritten; if there is none at all no version is made.
    """
    version, tables = store.manifest()
    ids = deleted.select("id").distinct()
    touched = store.touched(sources, ids)
    rows = store.read(sources, only=touched)
    gone = written(rows.join(ids, "id", "left_semi").where("status <> 'deleted'"))
    deltas = written(gone.groupBy("collection_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ready").alias("ready")))
    if deltas.isEmpty():
        return version
    touched = store.touched(sources, gone)
    new = dict(tables)
    marked = store.read(sources, only=touched).join(gone.select("id", F.lit(True).alias("_gone")), "id", "left")
    marked = marked.withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).select(*rows.columns)
    new[sources] = store.rewritten(tables, sources, marked, touched)
    for name in dependants:
        at = store.touched(name, gone)
        new[name] = store.rewritten(tables, name, store.read(name, only=at).join(gone.select("id"), "id", "left_anti"), at)
    at = store.touched(counters, deltas)
    c = store.read(counters, only=at)
    moved = c.join(deltas, "collection_id", "left").na.fill(0, ["n", "ready"])
    moved = moved.select("collection_id", *[(F.col(k) + d).alias(k) for k, d in (("revision", F.col("n")), ("source_count", -F.col("n")), ("ready_count", -F.col("ready")), ("unavailable_count", F.col("ready") - F.col("n")))])
    new[counters] = store.rewritten(tables, counters, moved.select(*c.columns), at)
    return store.commit(version + 1, new)


def register(store: Store, new: DataFrame, key: list[str], facts: list[str], order: str, name: str = "sources", quarantine: str = "conflicts") -> DataFrame:
    """Merges new rows into an existing table, idempotently: the columns of ``new``, outcome, kept_id (``order`` of the row that has the key).

    The first row of a key (by ``order``, an id; rows that the table has come first) is kept; further rows with the same facts are replays and change
    nothing, others are conflicts and go to the quarantine table, each once. The table must be keyed by ``key``; only buckets with a
    new row of theirs are rewritten, and a batch of replays alone makes no version.
    """
    version, tables = store.manifest()
    new = written(new)
    touched = store.touched(name, new)
    known = store.read(name, only=touched)
    both = new.select(*known.columns, F.lit(1).alias("_turn")).unionByName(known.select(*known.columns, F.lit(0).alias("_turn")))
    w = W.partitionBy(*key).orderBy("_turn", order)
    same = F.lit(True)
    for f in facts:
        same = same & F.first(f).over(w).eqNullSafe(F.col(f))
    judged = both.withColumn("outcome", F.when(F.row_number().over(w) == 1, "kept").when(same, "replay").otherwise("conflict")).withColumn("kept_id", F.first(order).over(w))
    judged = written(judged.where("_turn = 1").drop("_turn"))
    kept, bad = judged.where("outcome = 'kept'").select(*known.columns), judged.where("outcome = 'conflict'").select(*known.columns)
    changed = dict(tables)
    at = store.touched(name, kept)
    if at:
        changed[name] = store.rewritten(tables, name, store.read(name, only=at).unionByName(kept), at)
    bad_at = store.touched(quarantine, bad)
    if bad_at:
        held = store.read(quarantine, only=bad_at)
        fresh = bad.exceptAll(bad.join(held, [bad[c].eqNullSafe(held[c]) for c in known.columns], "left_semi")).distinct()
        if not fresh.isEmpty():
            changed[quarantine] = store.rewritten(tables, quarantine, held.unionByName(fresh), bad_at)
    if changed != tables:
        store.commit(version + 1, changed)
    return judged
