"""Sources and sinks: originals, release files, atomic publication, reports."""

from __future__ import annotations

import os
import re
import uuid
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import valid_name

#: Suffixes and the bytes that files of a type begin with.
MEDIA = (("pdf", "application/pdf", "25504446"), ("txt", "text/plain", ""))
MAX_BYTES = 64 << 20
#: Files in a folder of originals; what opening a file counts as when files are dealt to tasks.
PER_FOLDER, OPEN_COST = 20_000, "spark.sql.files.openCostInBytes"

MANIFEST = "schema_version int, corpus_id string, document_count int, documents array<struct<doc_id string, family_id string, path string, sha256 string, language string, document_class string>>, _corrupt string"
QUESTIONS = "case_id string, family_id string, anchor_doc_id string, scope struct<patient string, doc_ids array<string>>, turns array<struct<role string, text string>>, question_class string, _corrupt string"
GOLD = "case_id string, gold_status string, required_claims array<struct<claim_id string, text string>>, _corrupt string"
REFERENCE = "struct<doc_id string, page int, line_start int, line_end int, quote string>"
EXTRACTION = f"schema_version string, corpus_id string, entries array<struct<reference {REFERENCE}, source_sha256 string, outcome string, reviewed_by string, extracted_locators array<struct<page int, line_start int, text_sha256 string>>>>, _corrupt string"


def scan_originals(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, size, sha256, media_type, text, reason: every file below a folder; ``reason`` says why one is rejected.

    Type by suffix and first bytes; text must be valid UTF-8 (a byte-order mark is dropped), without NUL and not empty
    (Spark's binary source leaves out files of no bytes itself).
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    declared = F.coalesce(*[F.when(suffix == s, F.lit(m)) for s, m, _ in MEDIA])
    magic = F.lit(False)
    for s, _, begin in MEDIA:
        magic = magic | ((suffix == s) & F.hex(F.substring("content", 1, max(1, len(begin) // 2))).startswith(begin))
    plain = suffix == "txt"
    x = f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), declared.alias("media_type"), magic.alias("magic"), plain.alias("plain"), name.alias("name"), F.col("content"))
    read = F.col("content").cast("string")
    valid = F.is_valid_utf8(read)
    text = F.when(F.col("plain") & valid, F.regexp_replace(read, "^\\x{FEFF}", ""))
    reason = (
        F.when(~valid_name(F.col("name")), "bad_name").when(F.col("size") == 0, "empty").when(F.col("size") > max_bytes, "too_large")
        .when(F.col("media_type").isNull() | ~F.col("magic"), "type_mismatch").when(F.col("plain") & ~valid, "not_utf8")
        .when(F.col("plain") & F.contains(read, F.lit("\x00")), "nul_byte")
    )
    return x.select("path", "size", "sha256", "media_type", text.alias("text"), reason.alias("reason"))


@contextmanager
def cheap_opens(spark: SparkSession):
    """Small files go into tasks by the thousand, not by the 4 MB that opening one counts as by default."""
    before = spark.conf.get(OPEN_COST)
    spark.conf.set(OPEN_COST, str(64 << 10))
    try:
        yield
    finally:
        spark.conf.set(OPEN_COST, before)


def on_disk(spark: SparkSession, path: str) -> str | None:
    """The local path of a folder in the local file system (a disk that all nodes share), None in any other store."""
    if "://" not in path and not path.startswith("file:"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + path
    found = re.fullmatch(r"file:(?://(?:localhost)?)?(/.*)", path)
    return found and found[1]


def put_files(root: str, rows) -> None:
    """A task's originals as files below ``root``, each under its own name at once: a task that runs again writes the same ones."""
    for r in rows:
        path = f"{root}/folder={r['folder']}/part-{r['id']}.txt"
        with open(f"{os.path.dirname(path)}/.{r['id']}-{uuid.uuid4().hex}", "wb") as f:
            f.write(r["content"] + b"\n")
        os.replace(f.name, path)


def write_originals(docs: DataFrame, out: str, per_folder: int = PER_FOLDER) -> list[str]:
    """One text file for each row with a text, dealt over folders of about ``per_folder`` files, whose paths are returned.

    Hadoop's local file system runs ``chmod`` for each file and again for its checksum, which takes ten times as long as writing
    it, so tasks write to a disk themselves.
    """
    docs = docs.where("text IS NOT NULL")
    n = docs.count()
    folders = max(1, -(-n // per_folder))
    names = [f"{out}/folder={i}" for i in range(folders)]
    dealt = lambda x: x.select("text", F.monotonically_increasing_id().alias("id")).withColumn("folder", F.pmod(F.xxhash64("id"), F.lit(folders)))
    root = on_disk(docs.sparkSession, out)
    if root:
        for i in range(folders):
            os.makedirs(f"{root}/folder={i}")
        dealt(docs).select("folder", "id", F.col("text").cast("binary").alias("content")).foreachPartition(partial(put_files, root))
        return names
    # tasks move their own files to their places: the driver would go through all of them one by one
    x = dealt(docs.repartition(max(1, min(n, 16 * folders)))).drop("id")
    x.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("folder").text(out)
    return names if folders > 1 else [out]


def scan_folders(spark: SparkSession, folders: list[str], out: str, of) -> DataFrame:
    """What ``of`` makes of the scan of each folder, in one table in ``out``: the driver lists the files of one folder at a time."""
    with cheap_opens(spark):
        for folder in folders:
            of(scan_originals(spark, folder)).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def read_release(spark: SparkSession, folder: str, extraction_map: str | None = None) -> dict[str, DataFrame]:
    """Release files with fixed schemas; broken records go to the ``_corrupt`` column, nothing is inferred.

    The extraction map lies outside the release and is read where its path is given.
    """
    read = lambda schema, path: spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    out = {name: read(schema, f"{folder}/{name}.json") for name, schema in (("manifest", MANIFEST), ("questions", QUESTIONS), ("gold", GOLD))}
    return out | ({"extraction": read(EXTRACTION, extraction_map)} if extraction_map else {})


def publish(tables: dict[str, DataFrame], out: str, version: str | None = None) -> str:
    """All tables or none: each is written to a version folder of its own, and a manifest row is written last. Readers follow manifests only."""
    version = version or uuid.uuid4().hex
    for name, df in tables.items():
        by = [c for c in ("collection", "source", "variant") if c in df.columns and c != "source" or c == "source" and "collection" not in df.columns and c in df.columns]
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{out}/data/{name}/_version={version}")
    spark = next(iter(tables.values())).sparkSession
    rows = spark.createDataFrame([(version, name) for name in tables], "version string, name string").withColumn("at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(f"{out}/manifest")
    return version


def published(spark: SparkSession, out: str, name: str, every: bool = False) -> DataFrame:
    """The latest published version of a table, or the rows of every version, each once (continuous ingestion: a version a batch)."""
    m = spark.read.parquet(f"{out}/manifest").where(F.col("name") == name).groupBy("version").agg(F.max("at").alias("at")).orderBy(F.desc("at"), F.desc("version"))
    rows = m.collect() if every else m.limit(1).collect()
    return spark.read.option("basePath", f"{out}/data/{name}").parquet(*[f"{out}/data/{name}/_version={r['version']}" for r in rows]).drop("_version")


def write_report(cells: DataFrame, out: str) -> None:
    """The evaluation report: nested JSON, and CSV with cells in order."""
    flat = [c for c, t in cells.dtypes if not t.startswith(("array", "struct", "map"))]
    ordered = cells.orderBy(*flat[:2])
    ordered.select(F.struct("*").alias("cell")).coalesce(1).write.mode("overwrite").json(f"{out}/json")
    ordered.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/csv")


def write_markdown(answers: DataFrame, out: str) -> None:
    answers.select("markdown").write.mode("overwrite").text(out, lineSep="\n\n---\n\n")
