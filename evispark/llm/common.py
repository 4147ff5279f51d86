"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where that is unset a local master (as in tests) gets a
    temporary folder; on a cluster, whose executors would not see it, it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(scratch_dir, "local", None):
        scratch_dir.local = tempfile.mkdtemp(prefix="evispark-")
    return "file://" + scratch_dir.local


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Texts are long: Arrow batches of so many rows, and pieces of a batch of so many rows and bytes, keep Python workers small.
BATCH_ROWS, PIECE_ROWS, PIECE_BYTES = 1000, 512, 2 << 20


def lean(spark: SparkSession) -> SparkSession:
    """The session, set to small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def pieces(batch: pa.RecordBatch, column: int):
    """A batch in slices of at most PIECE_ROWS rows and about PIECE_BYTES bytes of a text column (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= PIECE_ROWS or total + n > PIECE_BYTES):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_crc(doc_id: Column) -> Column:
    """Unsigned CRC-32 of an id's decimal digits (null stays null)."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def filter_rows(docs: DataFrame, make_predicate) -> DataFrame:
    """Rows for which the predicate on (text) holds, with every column as it was, whatever the columns are called.

    ``make_predicate()`` runs once a Python worker task and returns ``texts -> list[bool]``.
    """

    where = docs.columns.index("text")

    def run(batches):
        predicate = make_predicate()
        for batch in batches:
            for part in pieces(batch, where):
                keep = predicate(part.column(where).to_pylist())
                yield part.filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots or the like don't matter
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
