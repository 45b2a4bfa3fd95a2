"""Tables that cut lineage, joins that no frequent key holds up, and bit maps of ids of a fixed size.

Defined cases: an empty frame is written and read as one with the same schema;
null keys join nothing and null ids have no slot; repeated rows stay repeated.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BITS = 1 << 24
BATCH_ROWS = 2000
HEAVY_KEYS = 1 << 16
HEAVY_LEAST = 200

_written: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> SparkSession:
    """Sets the rows of an Arrow batch to BATCH_ROWS where the session has Spark's own default: texts are long, and a task holds a batch several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a folder of our own (single machine, tests), but never on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vecengine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """The frame written once as Parquet and read back; executors that come later find it there."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    table = spark.read.schema(frame.schema).parquet(path)
    table.written_to = path
    return table


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Frees what no later step reads: the files of ``tables`` (from ``materialize``) and the shuffles of finished jobs.

    Spark drops a shuffle when the driver's garbage collector finds it
    unreferenced, which on an idle heap can take half an hour.
    """
    for table in tables:
        _remove(spark, table.written_to)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def heavy_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them at most) with ``table``, one row a key with ``n``, the number of rows that have it.

    Keys of more than one in HEAVY_KEYS rows, of which there are at most so
    many, meet a broadcast of theirs, so that none is dealt to one task; where
    there is no such key, the join is a plain one. ``table`` is written first,
    unless it comes from ``materialize``.
    """
    if not hasattr(table, "written_to"):
        table = materialize(table, "keys")
    least = max(HEAVY_LEAST, total // HEAVY_KEYS)
    if (table.agg(F.max("n")).first()[0] or 0) <= least:
        return rows.join(table.drop("n"), key)
    heavy = F.broadcast(table.where(F.col("n") > least).drop("n"))
    light = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col("n") <= least).drop("n"), key)
    return rows.join(heavy, key).unionByName(light)


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a longer one where a column has it already (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_text_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one row a doc_id, none null, and (doc_id, chosen) of repeated ids: the digest of the text taken, which is the least.

    Where no doc_id repeats, the second is None and nothing is shuffled but ids.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    several = materialize(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if several.isEmpty():
        return rows, None
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    ones = materialize(rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", digest).alias("text"), F.min(digest).alias("chosen")), "chosen-texts")
    return rows.join(several, "doc_id", "left_anti").unionByName(ones.select("doc_id", "text")), ones.select("doc_id", "chosen")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def id_slots(ids: np.ndarray) -> np.ndarray:
    """A slot in the fixed-size bit map for each id."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(BITS - 1)).astype(np.int64)


def bit_map(ids: DataFrame) -> np.ndarray:
    """A bit map of fixed size (BITS bits, 2 MB) that holds the slots of all ids; its words are gathered from the cluster."""

    def run(batches):
        seen = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            slots = id_slots(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(seen, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        words = seen.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    total = np.zeros(BITS // 64, np.int64)
    merged = ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    total[merged["at"].to_numpy(np.int64)] = merged["word"].to_numpy(np.int64)
    return total.view(np.uint8)


def in_bit_map(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose first column is not null and has its slot in the bit map."""
    ids = batch.column(0)
    slots = id_slots(ids.fill_null(0).to_numpy(zero_copy_only=False))
    hit = ids.is_valid().to_numpy(zero_copy_only=False) & ((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)
    return batch.filter(pa.array(hit))
