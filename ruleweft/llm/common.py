"""Shared helpers: tables, the shared folder, and Arrow columns as flat byte arrays."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``; where that is unset (tests), below a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ruleweft-")
        atexit.register(shutil.rmtree, base, True)
        sc.setCheckpointDir(base)
    return f"{str(base).rstrip('/')}/ruleweft-{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it again with a known schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Keys that count as hot in a join, at most: they hold more rows than the average by this factor, so their list is
#: small enough to broadcast whatever the tables' size.
HOT_KEYS = 50_000


def dealt(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame, total: int, most: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key; hot keys of ``left`` go to several tasks.

    ``counts`` (key, n) are the keys' rows in ``left``, ``total`` all of its rows: a key with more than ``most`` rows, and
    more than a ``HOT_KEYS``-th of all, is split by a hash of ``by``, and its row of ``right`` goes to each part.
    """
    cut = max(most, total // HOT_KEYS)
    hot = F.broadcast(counts.where(F.col("n") > cut).select(key, F.ceil(F.col("n") / cut).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    spread_ = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return spread_.join(copied, [key, "_salt"]).drop("_salt")


def n_parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the user sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows with about ``most`` bytes in ``column``; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flat_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offs, offs[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def strings(column: pa.Array) -> list[str]:
    """Python strings of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def spread(codes: np.ndarray, offs: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions in a flat array of the segments ``codes``, end to end."""
    n = lens[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offs[codes] - (ends - n), n) + np.arange(total)


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: fewer rows in an Arrow batch keep both sides' buffers small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ids_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key and the text, so that other columns are pruned at the scan."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
