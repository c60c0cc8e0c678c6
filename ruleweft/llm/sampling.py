"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.llm.common import flat_bytes, ids_and_text, slices

#: Labelled rows of each class that a classifier is fitted on, at most.
PER_CLASS = 4000


def held_out(doc_id: str = "doc_id"):
    """True for rows that labels may not be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def parts(texts: pa.Array, y: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and labels of the texts, about ``most`` bytes at a time."""
    at = 0
    for b in slices([pa.record_batch([texts], ["text"])], "text", most):
        yield *flat_bytes(b.column(0)), y[at : at + b.num_rows]
        at += b.num_rows


def fitted(docs: DataFrame, labels: DataFrame, label: str, fit: Callable, where=None, per_class: int = PER_CLASS):
    """What ``fit(texts, y, counts)`` makes of at most ``per_class`` labelled rows of each class, in one task.

    The ids are the lowest by hash of the id, so a rerun takes the same rows. A row labelled twice has its highest
    label; null ids and labels are left out. ``counts`` has the classes' numbers of rows in all. Only the model, which
    the bound on the rows bounds, comes to the driver.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    own = own if where is None else own.where(where)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(pa.array([], pa.string()), np.zeros(0, np.int64), counts)
    ids = None
    for y in sorted(counts):
        x = own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = x if ids is None else ids.unionByName(x)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        texts = rows.column("text").combine_chunks()
        return pa.table({"model": pa.array([pickle.dumps(fit(texts, rows.column("y").to_numpy().astype(np.int64), counts))], pa.binary())})

    # the ids are bounded by per_class a class, so safe to broadcast; rows that share an id are one, with the last text
    rows = ids_and_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("doc_id", "text", "y", F.lit(0).alias("all"))
    made = rows.groupBy("all").applyInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit(pa.array([], pa.string()), np.zeros(0, np.int64), counts)
