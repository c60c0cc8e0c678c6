"""Connected components of links between ids, by alternating large-star and small-star rounds.

Links stay distributed throughout: partitions first drop the links that add nothing to their own spanning forest, then
each round rewires neighbours to the smallest id seen, until the links form stars. Every round's links are written to
the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.llm.common import n_parts, remove, shared_dir, stash


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True for links that join two trees of the forest that the links before them make."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out[i] = True
    return out


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = forest(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield b.filter(pa.array(keep))


def components(links: DataFrame, where: str | None = None) -> DataFrame:
    """Links (a long, b long), neither null, to (id, component_id) of every id that has a link to another one.

    component_id is the smallest id reachable. Loops and repeated links are allowed; no links give no rows. The result
    reads the last round's folder below ``where`` (a new shared one if not given), which the caller may remove when it
    has what it needs. Each round's smallest neighbours are written before links join them, so that Spark can split the
    partition of an id with very many links.
    """
    spark = links.sparkSession
    where = where or shared_dir(spark)
    thin = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_thin, "a long, b long")
    few = max(1, n_parts(spark) // 8)  # links between ids are small rows: few files hold them
    now, before, k = stash(thin.distinct(), f"{where}/0"), None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(few), f"{where}/low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stash(large.coalesce(few), f"{where}/large")
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(few), f"{where}/least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        new = stash(small.coalesce(few), f"{where}/{k}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.count_distinct("a")).first()
        for name in (k - 1, "low", "large", "least"):
            remove(spark, f"{where}/{name}")
        if state[:2] == before or state[0] == 0:
            return new.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(new.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
        now, before = new, state[:2]
