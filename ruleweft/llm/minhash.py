"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Small collections of ``PER_COLLECTION`` minhashes each are computed once; a table key joins two of them, so at the
threshold of 85 % 30 minhashes serve 45 tables of six. Lower thresholds take more collections. Documents with equal sets form a class first, and only its smallest id
goes on. In each table bucket all members are compared with one pivot, which keeps a bucket of near copies linear;
links that these confirm are contracted to components. Members that are still outside their pivot's component are
then compared with all others of their bucket, without any cap, in blocks from which only links come out; a pair meets
in the first table that it shares. Buckets and pivots with very many rows are dealt to several tasks.

Null and empty texts, and texts of blanks, have the empty set and link with nothing; fewer words than a shingle make
one shingle; very long texts are whole; equal rows are linked, and rows that share a doc_id are one node of the links
(confirmed with the first text by order); rows with a null doc_id are returned unlinked, with a
null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.llm.bytesops import LOWER, U, Hasher, mix, owners, values, windows, words
from ruleweft.llm.common import dealt, flat_bytes, ids_and_text, remove, shared_dir, slices, spread, stash
from ruleweft.llm.components import components

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
PER_COLLECTION = 3
#: Rows of one bucket, and candidates of one pivot with their full sets, that a task gets.
BUCKET_ROWS, PIVOT_ROWS = 4096, 512
#: Probability that all tables miss a pair at the threshold, at most.
MISS = 0.00125
#: Documents in a block of those that still have to meet.
BLOCK = 512


def n_collections(percent: int, miss: float = MISS, k: int = PER_COLLECTION) -> int:
    """The fewest collections of which a pair at the threshold shares less than two with probability ``miss`` at most."""
    p, m = (min(max(percent, 1), 99) / 100) ** k, 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within rows, and the n + 1 offsets."""
    data = LOWER[data]
    starts, ends, at = words(data, offs)
    h = Hasher(data).spans(starts, ends)
    n = np.diff(at)
    keys, wat = windows(h, at, k)
    own = owners(wat)
    for few in range(1, k):  # rows shorter than a shingle: all their words
        rows = np.flatnonzero(n == few)
        if len(rows):
            x, _ = windows(h[(at[rows][:, None] + np.arange(few)).ravel()], np.arange(len(rows) + 1) * few, few)
            keys, own = np.concatenate([keys, mix(x + U(few))]), np.concatenate([own, rows])
    order = np.lexsort((keys, own))
    keys, own = keys[order], own[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    return keys[first], np.searchsorted(own[first], np.arange(len(n) + 1))


def collections(keys: np.ndarray, at: np.ndarray, m: int, k: int = PER_COLLECTION) -> np.ndarray:
    """The rows' ``m`` collection keys, each the hash of ``k`` minhashes; 0 for empty rows."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, m), U)
    if not len(some):
        return out
    scale, shift = values(11, m * k) | U(1), values(12, m * k)
    for i in range(m):
        x = np.zeros(len(some), U)
        for j in range(i * k, i * k + k):
            low = np.minimum.reduceat((keys ^ shift[j]) * scale[j], at[some])
            x = mix(x * U(0x9E3779B97F4A7C15) + low)
        out[some, i] = x
    return out


def _sign(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "set1", "set2", *(f"c{i}" for i in range(m))]
        for b in slices(batches, "text"):
            keys, at = shingles(*flat_bytes(b.column(1)))
            c = collections(keys, at, m)
            sums = [np.concatenate([[U(0)], np.cumsum(mix(keys + U(s)))]) for s in (21, 22)]
            sets = [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]
            yield pa.record_batch([b.column(0), pa.array(np.diff(at)), *map(pa.array, sets), *(pa.array(c[:, i].view(np.int64)) for i in range(m))], names)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        keys, at = shingles(*flat_bytes(b.column(1)))
        yield pa.record_batch([b.column(0), pa.array([keys[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], ["id", "items"])


def _confirm(percent: int):
    """(a, b, linked) of rows (a, b, set of a, set of b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                i = np.searchsorted(y, x)
                i[i == len(y)] = 0
                common = int((y[i] == x).sum()) if len(y) else 0
                union = len(x) + len(y) - common
                keep.append(100 * common >= percent * union)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def _across(percent: int):
    def run(g: pa.Table) -> pa.Table:
        """Links between the asking documents of a block and the others, across components, of pairs whose first common
        table this is."""
        asks = g.column("asks").to_numpy(zero_copy_only=False)
        ids, c, table = g.column("id").to_numpy(), g.column("c").to_numpy(), g.column("t")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), U) for x in g.column("items")]
        signs = np.array(g.column("signs").to_pylist(), np.int64)
        told, a, b = np.flatnonzero(~asks), [], []
        sizes = np.array([len(sets[i]) for i in told], np.int64)
        keys, own = np.concatenate([sets[i] for i in told]) if len(told) else np.zeros(0, U), np.repeat(np.arange(len(told)), sizes)
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        tables = np.array(list(combinations(range(signs.shape[1]), 2)))
        for i in np.flatnonzero(asks).tolist():
            same = signs[told] == signs[i]
            first = (same[:, tables[:, 0]] & same[:, tables[:, 1]]).argmax(1) == table
            other = first & (c[told] != c[i])
            if not other.any():
                continue
            x = sets[i]
            lo, n = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
            common = np.bincount(own[spread(np.arange(len(x)), lo, n - lo)], minlength=len(told))
            hit = (100 * common >= percent * (len(x) + sizes - common)) & other
            a += [ids[i]] * int(hit.sum())
            b += ids[told[hit]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def minhash_near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Folders that the result reads (``signed``, ``classes``, ``components``) stay in the shared folder.
    """
    spark = docs.sparkSession
    where = shared_dir(spark)
    texts = ids_and_text(docs)
    m = n_collections(percent)
    cols = [f"c{i}" for i in range(m)]
    schema = f"doc_id long, n_shingles long, set1 long, set2 long, {', '.join(f'{c} long' for c in cols)}"
    signed = stash(texts.mapInArrow(_sign(m), schema), f"{where}/signed")
    sets = ["set1", "set2", "n_shingles"]
    some = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets have equal signatures: the smallest id stands for the class
    classes = stash(some.groupBy(*sets).agg(F.min(F.struct("doc_id", *cols)).alias("r")).select(*sets, F.col("r.doc_id").alias("id"), *(F.col(f"r.{c}").alias(c) for c in cols)), f"{where}/classes")

    keys = F.array(*(F.xxhash64(F.lit(t), *pair) for t, pair in enumerate(combinations(cols, 2))))
    tables = classes.select("id", F.explode(keys).alias("key"))
    shared = stash(tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{where}/shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    members = stash(dealt(tables, shared, "key", "id", shared, total, BUCKET_ROWS), f"{where}/found")
    # the pivot is the member that shares its buckets with most others: in a group of copies, what they were copied from
    rank = members.groupBy("id").agg(F.sum("n").alias("rank"))
    members = stash(members.drop("n").join(rank, "id"), f"{where}/ranked")
    pivots = members.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("minus"))).alias("p")).select("key", (-F.col("p.minus")).alias("pivot"), F.col("p.rank").alias("pivot_rank"))
    members = stash(dealt(members.drop("rank"), pivots, "key", "id", shared, total, BUCKET_ROWS), f"{where}/members")
    ids = members.select("id").distinct()
    one = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    items = stash(one.groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(_sets, "id long, items binary"), f"{where}/items")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Which of the pairs (a, b) are linked; ``b`` may be a pivot of very many."""
        pairs = stash(pairs, f"{where}/{name}-pairs")
        left = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        counts, right = pairs.groupBy("b").agg(F.count("*").alias("n")), items.select(F.col("id").alias("b"), F.col("items").alias("y"))
        both = dealt(left, right, "b", "a", counts, pairs.count(), PIVOT_ROWS)
        return stash(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long, linked boolean"), f"{where}/{name}")

    def with_component(frame: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
        x = found.select(F.col("id").alias(column), F.col("component_id").alias(name))
        return frame.join(x, column, "left").withColumn(name, F.coalesce(name, column))

    def stars(found: DataFrame) -> DataFrame:
        return found.select(F.col("id").alias("a"), F.col("component_id").alias("b"))

    near = members.where(F.col("id") != F.col("pivot")).select(F.col("id").alias("a"), F.col("pivot").alias("b"), "pivot_rank")
    # first the highest pivot of each document
    best = near.groupBy("a").agg(F.max(F.struct("pivot_rank", (-F.col("b")).alias("minus"))).alias("p")).select("a", (-F.col("p.minus")).alias("b"))
    seen = confirmed(best, "links0")
    found = components(seen.where("linked").select("a", "b"), f"{where}/parts0")
    # then the other pivots, where they are still apart
    apart = with_component(with_component(near.select("a", "b").distinct(), found, "a", "ca"), found, "b", "cb").where("ca <> cb").select("a", "b")
    more = confirmed(apart.join(seen, ["a", "b"], "left_anti"), "links1")
    found = components(stars(found).unionByName(more.where("linked").select("a", "b")), f"{where}/parts1")
    # then whatever shares a bucket across components: members outside their pivot's component meet all others of the
    # bucket in blocks, from which only links come out
    placed = stash(with_component(with_component(members, found, "id", "c"), found, "pivot", "cp").withColumn("stray", F.col("c") != F.col("cp")), f"{where}/placed")
    opened = placed.groupBy("key").agg(F.count_if("stray").alias("strays"), F.count("*").alias("n")).where("strays > 0")
    opened = stash(opened, f"{where}/open")
    each = dealt(placed.select("key", "id", "c", "stray"), opened, "key", "id", opened, total, BUCKET_ROWS)
    table = F.array_position(keys, F.col("key")).cast("int") - 1
    each = each.join(classes.select("id", *cols), "id").withColumn("t", table).withColumn("signs", F.array(*cols)).drop(*cols).join(items, "id")
    # strays in blocks of their own meet blocks of all: few strays copy the others few times
    parts = lambda count: F.ceil(F.col(count) / BLOCK).cast("int")
    own = lambda count: F.pmod(F.xxhash64("id"), parts(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), parts(count) - 1))
    out = ["key", "t", "i", "j", "id", "c", "signs", "items"]
    asks = each.where("stray").withColumn("i", own("strays")).withColumn("j", every("n")).select(*out, F.lit(True).alias("asks"))
    told = each.withColumn("j", own("n")).withColumn("i", every("strays")).select(*out, F.lit(False).alias("asks"))
    rest = stash(asks.unionByName(told).groupBy("key", "t", "i", "j").applyInArrow(_across(percent), "a long, b long"), f"{where}/links2")
    if not rest.isEmpty():
        found = components(stars(found).unionByName(rest), f"{where}/parts2")
    found = stash(found, f"{where}/components")

    by_class = with_component(classes.select(*sets, "id"), found, "id", "component_id").drop("id")
    result = signed.join(by_class, sets, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    for name in ("shared", "found", "ranked", "members", "items", "placed", "open", "links0", "links1", "links2", "links0-pairs", "links1-pairs", "parts0", "parts1", "parts2"):
        remove(spark, f"{where}/{name}")
    return result.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies, with all their columns; null ids stay."""
    kept = minhash_near_dedup(docs, percent).where("kept OR doc_id IS NULL").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
