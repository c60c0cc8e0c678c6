"""Near-duplicate embeddings by sorted projection passes.

Equal vectors of a label form a class first, and only the class with its size goes on. Each pass orders the vectors of a label lexicographically by a key of concatenated random-projection hashes and
compares each with a bounded window of neighbours; verified pairs of all passes are united. How many passes there are
follows from the wanted recall at the threshold and from the size of the largest label. Neighbour windows cross the
borders of partitions. Where a label's vectors point the same way, hash bits hardly split it, and a range of equal
prefixes holds more than a window: the vectors of such a range meet in full across the components found so far, in
blocks from which only links come out. If that is more work than comparing the whole label once, the label is. The
links of every component are then counted in blocks, which a bounded window can't do for crowded vectors: blocks of one
component meet pairwise, and only counts leave them.

Vectors that are null, empty or zero, hold null or non-finite components, or have no label link with nothing; so do
vectors of different lengths. Equal vectors are linked. Rows that share a vec_id are one vector (any of them); rows
without one are returned unlinked, with a null component. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.llm.components import components, forest
from ruleweft.llm.common import n_parts, remove, shared_dir, stash

COSINE, WINDOW, MISS, BLOCK = 0.98, 32, 1e-4, 2048
KEY_BITS = 63
#: Distance from the threshold within which a matrix product's cosine is computed again by ``cosines``.
CLOSE = 1e-9


def prefix_bits(largest: int, window: int = WINDOW) -> int:
    """Key bits that split a label of ``largest`` rows into ranges of a window's size, if each bit halves it."""
    return max(1, math.ceil(math.log2(max(2, largest) / window)))


def n_passes(largest: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is missed with probability ``miss`` in a label of ``largest`` rows.

    Two vectors at angle t agree in a random hyperplane's sign with probability 1 - t / pi, however the label's vectors
    lie; they are compared if they agree in the prefix, as ranges larger than a window are compared in full.
    """
    agree = 1 - math.acos(cosine) / math.pi
    near = agree ** prefix_bits(largest, window)
    return max(4, math.ceil(math.log(miss) / math.log(1 - near)))


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def proper(column: pa.Array, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length of vectors: the rows that hold proper vectors, and these, in the table's own precision."""
    lists = column.cast(pa.large_list(pa.from_numpy_dtype(kind)))
    flat = lists.values.to_numpy(zero_copy_only=False).astype(kind)
    offs = lists.offsets.to_numpy()
    size = np.where(np.array(lists.is_valid()), np.diff(offs), 0)
    out = []
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[offs[rows][:, None] + np.arange(d)]
        top = np.abs(x).max(1)
        good = np.isfinite(top) & (top > 0)
        out.append((rows[good], x[good]))
    return out


def _planes(passes: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((passes, KEY_BITS, dim))


def _proper(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, label, dim, v) of rows with a proper vector."""
        for b in batches:
            for rows, x in proper(b.column(2), kind):
                at = pa.array(rows)
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "label", "dim", "v"])

    return run


def _keys(passes: int, seed: int, kind: type, vectors: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's key in each pass."""
        planes: dict[int, np.ndarray] = {}
        weight = (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in planes:
                    planes[dim] = _planes(passes, dim, seed)
                x, n = _matrix(own.column(3), dim, kind), own.num_rows
                for p in range(passes):
                    key = ((x @ planes[dim][p].T) > 0).astype(np.int64) @ weight
                    yield pa.record_batch([pa.array(np.full(n, p, np.int32)), own.column(2), own.column(1), pa.array(key), own.column(0), *[own.column(3)] * vectors], ["pass", "dim", "label", "key", "vec_id", *["v"] * vectors])

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows' unit vectors: the one formula that decides at the threshold, in either order."""
    return (x * y).sum(1)


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """True where a row of ``x`` and one of ``y`` are linked: by a matrix product, and by ``cosines`` where that is close."""
    m = x @ y.T
    near = m >= cosine
    i, j = np.nonzero(np.abs(m - cosine) < CLOSE)
    near[i, j] = cosines(x[i], y[j]) >= cosine
    return near


def _near(group: np.ndarray, ids: np.ndarray, x: np.ndarray, window: int, cosine: float, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most ``window`` apart, of one group, with at least this cosine; across ``cut`` if given."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(window, len(ids) - 1) + 1):
        i = np.arange(len(ids) - d)
        if cut is not None:
            i = i[(i < cut) & (i + d >= cut)]
        i = i[(group[i] == group[i + d])]
        i = i[cosines(x[i], x[i + d]) >= cosine]
        a.append(ids[i])
        b.append(ids[i + d])
    return np.concatenate(a), np.concatenate(b)


def _matrix(v: pa.Array, dim: int, kind: type) -> np.ndarray:
    return units(np.frombuffer(b"".join(v.to_pylist()), kind).reshape(-1, dim))


SCANNED = "a long, b long, border int, side int, at int, pass int, dim int, label long, v binary"


def _scan(window: int, cosine: float, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the partition's rows (sorted), then its first and last rows for the borders."""
        part = TaskContext.get().partitionId()
        tail: pa.Table | None = None
        head: list[pa.Table] = []
        n_head = 0

        def links(t: pa.Table, new_from: int) -> Iterator[pa.RecordBatch]:
            dims, labels, passes = (t.column(c).to_numpy() for c in ("dim", "label", "pass"))
            ids, v = t.column("vec_id").to_numpy(), t.column("v").combine_chunks()
            edges = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1], True])
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e <= new_from:
                    continue
                change = np.r_[0, np.cumsum((labels[s + 1 : e] != labels[s : e - 1]) | (passes[s + 1 : e] != passes[s : e - 1]))]
                a, b = _near(change, ids[s:e], _matrix(v.slice(s, e - s), int(dims[s]), kind), window, cosine)
                keep = forest(a, b)
                yield rows(a=a[keep], b=b[keep])

        def rows(n: int | None = None, **cols) -> pa.RecordBatch:
            n = len(next(iter(cols.values())))
            types = [("a", pa.int64()), ("b", pa.int64()), ("border", pa.int32()), ("side", pa.int32()), ("at", pa.int32()), ("pass", pa.int32()), ("dim", pa.int32()), ("label", pa.int64()), ("v", pa.binary())]
            return pa.record_batch([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in types], [c for c, _ in types])

        def border(t: pa.Table, which: int, side: int) -> pa.RecordBatch:
            n = t.num_rows
            return rows(a=t.column("vec_id").to_numpy(), border=np.full(n, which), side=np.full(n, side), at=np.arange(n), **{c: t.column(c).to_numpy() for c in ("pass", "dim", "label")}, v=t.column("v").to_pylist())

        for b in batches:
            t = pa.Table.from_batches([b])
            if n_head < window:
                head.append(t.slice(0, window - n_head))
                n_head += head[-1].num_rows
            old = 0 if tail is None else tail.num_rows
            whole = t if tail is None else pa.concat_tables([tail, t])
            yield from links(whole, old)
            tail = whole.slice(max(0, whole.num_rows - window))
        if tail is not None:
            yield border(pa.concat_tables(head), part, 1)
            yield border(tail, part + 1, 0)

    return run


def _borders(window: int, cosine: float, kind: type):
    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("side", "ascending"), ("at", "ascending")])
        side, dims = g.column("side").to_numpy(), g.column("dim").to_numpy()
        a = b = np.zeros(0, np.int64)
        cut = int((side == 0).sum())
        if 0 < cut < len(side) and dims[0] == dims[-1] and (dims == dims[0]).all():
            key = g.column("label").to_numpy() * 1000 + g.column("pass").to_numpy()
            a, b = _near(key, g.column("a").to_numpy(), _matrix(g.column("v").combine_chunks(), int(dims[0]), kind), window, cosine, cut)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _meet(cosine: float, kind: type):
    def run(g: pa.Table) -> pa.Table:
        """Links between the asking vectors of a block and the others, across components."""
        asks = g.column("asks").to_numpy()
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            ids, c = g.column("vec_id").to_numpy(), g.column("c").to_numpy()
            x = _matrix(g.column("v").combine_chunks(), g.column("dim")[0].as_py(), kind)
            for s in range(0, len(left), 512):
                own = left[s : s + 512]
                i, j = np.nonzero(linked(x[own], x[right], cosine) & (c[own][:, None] != c[right][None]))
                keep = forest(ids[own[i]], ids[right[j]])
                a.append(ids[own[i]][keep])
                b.append(ids[right[j]][keep])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _crowded(able: DataFrame, found: DataFrame, passes: int, bits: int, window: int, cosine: float, block: int, seed: int, kind: type, where: str) -> DataFrame:
    """Links (a, b) across the components ``found`` in ranges of equal prefixes that are larger than a window."""
    spot = ["pass", "dim", "label", "prefix"]
    keyed = able.select("vec_id", "label", "dim", "v").mapInArrow(_keys(passes, seed, kind, vectors=False), "pass int, dim int, label long, key long, vec_id long")
    placed = keyed.select("pass", "dim", "label", F.shiftright("key", KEY_BITS - bits).alias("prefix"), "vec_id").join(found, "vec_id", "left")
    placed = placed.withColumn("c", F.coalesce("component_id", "vec_id")).drop("component_id")
    # the whole label is one more range, as of a pass -1
    whole = placed.where("pass = 0").withColumns({"pass": F.lit(-1), "prefix": F.lit(0).cast("long")})
    placed = stash(placed.unionByName(whole), f"{where}/placed")
    top = placed.groupBy(*spot, "c").agg(F.count("*").alias("n")).groupBy(*spot).agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top"))
    # members of the largest component needn't meet each other: the rest asks, all answer
    top = top.where((F.col("n") > window + 1) & (F.col("n") > F.col("top.n"))).withColumn("work", (F.col("n") - F.col("top.n")).cast("double") * F.col("n"))
    work = top.groupBy("dim", "label").agg(F.sum(F.when(F.col("pass") >= 0, F.col("work"))).alias("ranges"), F.max(F.when(F.col("pass") < 0, F.col("work"))).alias("all"))
    by_range = F.coalesce(F.coalesce("ranges", F.lit(0.0)) <= F.col("all"), F.lit(True))
    chosen = top.join(work, ["dim", "label"]).where((F.col("pass") >= 0) == by_range).select(*spot, F.col("top.c").alias("top"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    each = placed.join(chosen, spot).join(able.select("vec_id", "v"), "vec_id")
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = [*spot, "i", "j", "vec_id", "c"]
    asks = each.where("c <> top").withColumn("i", own).withColumn("j", other).select(*cols, F.lit(True).alias("asks"), "v")
    told = each.withColumn("j", own).withColumn("i", other).select(*cols, F.lit(False).alias("asks"), "v")
    return asks.unionByName(told).groupBy(*spot, "i", "j").applyInArrow(_meet(cosine, kind), "a long, b long")


def _count(cosine: float, kind: type):
    def run(g: pa.Table) -> pa.Table:
        """Links between the two blocks of a pair, by class: other classes count with their sizes."""
        own, i, j, dims, size = (g.column(c).to_numpy() for c in ("block", "i", "j", "dim", "n"))
        ids, v = g.column("vec_id").to_numpy(), g.column("v").combine_chunks()
        n = np.zeros(len(ids), np.int64)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = _matrix(v.take(pa.array(at)), d, kind)
            left, right = at[own[at] == i[0]], at[own[at] == j[0]]
            xl, xr = x[own[at] == i[0]], x[own[at] == j[0]]
            for s in range(0, len(left), 512):
                near = linked(xl[s : s + 512], xr, cosine)
                near &= ids[left[s : s + 512]][:, None] != ids[right][None]
                n[left[s : s + 512]] += near @ size[right]
                if i[0] != j[0]:
                    n[right] += size[left[s : s + 512]] @ near
        return pa.table({"vec_id": pa.array(ids), "links": pa.array(n)})

    return run


def embedding_near_dedup(vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.

    Folders that the result reads (``proper``, ``classes``, ``components``, ``links``) stay in the shared folder.
    """
    spark = vectors.sparkSession
    where = shared_dir(spark)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    no_id = rows.where("vec_id IS NULL").select("vec_id")
    one = rows.where("vec_id IS NOT NULL")
    n = one.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    one = one if n[0] == n[1] else one.dropDuplicates(["vec_id"])
    good = stash(one.where("label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_proper(kind), "vec_id long, label long, dim int, v binary"), f"{where}/proper")
    # equal vectors are one class, which its smallest id stands for
    same = ["label", "dim", "v"]
    able = stash(good.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", *same, "n"), f"{where}/classes")
    largest = able.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    passes = n_passes(largest[0] or 0, cosine, window, miss)
    parts = max(1, min(n_parts(spark), passes * (largest[1] or 0) // (64 * window)))
    keyed = able.select("vec_id", *same).mapInArrow(_keys(passes, seed, kind), "pass int, dim int, label long, key long, vec_id long, v binary")
    order = ["pass", "dim", "label", "key", "vec_id"]
    scanned = stash(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_scan(window, cosine, kind), SCANNED), f"{where}/scanned")
    across = scanned.where("border IS NOT NULL").groupBy("border").applyInArrow(_borders(window, cosine, kind), "a long, b long")
    near = stash(scanned.where("border IS NULL").select("a", "b").unionByName(across), f"{where}/near")
    found = components(near).withColumnRenamed("id", "vec_id")
    rest = stash(_crowded(able, found, passes, prefix_bits(largest[0] or 0, window), window, cosine, block, seed, kind, where), f"{where}/rest")
    found = stash(components(near.unionByName(rest)).withColumnRenamed("id", "vec_id"), f"{where}/components")

    # a crowd is cut into 16 blocks at first, and into more where a block would be large
    each = F.least(F.lit(block), F.greatest(F.lit(block // 16), F.ceil(F.col("size") / 16)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / each)).cast("int")
    size = found.groupBy("component_id").agg(F.count("*").alias("size"))
    member = found.join(size, "component_id").join(able, "vec_id").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    meet = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "n", "dim", "v")
    links = meet.groupBy("component_id", "i", "j").applyInArrow(_count(cosine, kind), "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("links"))
    links = stash(links, f"{where}/links")
    for name in ("scanned", "placed", "near", "rest"):
        remove(spark, f"{where}/{name}")
    by_class = able.join(found, "vec_id", "left").join(links, "vec_id", "left").select(*same, F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    members = good.join(by_class, same).select("vec_id", "component_id", "n_links")
    out = one.select("vec_id").join(members, "vec_id", "left").unionByName(no_id, allowMissingColumns=True)
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
