"""Size-tiered compaction of immutable shards under a versioned manifest. DataFrame operations only.

Arrivals are appended as small shards that never change: ranges of doc_id with about the same bytes of text, cut by
cumulated bytes. A compaction takes the shards of the current version, sorts them into tiers by size (powers of four),
and rewrites runs of two or more shards of one tier into shards of about the target size; all others stay. A version is
a manifest of its shards. It is committed by moving a complete marker file into place, which fails if another writer
was first; a writer that dies at any step leaves no version, or a whole one. Data of a failed attempt lie in folders
that no manifest names, until ``vacuum`` removes them.

Null texts count as empty; rows without an id go with the first arrival, and rows that share an id go together, in as
many files as tasks read them from; equal rows stay as many as they are; a very long text may make a shard larger than
the target; an empty table makes a version without shards; all columns of the table are kept, also those named like the
operator's own (``_shard`` gets more underscores then).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ruleweft.llm.common import remove, shared_dir, stash

#: Bytes of text in an arrival and in a full shard, and how many shards of a tier are worth a merge.
ARRIVAL, TARGET, FAN_IN = 2 << 20, 64 << 20, 2
#: Arrivals of one append, at most: larger appends have larger arrivals, so that cuts stay a small list.
ARRIVALS = 50_000
MANIFEST = "shard long, attempt string, docs long, bytes long"
LOWEST = -(1 << 63)


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    while name in columns:
        name = f"_{name}"
    return name


class Dataset:
    """A folder of shards (``data/_attempt=<id>/_shard=<n>``), manifests and version markers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._hadoop(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _marker(self, version: int) -> str | None:
        """The manifest that a marker names; None if the marker is malformed or its manifest isn't whole."""
        stream = self._fs.open(self._hadoop(f"{self.path}/versions/v{version:08d}"))
        try:
            name = str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return name if re.fullmatch("[0-9a-f]{32}", name) and self._fs.exists(self._hadoop(f"{self.path}/manifests/{name}/_SUCCESS")) else None

    def _numbers(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("versions") if re.fullmatch("v[0-9]{8,}", n))

    def version(self) -> int:
        """The last whole version, 0 if there is none."""
        return next((v for v in reversed(self._numbers()) if self._marker(v)), 0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._marker(version)}")

    def commit(self, manifest: DataFrame, after: int) -> int:
        """Makes ``manifest`` the version that follows ``after``; raises if another writer was first."""
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        draft = self._hadoop(f"{self.path}/versions/.draft-{name}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(name.encode()))
        finally:
            out.close()
        numbers = self._numbers()
        if any(self._marker(v) for v in numbers if v > after):
            raise FileExistsError(f"a version after {after} exists already")
        # malformed markers of other tools keep their numbers
        version = max([after, *numbers]) + 1
        self._move(draft, self._hadoop(f"{self.path}/versions/v{version:08d}"))
        return version

    def _move(self, draft, final) -> None:
        """Moves a complete file into place; fails if the place is taken."""
        jvm = self.spark._jvm
        draft, final = self._fs.makeQualified(draft), self._fs.makeQualified(final)
        if draft.toUri().getScheme() == "file":  # a local rename would overwrite; a link doesn't
            jvm.java.nio.file.Files.createLink(jvm.java.nio.file.Path.of(final.toUri()), jvm.java.nio.file.Path.of(draft.toUri()))
            self._fs.delete(draft, False)
            return
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)

    def shards(self, docs: DataFrame, shard: Column, helper: str, values: int | None = None, text: str = "text") -> DataFrame:
        """Writes ``docs`` as shards numbered by the column ``shard``; returns their manifest rows.

        ``helper`` is a column that isn't written. If it has ``values`` values from 0 on, rows are dealt by it, each
        value to a task of its own, so that a shard is one file.
        """
        columns = [c for c in docs.columns if c != helper]
        name, attempt = free("_shard", columns), uuid.uuid4().hex
        folder = f"{self.path}/data/{free('_attempt', columns)}={attempt}"
        rows = docs.withColumn(name, shard)
        rows = (rows if values is None else rows.repartitionById(values, F.col(helper).cast("int"))).drop(helper)
        rows.write.option("compression", "zstd").partitionBy(name).parquet(folder)
        made = self.spark.read.schema(rows.schema).parquet(folder)
        size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
        return made.groupBy(F.col(name).cast("long").alias("shard")).agg(F.count("*").alias("docs"), F.sum(size).alias("bytes")).select("shard", F.lit(attempt).alias("attempt"), "docs", "bytes")

    def read(self, schema: T.StructType, version: int | None = None, manifest: DataFrame | None = None) -> DataFrame:
        """The rows of a version, with the number of their shard in ``_shard`` (see ``free``).

        One scan of all data, pruned to the manifest's folders by the join with it.
        """
        manifest = self.manifest(version) if manifest is None else manifest
        name, attempt = free("_shard", schema.names), free("_attempt", schema.names)
        whole = T.StructType([*schema.fields, T.StructField(attempt, T.StringType()), T.StructField(name, T.LongType())])
        if manifest.isEmpty():
            return self.spark.createDataFrame([], whole).drop(attempt)
        own = manifest.select(F.col("attempt").alias(attempt), F.col("shard").alias(name))
        return self.spark.read.schema(whole).parquet(f"{self.path}/data").join(own, [attempt, name], "left_semi").select(*schema.names, name)

    def vacuum(self, keep: int = 1) -> None:
        """Removes data and manifests that none of the last ``keep`` versions needs, and drafts of markers."""
        live = [v for v in self._numbers() if self._marker(v)][-keep:]
        manifests = {self._marker(v) for v in live}
        attempts = {r["attempt"] for v in live for r in self.manifest(v).select("attempt").distinct().collect()}  # one an append or merge
        gone = [f"versions/v{v:08d}" for v in self._numbers() if v not in live] + [f"versions/{n}" for n in self._names("versions") if n.startswith(".draft-")]
        gone += [f"manifests/{n}" for n in self._names("manifests") if n not in manifests] + [f"data/{n}" for n in self._names("data") if n.split("=")[-1] not in attempts]
        for path in gone:
            self._fs.delete(self._hadoop(f"{self.path}/{path}"), True)


def cuts(docs: DataFrame, arrival_bytes: int, where: str) -> list[int]:
    """The first ids of arrivals: ranges of ids with about ``arrival_bytes`` of text each.

    Bytes are summed up over ranges of ids, of which only the totals meet; only ids and sizes are shuffled.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # ranges of ids are sampled anew whenever a plan runs, so the dealt sizes are written once
    sizes = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), size.alias("b")).groupBy("id").agg(F.sum("b").alias("b"))
    ranged = stash(sizes.repartitionByRange("id").withColumn("part", F.spark_partition_id()), where)
    totals = ranged.groupBy("part").agg(F.sum("b").alias("all"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("all").over(upto), F.lit(0)).alias("before"))  # one row for each partition
    total = ranged.agg(F.sum("b")).first()[0] or 0
    arrival = max(arrival_bytes, -(-total // ARRIVALS))
    own = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(totals), "part").withColumn("k", F.floor((F.col("before") + F.coalesce(F.sum("b").over(own), F.lit(0))) / arrival))
    return sorted(r["first"] for r in placed.groupBy("k").agg(F.min("id").alias("first")).select("first").collect())  # at most ARRIVALS and one


def last_at_most(docs: DataFrame, value: Column, sorted_values: list[int], name: str) -> DataFrame:
    """``docs`` with the place of the last of ``sorted_values`` (a small list) that is not above ``value``, by halving."""
    steps = [1 << k for k in range(max(0, len(sorted_values) - 1).bit_length() - 1, -1, -1)]
    every = F.from_json(F.lit("[" + ",".join(map(str, sorted_values)) + "]"), "array<bigint>")  # folds into a literal
    docs = docs.withColumn(name, F.lit(0).cast("long"))
    at = F.col(name)
    for step in steps:
        docs = docs.withColumn(name, F.when((at + step < len(sorted_values)) & (F.get(every, (at + step).cast("int")) <= value), at + step).otherwise(at))
    return docs


def append(data: Dataset, docs: DataFrame, arrival_bytes: int = ARRIVAL) -> int:
    """Appends ``docs`` as arrivals; returns the new version."""
    version = data.version()
    old = data.manifest(version)
    first = (old.agg(F.max("shard")).first()[0] + 1) if version and not old.isEmpty() else 0
    sizes = f"{data.path}/sizes-{uuid.uuid4().hex}"
    firsts = cuts(docs, arrival_bytes, sizes)
    remove(data.spark, sizes)
    if not firsts:
        return data.commit(old, version)
    name = free("_place", docs.columns)
    placed = last_at_most(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), firsts, name)
    return data.commit(old.unionByName(data.shards(placed, F.col(name) + first, helper=name)), version)


def plan(manifest: DataFrame, target: int = TARGET, fan_in: int = FAN_IN) -> DataFrame:
    """What merges: (shard, merged), merged numbered from 0 by tier and place in it; over metadata only."""
    tier = F.floor((F.length(F.bin("bytes")) - 1) / 2)
    small = manifest.where(F.col("bytes") < target).withColumn("tier", tier)
    own = Window.partitionBy("tier")
    before = own.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("n", F.count("*").over(own)).where(F.col("n") >= fan_in)
    run = F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / target)
    groups = small.withColumn("run", run).withColumn("size", F.count("*").over(Window.partitionBy("tier", "run"))).where("size > 1")
    numbered = groups.select("tier", "run").distinct().withColumn("merged", F.row_number().over(Window.orderBy("tier", "run")).cast("long") - 1)
    return groups.join(numbered, ["tier", "run"]).select("shard", "merged")


def compact(data: Dataset, schema: T.StructType, target: int = TARGET, fan_in: int = FAN_IN) -> int:
    """One round of compaction; commits and returns the new version, or the old one if nothing merges."""
    version = data.version()
    old = data.manifest(version)
    if not version or old.isEmpty():
        return version
    where = f"{data.path}/moves-{uuid.uuid4().hex}"
    moves = stash(plan(old, target, fan_in), where)
    merged = moves.agg(F.max("merged")).first()[0]
    if merged is None:
        return version
    first = old.agg(F.max("shard")).first()[0] + 1
    own = free("_shard", schema.names)
    helper = free("_moved", [*schema.names, own])
    rows = data.read(schema, manifest=old.join(moves, "shard", "left_semi")).join(moves.select(F.col("shard").alias(own), F.col("merged").alias(helper)), own).drop(own)
    new = data.shards(rows, F.col(helper) + F.lit(first), helper, merged + 1)
    version = data.commit(old.join(moves, "shard", "left_anti").unionByName(new), version)
    remove(data.spark, where)
    return version


def size_tiered_shards(docs: DataFrame, arrival_bytes: int = ARRIVAL, target: int = TARGET, fan_in: int = FAN_IN) -> DataFrame:
    """Appends ``docs`` in arrivals, compacts once, and reads the committed version back; what that version doesn't
    need is removed.

    One row per document: doc_id, shard, shard_docs, shard_bytes, version.
    """
    data = Dataset(docs.sparkSession, shared_dir(docs.sparkSession))
    append(data, docs, arrival_bytes)
    version = compact(data, docs.schema, target, fan_in)
    data.vacuum()
    own = free("_shard", docs.columns)
    manifest = data.manifest(version).select(F.col("shard").alias(own), F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))
    rows = data.read(docs.schema, version).select(F.col("doc_id").cast("long").alias("doc_id"), own)
    return rows.join(manifest, own).select("doc_id", F.col(own).alias("shard"), "shard_docs", "shard_bytes", F.lit(version).alias("version"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS b FROM documents),
s AS (SELECT greatest({ARRIVAL}, CAST(ceil(sum(b) / {ARRIVALS}.0) AS BIGINT)) AS arrival FROM d),
k AS (SELECT doc_id, b, CAST(coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // arrival AS k FROM d, s),
a AS (SELECT doc_id, b, dense_rank() OVER (ORDER BY k) - 1 AS shard FROM k),
m AS (SELECT shard, count(*) AS docs, CAST(sum(b) AS BIGINT) AS bytes FROM a GROUP BY shard),
t AS (SELECT *, (length(bin(bytes)) - 1) // 2 AS tier FROM m WHERE bytes < {TARGET}),
r AS (SELECT *, count(*) OVER (PARTITION BY tier) AS n, CAST(coalesce(sum(bytes) OVER (PARTITION BY tier ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {TARGET} AS run FROM t),
q AS (SELECT *, count(*) OVER (PARTITION BY tier, run) AS size FROM r WHERE n >= {FAN_IN}),
g AS (SELECT shard, dense_rank() OVER (ORDER BY tier, run) - 1 + (SELECT max(shard) + 1 FROM m) AS merged FROM q WHERE size > 1),
f AS (SELECT a.doc_id, a.b, coalesce(g.merged, a.shard) AS shard FROM a LEFT JOIN g ON a.shard = g.shard)
SELECT doc_id, CAST(shard AS BIGINT) AS shard, count(*) OVER (PARTITION BY shard) AS shard_docs, CAST(sum(b) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes,
CAST(CASE WHEN (SELECT count(*) FROM g) > 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM f
"""
