"""A Parquet table that a merge rewrites only where the batch has keys.

Rows lie in hash buckets of their key, ``rows/_bucket=b/_version=v``. A merge reads the buckets that hold a key of the
batch, merges them in one aggregation and writes them as a new version; all other buckets stay the files they are. The
small manifest of a version says which files make up the table. It is written last, so a merge that dies leaves the
table as it was, and one that runs again (same version, same batch) writes the same rows to the same places through
Spark's dynamic partition overwrite.

Rows with a NULL key never match (unless ``null_safe``); they only ever get appended, under the bucket KEYLESS, as they lie in
their tasks, and are rewritten together once every KEYLESS_VERSIONS merges, so the list of files stays short.

One writer at a time. The number of buckets is fixed by the first merge: some hundred MB a bucket, as one task sorts one."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from carlake.functions.derived import any_of
from carlake.operators.upsert import fold_batch, latest_version, merge_rows, snapshot_path, tagged_rows, write_snapshot

BUCKETS = 64
KEYLESS = -1
KEYLESS_VERSIONS = 50
BUCKET, VERSION = "_bucket", "_version"
Files = dict[int, list[int]]


def _manifest(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, Files, str, int] | None:
    """The newest version, its files by bucket, the schema, and the number of buckets: a row a file, so some thousands."""
    version = latest_version(spark, f"{root}/manifest", before)
    if version is None:
        return None
    rows = spark.read.parquet(snapshot_path(f"{root}/manifest", version)).collect()
    files: Files = defaultdict(list)
    for r in rows:
        if r.bucket is not None:
            files[r.bucket].append(r.version)
    return version, files, rows[0].schema, rows[0].buckets


def _write_manifest(spark: SparkSession, root: str, version: int, files: Files, schema: StructType, buckets: int) -> None:
    rows = [(b, v) for b, versions in files.items() for v in versions] or [(None, None)]
    listed = spark.createDataFrame([(b, v, schema.json(), buckets) for b, v in rows], "bucket int, version long, schema string, buckets int")
    write_snapshot(listed.coalesce(1), f"{root}/manifest", version)


def _rows(spark: SparkSession, root: str, files: Files, schema: StructType, only: Sequence[int] | None = None) -> DataFrame:
    paths = [f"{root}/rows/{BUCKET}={b}/{VERSION}={v}" for b, vs in sorted(files.items()) if only is None or b in only for v in vs]
    full = StructType([*schema.fields]).add(BUCKET, IntegerType()).add(VERSION, LongType())
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{root}/rows").parquet(*paths)


def read_table(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The table at its newest version, optionally the newest below ``before``; None before the first merge."""
    found = _manifest(spark, root, before)
    if found is None:
        return None
    _, files, schema, _ = found
    return _rows(spark, root, files, StructType.fromJson(json.loads(schema))).drop(BUCKET, VERSION)


@dataclass(frozen=True)
class MergeTable:
    """Where a table lies and how rows match; ``schema`` is that of its rows."""

    root: str
    schema: StructType
    keys: Sequence[str]
    frozen: Sequence[str] = ()
    null_safe: bool = False
    buckets: int = BUCKETS

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        found = read_table(spark, self.root, before)
        return spark.createDataFrame([], self.schema) if found is None else found

    def _bucket(self, buckets: int) -> Column:
        by_key = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        return by_key if self.null_safe else F.when(any_of([F.col(k).isNull() for k in self.keys]), F.lit(KEYLESS)).otherwise(by_key)

    def merge(self, updates: DataFrame, sequence: str, version: int | None = None) -> list[int]:
        """Merges a batch as ``version`` (else the next one) and returns the buckets it rewrote."""
        spark = updates.sparkSession
        found = _manifest(spark, self.root, version)
        last, files, _, buckets = found or (0, {}, None, self.buckets)
        version = last + 1 if version is None else version

        staged_at = f"{self.root}/staged/v={version:010d}"
        placed = updates.select(*self.schema.names, F.col(sequence).alias("_seq"), self._bucket(buckets).alias(BUCKET))
        # a row that never matches is a group of its own
        alone = F.when(F.col(BUCKET) == KEYLESS, F.monotonically_increasing_id()).alias("_apart")
        folded = fold_batch(placed.select("*", alone), [BUCKET, *self.keys, "_apart"], "_seq", self.frozen)
        # the batch is read once here and may be costly to make
        folded.drop("_apart").withColumn("_seq", F.lit(1)).write.mode("overwrite").parquet(staged_at)
        staged = spark.read.schema(StructType([*self.schema.fields]).add("_seq", IntegerType()).add(BUCKET, IntegerType())).parquet(staged_at)
        touched = sorted(r[0] for r in staged.select(BUCKET).distinct().collect())

        new_files = {b: list(vs) for b, vs in files.items()}
        parts = []
        keyed_buckets = [b for b in touched if b != KEYLESS]
        if keyed_buckets:
            parts.append(self._merged(_rows(spark, self.root, files, self.schema, keyed_buckets), staged, buckets))
            new_files |= {b: [version] for b in keyed_buckets}
        if KEYLESS in touched:
            fresh = staged.where(F.col(BUCKET) == KEYLESS).select(BUCKET, *self.schema.names)
            held = files.get(KEYLESS, [])
            if len(held) >= KEYLESS_VERSIONS:
                fresh = fresh.unionByName(_rows(spark, self.root, files, self.schema, [KEYLESS]).select(BUCKET, *self.schema.names))
                held = []
            parts.append(fresh)
            new_files[KEYLESS] = [*held, version]
        if parts:
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            writer = rows.withColumn(VERSION, F.lit(version).cast("long")).write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(f"{self.root}/rows")
        _write_manifest(spark, self.root, version, new_files, self.schema, buckets)
        return touched

    def _merged(self, held: DataFrame, staged: DataFrame, buckets: int) -> DataFrame:
        """Both sides dealt out by bucket, one a task: the aggregation and the files follow without another shuffle."""
        keys = [BUCKET, *self.keys]
        old = held.select(BUCKET, *self.schema.names)
        rows = tagged_rows(old, staged.where(F.col(BUCKET) != KEYLESS), keys, "_seq", self.frozen, True)
        dealt = rows.repartitionById(buckets, F.col(BUCKET))
        return merge_rows(dealt, [BUCKET, *self.schema.names], keys, self.frozen)

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Removes the files that none of the last ``keep`` versions uses, and staged batches; returns how many folders went.

        A reader of an older version loses its files, so ``keep`` covers the longest query."""
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        used: set[tuple[int, int]] = set()
        before, versions = None, []
        for _ in range(keep):
            found = _manifest(spark, self.root, before)
            if found is None:
                break
            before = found[0]
            versions.append(before)
            used |= {(b, v) for b, vs in found[1].items() for v in vs}
        if not versions:
            return 0
        gone = 0
        for bucket in fs.listStatus(path(f"{self.root}/rows")):
            name = bucket.getPath().getName()
            if not name.startswith(f"{BUCKET}="):
                continue
            for part in fs.listStatus(bucket.getPath()):
                key = (int(name.split("=")[1]), int(part.getPath().getName().split("=")[1]))
                if key not in used and key[1] <= max(versions):
                    gone += fs.delete(part.getPath(), True)
        for folder in ("staged", "manifest"):
            for entry in fs.listStatus(path(f"{self.root}/{folder}")):
                number = int(entry.getPath().getName().split("=")[1])
                if number < min(versions) or folder == "staged" and number <= max(versions):
                    gone += fs.delete(entry.getPath(), True)
        return gone
