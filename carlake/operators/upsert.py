"""Keyed upserts as set operations, and numbered snapshots to keep their results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carlake.functions.derived import any_of

ARTICLE_FROZEN = ["source", "author"]


def fold_batch(updates: DataFrame, keys: Sequence[str], sequence: str, frozen: Sequence[str] = ()) -> DataFrame:
    """One row per key as if the rows had been applied one by one in ``sequence`` order.

    The last row gives the updated columns, the first one the frozen columns."""
    moving = [c for c in updates.columns if c not in {*keys, *frozen, sequence}]
    last = F.max_by(F.struct(*moving), sequence).alias("_last")
    first = F.min_by(F.struct(F.lit(1).alias("_one"), *frozen), sequence).alias("_first")
    folded = updates.groupBy(*keys).agg(last, first)
    return folded.select(
        *keys,
        *[F.col(f"_last.{c}").alias(c) for c in moving],
        *[F.col(f"_first.{c}").alias(c) for c in frozen],
    )


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    sequence: str,
    frozen: Sequence[str] = (),
    null_safe: bool = False,
) -> DataFrame:
    """The target after the batch: matched rows take the batch's values except the frozen columns.

    With ``null_safe`` NULL matches NULL; without it a NULL key never matches, so each such row is inserted. The target
    has one row per key. Both sides are read once and meet in one aggregation, which folds the batch on the way, so
    a key with many updates leaves each task as one row; rows with a NULL key are spread by a number of their own."""
    return merge_rows(tagged_rows(target, updates, keys, sequence, frozen, null_safe), target.columns, keys, frozen)


def tagged_rows(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], sequence: str, frozen: Sequence[str], null_safe: bool
) -> DataFrame:
    """Rows of both sides with their keys, a group number for rows that never match, and the contents as structs."""
    moving = [c for c in target.columns if c not in {*keys, *frozen}]
    alone = F.when(any_of([F.col(k).isNull() for k in keys]), F.monotonically_increasing_id() + 1).otherwise(F.lit(0))

    def side(df: DataFrame, sign: int, seq: Column) -> DataFrame:
        contents = [F.struct(F.lit(1).alias("_one"), *cols).alias(name) for name, cols in (("_moving", moving), ("_frozen", frozen))]
        apart = F.lit(0).cast("long") if null_safe else (alone * sign).cast("long")
        return df.select(*keys, apart.alias("_apart"), seq.alias("_seq"), *contents)

    kind = dict(updates.dtypes)[sequence]
    return side(target, -1, F.lit(None).cast(kind)).unionByName(side(updates, 1, F.col(sequence)))


def merge_rows(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], frozen: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per key out of tagged rows; ``by`` are columns that the keys decide."""
    old = F.col("_seq").isNull()
    merged = rows.groupBy(*by, *keys, "_apart").agg(
        F.first(F.when(old, F.col("_moving")), ignorenulls=True).alias("_old_moving"),
        F.first(F.when(old, F.col("_frozen")), ignorenulls=True).alias("_old_frozen"),
        F.max_by("_moving", "_seq").alias("_last"),
        F.min_by("_frozen", "_seq").alias("_first"),
    )
    now, kept = F.coalesce("_last", "_old_moving"), F.coalesce("_old_frozen", "_first")
    shown = {c: (kept if c in frozen else now)[c].alias(c) for c in columns if c not in keys}
    return merged.select(*by, *[shown.get(c, F.col(c)) for c in columns])


def match_keys(target: DataFrame, updates: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """What a merge would do to each key: ``update`` a row, ``insert`` one (n rows of a NULL key that never matches), ``keep`` it."""
    flags = [F.struct(*keys).alias("_key"), any_of([F.col(k).isNull() for k in keys]).alias("_alone")]
    both = target.select(*flags, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionAll(
        updates.select(*flags, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    side = F.lit(0) if null_safe else F.when(F.col("_alone"), F.col("_new")).otherwise(F.lit(0))
    met = both.groupBy("_key", side.alias("_side")).agg(F.sum("_old").alias("old"), F.sum("_new").alias("new"))
    outcome = F.when(F.col("new") == 0, "keep").when(F.col("old") == 0, "insert").otherwise("update")
    return met.select("_key.*", outcome.alias("outcome"), F.col("new").alias("n_updates"))


def upsert_articles(target: DataFrame, updates: DataFrame, sequence: str) -> DataFrame:
    return upsert(target, updates, ["url"], sequence, ARTICLE_FROZEN)


def upsert_texts(target: DataFrame, updates: DataFrame, sequence: str, key: str, chars: int | None = None) -> DataFrame:
    """Texts kept beside their vectors, by id; ``chars`` is how much of a text an index stores."""
    shown = updates if chars is None else updates.withColumn("text", F.substring("text", 1, chars))
    return upsert(target, shown, [key], sequence)


def upsert_events(target: DataFrame, updates: DataFrame, sequence: str) -> DataFrame:
    return upsert(target, updates, ["title", "date_start"], sequence, null_safe=True)


# --- snapshots: Spark cannot overwrite what it reads, so a new numbered directory is written ----------


def snapshot_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version:010d}"


def write_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Writing the same version again replaces it, so a replayed batch leaves one result."""
    df.write.mode("overwrite").parquet(snapshot_path(root, version))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest complete snapshot (one with its success mark), optionally below ``before``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    versions = []
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            versions.append(int(name[2:]))
    versions = [v for v in versions if before is None or v < before]
    return max(versions, default=None)


def drop_snapshots(spark: SparkSession, root: str, before: int) -> None:
    """Removes the versions below ``before``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(place):
        name = entry.getPath().getName()
        if name.startswith("v=") and int(name[2:]) < before:
            fs.delete(entry.getPath(), True)


def read_snapshot(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest state of a table: of its whole snapshots, or of a bucketed one (``merge_table``)."""
    if exists(spark, f"{root}/manifest"):
        from carlake.operators.merge_table import read_table

        return read_table(spark, root, before)
    version = latest_version(spark, root, before)
    return None if version is None else spark.read.parquet(snapshot_path(root, version))
