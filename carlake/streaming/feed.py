"""Incremental news feed: new files are tagged and merged into the article or the event table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from time import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from carlake.operators.merge_table import MergeTable
from carlake.operators.upsert import ARTICLE_FROZEN, drop_snapshots, exists, latest_version, snapshot_path
from carlake.plans.news import tag_articles, tag_events
from carlake.schemas import ARTICLE_DDL, EVENT_DDL, RAW_ARTICLE_DDL, RAW_EVENT_DDL

SEQUENCE = "_seq"


@dataclass(frozen=True)
class Kind:
    """What a feed takes in: the landed columns, the table's, the tagging, how rows match, and the column that
    deliveries of one record share."""

    landed: str
    table: str
    tag: Callable[..., DataFrame]
    keys: Sequence[str]
    frozen: Sequence[str]
    null_safe: bool
    record: str


ARTICLES = Kind(RAW_ARTICLE_DDL, ARTICLE_DDL, tag_articles, ["url"], ARTICLE_FROZEN, False, "url")
EVENTS = Kind(RAW_EVENT_DDL, EVENT_DDL, tag_events, ["title", "date_start"], [], True, "title")

FILE = ["_file_time", "_file_path", "_file_block"]


def _with_file(df: DataFrame) -> DataFrame:
    meta = ["file_modification_time", "file_path", "file_block_start"]
    return df.select("*", *[F.col(f"_metadata.{m}").alias(name) for m, name in zip(meta, FILE)])


def _in_file_order(batch: DataFrame) -> DataFrame:
    """A row order that a rerun of the batch repeats: file time, file name, then place in the file."""
    return batch.withColumn(SEQUENCE, F.struct(*FILE, F.monotonically_increasing_id().alias("_file_row"))).drop(*FILE)


DAY_MS = 86_400_000
DIGESTS = "record string, digest long, came long"


def without_repeats(rows: DataFrame, kind: Kind, root: str, batch_id: int, days: int, now_ms: int | None = None) -> DataFrame:
    """The rows of a batch without deliveries that repeat what was last passed on for the same url (or title).

    ``root`` holds a table of one digest for each record and the time it last came. The batch and that table meet in one
    aggregation, which keeps a record's first and last row (all that the merge of articles needs); so a record with very many
    rows leaves each task as one. It is written once, as the version of this batch: the digests for the batch after
    it, and beside them the rows that pass. Batch n reads version n, so a replayed batch passes the same rows; where that
    version is missing (the batch before ran without this), all rows pass.

    A record is forgotten when it has not come for ``days`` days by the time of the batches, not by that of the files or
    articles, so no row is ever late. A repeat that comes later passes, and the merge makes nothing new of it.
    Records that come back in an earlier wording count as changed. Rows whose url (or title) is NULL pass by."""
    spark = rows.sparkSession
    now_ms = int(time() * 1000) if now_ms is None else now_ms
    landed = StructType.fromDDL(kind.landed).names
    record = F.col(kind.record)
    row = F.struct(*landed, SEQUENCE)
    row_type = rows.select(row.alias("row")).schema["row"].dataType
    # a row without a record is a group of its own
    alone = F.when(record.isNull(), F.monotonically_increasing_id())
    both = rows.select(
        record.alias("record"), alone.alias("_apart"), F.xxhash64(*landed).alias("digest"), F.lit(now_ms).alias("came"), row.alias("_row")
    )
    if exists(spark, f"{snapshot_path(root, batch_id)}/_SUCCESS"):
        known = spark.read.schema(DIGESTS).parquet(snapshot_path(root, batch_id))
        known = known.where(F.col("record").isNotNull() & (F.col("came") >= now_ms - days * DAY_MS))
        none = [F.lit(None).cast("long").alias("_apart"), F.lit(None).cast(row_type).alias("_row")]
        both = both.unionByName(known.select("record", "digest", "came", *none))
    fresh, order = F.col("_row").isNotNull(), F.col("_row")[SEQUENCE]
    met = both.groupBy("record", "_apart").agg(
        F.max(F.when(~fresh, F.col("digest"))).alias("known"),
        F.max("came").alias("came"),
        F.max_by(F.struct("digest", "_row"), order).alias("last"),
        F.min_by("_row", order).alias("first"),
    )
    last = F.col("last")["_row"]
    ends = F.when(F.col("first")[SEQUENCE] == last[SEQUENCE], F.array(last)).otherwise(F.array("first", last))
    changed = F.col("last").isNotNull() & ~F.col("known").eqNullSafe(F.col("last")["digest"])
    digest = F.coalesce(F.col("last")["digest"], "known")
    written = snapshot_path(root, batch_id + 1)
    met.select("record", digest.alias("digest"), "came", F.when(changed, ends).alias("passed")).write.mode("overwrite").parquet(written)
    drop_snapshots(spark, root, before=batch_id)
    return spark.read.schema(StructType().add("passed", ArrayType(row_type))).parquet(written).select(F.inline("passed"))


def run_feed(
    spark: SparkSession,
    landing: str,
    target: str,
    checkpoint: str,
    as_of: datetime,
    files_per_batch: int = 100,
    kind: Kind = ARTICLES,
    arrays: bool = False,
    remember_days: int | None = None,
    max_file_age: str = "36500d",
) -> int:
    """Takes in all files that arrived since the last run; returns the number of batches.

    ``landing`` holds raw records of the kind, one JSON object a line; with ``arrays`` every file is one JSON array
    (such a file is read by one task). ``target`` is a bucketed table (``merge_table``), read by ``read_snapshot``: a batch
    rewrites only the buckets that hold its records. Batch n always reads the version before n+1 and writes version
    n+1, so a replayed batch gives the same table. With ``remember_days`` repeated deliveries are dropped before
    they are tagged (``without_repeats``), by digests that lie beside the checkpoint.
    Files that are older than the newest one by ``max_file_age`` are the only ones ever skipped (Spark's default is a week).
    One feed writes to one target; there is no lock for a second one. A target that holds versions goes with
    the checkpoint that wrote them: a new checkpoint would number its batches from the start and is refused."""
    if latest_version(spark, f"{target}/manifest") is not None and not exists(spark, f"{checkpoint}/commits"):
        raise ValueError(f"{target} holds versions that {checkpoint} did not write")
    table = MergeTable(target, StructType.fromDDL(kind.table), kind.keys, kind.frozen, kind.null_safe)
    batches: set[int] = set()

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = _in_file_order(batch)
        if remember_days is not None:
            rows = without_repeats(rows, kind, f"{checkpoint}/digests", batch_id, remember_days)
        tagged = kind.tag(rows, as_of, keep=[SEQUENCE])
        table.merge(tagged, SEQUENCE, version=batch_id + 1)
        batches.add(batch_id)

    lines = (
        spark.readStream.schema(kind.landed)
        .option("multiLine", arrays)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", max_file_age)
        .json(landing)
    )
    query = (
        _with_file(lines)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )
    query.awaitTermination()
    return len(batches)
