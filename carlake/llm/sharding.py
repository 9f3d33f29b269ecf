"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into buckets of a size that fits a task's memory, by a seeded hash of the
record itself, one bucket a task. Pass two Fisher-Yates shuffles each bucket (the built-in shuffle of arrays) and
writes it. Read one after the other, the buckets are a random permutation of all records; cut into equal runs it
gives shards whose row counts differ by one at most (the law `rows`).

Where a record goes depends on its contents and on which of its equal copies it is, never on file splits or on the
order in which rows arrive, so a task that runs again deals out the same rows. Records that repeat so often that
their copies alone would overfill a bucket are counted, not moved, and dealt out again by the number of the copy.
Records move once: the starts of the buckets reach the written rows as a broadcast of at most MAX_BUCKETS numbers.

Edge cases: a null text has no bytes and the checksum of the empty text; rows may repeat and ids may be
null, as nothing depends on them; an empty table gives empty shards; all columns are written as they are, and are
kept in a struct, so that none clashes with the columns made here.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carlake.session import new_path

SHARDS = 24
BUCKET_BYTES = 16 * 1024 * 1024  # what one task holds while it shuffles a bucket
MIN_BUCKETS = 48
# Buckets grow with the input beyond this number (100 TB: 100 MB each), so that their starts stay some 16 MB.
MAX_BUCKETS = 1 << 20
GROUP = 1024  # buckets whose starts one task sums up
RECORD_BYTES = 8  # counted besides the text
SEED = 20


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(RECORD_BYTES)).cast("long")


def _identity(documents: DataFrame) -> Column:
    """A hash of all columns; columns that hold maps, which have no hash, count by their JSON text."""
    parts = [F.to_json(F.struct(q)) if "map<" in kind else F.col(q) for q, (_, kind) in zip(_quoted(documents), documents.dtypes)]
    return F.xxhash64(*parts)


def scatter_and_shuffle(documents: DataFrame, path: str, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> None:
    """Writes the records in shuffled buckets below path: bucket, place in it, and the record."""
    identified = documents.select(
        _identity(documents).alias("identity"), _size(F.col("text")).alias("size"), F.struct(*map(F.col, _quoted(documents))).alias("record")
    )
    copies = identified.groupBy("identity").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    weight = F.col("n") * F.col("size")
    total, most = copies.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    bucket_bytes = max(bucket_bytes, ceil(total / MAX_BUCKETS))
    buckets = max(MIN_BUCKETS, ceil(total / bucket_bytes))
    if most <= bucket_bytes:
        dealt = identified.withColumn("copy", F.lit(0).cast("long"))
    else:
        # at most total / bucket_bytes rows, so MAX_BUCKETS of them
        often = F.broadcast(copies.where(weight > bucket_bytes).select(F.col("identity").alias("often")))
        marked = identified.join(often, F.col("identity") == F.col("often"), "left")
        counted = marked.where(F.col("often").isNotNull()).groupBy("identity", "record").agg(F.count("*").alias("n"))
        again = counted.select("identity", "record", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        rest = marked.where(F.col("often").isNull()).select("identity", "record", F.lit(0).cast("long").alias("copy"))
        dealt = rest.union(again)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("identity"), F.col("copy")), F.lit(buckets)).cast("int")
    scattered = dealt.select(bucket.alias("bucket"), F.struct("identity", "copy", "record").alias("r"))
    # in the order of identities, so that the draw depends on the seed and not on arrival
    ordered = scattered.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "r.identity", "r.copy")
    drawn = ordered.groupBy("bucket").agg(F.shuffle(F.collect_list("r"), seed).alias("drawn"))
    placed = drawn.select("bucket", F.posexplode("drawn").alias("place", "r"))
    placed.select("bucket", "place", "r.record").write.parquet(path)


def bucket_starts(rows: DataFrame) -> DataFrame:
    """bucket, the number of records before it, and that of all records; summed up in groups of GROUP buckets."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("grp", F.expr(f"bucket div {GROUP}"))
    groups = counts.groupBy("grp").agg(F.sum("n").alias("grp_n"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = groups.select(
        "grp", F.coalesce(F.sum("grp_n").over(before), F.lit(0)).alias("offset"), F.sum("grp_n").over(everything).alias("total")
    )
    within = Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return summed.join(offsets, "grp").select("bucket", (F.col("offset") + F.col("within")).alias("start"), "total")


def read_shards(spark: SparkSession, path: str, shards: int = SHARDS) -> DataFrame:
    """The written records with their shard and slot: equal runs of the permutation."""
    rows = spark.read.parquet(path)
    # at most MAX_BUCKETS rows of three numbers
    at = rows.join(F.broadcast(bucket_starts(rows)), "bucket")
    shard = F.expr(f"(start + place) * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # least place of the shard
    return at.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr("start + place") - first).select("shard", "slot", "record")


def shard_documents(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Shuffles documents into shards, written below path (else the shared folder), and reads them back."""
    spark = documents.sparkSession
    path = path or new_path(spark, "shards")
    scatter_and_shuffle(documents, path, seed=seed)
    return read_shards(spark, path, shards)


def shard_digest(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard_documents(documents, shards).select(
        F.col("record.doc_id").alias("doc_id"),
        _size(F.col("record.text")).alias("size"),
        F.crc32(F.coalesce(F.col("record.text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _quoted(df: DataFrame) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in df.columns]
