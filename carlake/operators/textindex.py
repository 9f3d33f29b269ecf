"""Substring search without a full scan: trigrams of file groups.

Rows are written in groups (a day of articles, say), each a partition of its own. Beside them a posting table lists, for
every run of three characters in lower case, the groups whose texts hold it. A term can only occur in groups that hold all
its trigrams; only their files are read, and the real predicate then decides on each row. So rows are those of a full scan.

A term of fewer than three characters has no trigram and rules out nothing: it is searched in all groups. Postings
grow with the number of groups and of distinct trigrams, not with the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carlake.operators.reshape import union_all

GRAM = 3
GROUP = "_group"
NO_GROUP = "none"
POSTING_FILES = 64  # folders of postings, by a hash of the trigram


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none where it is shorter or null."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(low) - (GRAM - 1), F.lit(1)))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))
    return F.filter(runs, lambda g: F.char_length(g) == GRAM)


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(POSTING_FILES)).cast("int").alias("_folder")


def write_index(df: DataFrame, path: str, columns: Sequence[str], group: Column) -> None:
    """Writes the rows by group, and the postings of the trigrams of ``columns``; rows with a NULL group are a group too."""
    grouped = df.withColumn(GROUP, F.coalesce(group.cast("string"), F.lit(NO_GROUP)))
    grouped.write.mode("overwrite").partitionBy(GROUP).parquet(f"{path}/rows")
    grams = union_all(*[grouped.select(GROUP, F.explode(grams_of(F.col(c))).alias("gram")) for c in columns]).distinct()
    folder = _folder(F.col("gram"))
    by_gram = grams.select("gram", F.col(GROUP).alias("grp"), folder).repartition(POSTING_FILES, "_folder").sortWithinPartitions("_folder", "gram")
    by_gram.write.mode("overwrite").partitionBy("_folder").parquet(f"{path}/postings")


def groups_with(spark: SparkSession, path: str, term: str) -> list[str] | None:
    """The groups whose texts hold all trigrams of a term; None where it is too short to tell."""
    low = term.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return None
    # a trigram's folder is found by the same hash, so only the files of these trigrams are read
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()
    postings = spark.read.schema("gram string, grp string, _folder int").parquet(f"{path}/postings")
    held = postings.where(F.col("_folder").isin([r[0] for r in wanted]) & F.col("gram").isin(grams))
    whole = held.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return sorted(r["grp"] for r in whole.collect())  # a row a group


def candidates(spark: SparkSession, path: str, all_of: Sequence[str] = (), any_of: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """The rows of the groups that may hold each term of ``all_of`` and one of ``any_of``; also says how many groups are read.

    Apply the real predicate to them, for instance ``search_news``."""
    rows = _rows(spark, path)
    chosen: set[str] | None = None
    for term in all_of:
        found = groups_with(spark, path, term)
        if found is not None:
            chosen = set(found) if chosen is None else chosen & set(found)
    either = [groups_with(spark, path, term) for term in any_of]
    if either and None not in either:
        union = {g for found in either for g in found}
        chosen = union if chosen is None else chosen & union
    if chosen is None:
        return rows.drop(GROUP), {"groups_read": None}
    return rows.where(F.col(GROUP).isin(sorted(chosen))).drop(GROUP), {"groups_read": len(chosen)}


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their group as text, whatever it looks like."""
    schema = spark.read.parquet(f"{path}/rows").schema
    fields = [f for f in schema.fields if f.name != GROUP]
    return spark.read.schema(StructType(fields).add(GROUP, "string")).parquet(f"{path}/rows")
