"""Metadata of tables as rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carlake.operators.reshape import union_all


def catalog_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and column: position, name, type, nullable, and the table's row count.

    The schema is known to the driver; only the counts run as a job, all tables in one."""

    def profile(name: str, df: DataFrame) -> DataFrame:
        columns = [
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"),
            )
            for i, f in enumerate(df.schema.fields, 1)
        ]
        counted = df.agg(F.count("*").alias("row_count"))
        return counted.select(F.lit(name).alias("table_name"), "row_count", F.inline(F.array(*columns)))

    return union_all(*[profile(n, d) for n, d in tables.items()])


# the V2 reader answers counts out of the footers of Parquet files
FOOTER_COUNTS = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": ""}


def footer_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count) of Parquet tables, without reading a row: all tables in one job, in a session of its own."""
    session = spark.newSession()
    for key, value in FOOTER_COUNTS.items():
        session.conf.set(key, value)
    counts = [session.read.parquet(path).agg(F.count("*").alias("row_count")) for path in paths.values()]
    # a table without row groups has no footer to count in and gives NULL, though a count is never NULL to the optimizer
    rows = F.coalesce(F.nullif(F.col("row_count"), F.lit(-1)), F.lit(0)).alias("row_count")
    named = [c.select(F.lit(name).alias("table_name"), rows) for name, c in zip(paths, counts)]
    return union_all(*named)


def catalog_of_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """As ``catalog_profile``, for Parquet tables by their paths, with the counts out of the files' footers."""
    found = {r["table_name"]: r["row_count"] for r in footer_counts(spark, paths).collect()}  # a row a table
    rows = [
        (name, found[name], i, f.name, f.dataType.simpleString(), f.nullable)
        for name, path in paths.items()
        for i, f in enumerate(spark.read.parquet(path).schema.fields, 1)
    ]
    ddl = "table_name string, row_count long, position int, column_name string, data_type string, nullable boolean"
    return spark.createDataFrame(rows, ddl)
