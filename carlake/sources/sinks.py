"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NESTED = ("array", "struct", "map")
# Text formats that keep microseconds, which the default ones cut off.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, which a CSV cell can hold."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.to_json(c).alias(c) if kinds[c].startswith(NESTED) else F.col(c) for c in df.columns]
    )


def csv_path(parquet_path: str) -> str:
    return parquet_path.replace("/parquet/", "/csv/")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header CSV. ``single_file`` gathers everything in one task, so it is for small exports only."""
    flat = _flat(df)
    writer = (flat.coalesce(1) if single_file else flat).write.mode("overwrite").options(header=True, **TIME_FORMATS)
    # spaces at the ends of a text belong to it
    writer.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replaces a Parquet table: the new one is written beside it, then the two change places.

    A write that fails leaves the old table as it is, and ``df`` may read from it. Of a run that dies between the two
    renames, the old table is left under ``<path>.old`` and the next call puts it back first. Readers that are
    under way lose the old files, as with any overwrite."""
    spark = df.sparkSession
    path = path.rstrip("/")
    fresh, old = f"{path}.new-{uuid.uuid4().hex[:12]}", f"{path}.old"
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place(old)) and not fs.exists(place(path)):
        fs.rename(place(old), place(path))
    try:
        df.write.partitionBy(*partition_by).parquet(fresh)
    except Exception:
        fs.delete(place(fresh), True)
        raise
    fs.delete(place(old), True)
    if fs.exists(place(path)):
        fs.rename(place(path), place(old))
    if not fs.rename(place(fresh), place(path)):
        fs.rename(place(old), place(path))
        raise OSError(f"could not move {fresh} to {path}")
    fs.delete(place(old), True)


def safe_overwrite(df: DataFrame, path: str) -> None:
    """Replaces a cleaned table; any path outside a ``/cleaned/`` folder is refused."""
    if "/cleaned/" not in path:
        raise ValueError(f"refusing to replace {path}: not below /cleaned/")
    replace_table(df, path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(ignoreNullFields=False, **TIME_FORMATS).json(path)


def load_table(df: DataFrame, name: str, path: str | None = None) -> dict[str, int]:
    """Full refresh of a table; returns the rows loaded (counted while writing) and the rows found after."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return {"loaded": seen.get["rows"], "verified": df.sparkSession.table(name).count()}


def append_audit(df: DataFrame, path: str, tables: str = "tables_accessed") -> None:
    """Appends audit rows; the list of tables becomes one comma-separated text."""
    df.withColumn(tables, F.concat_ws(",", F.col(tables))).write.mode("append").parquet(path)


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Every floating-point column rounded."""

    def shaped(name: str, kind: str) -> Column:
        return F.round(name, digits).alias(name) if kind in ("float", "double") else F.col(name)

    return df.select(*[shaped(n, k) for n, k in df.dtypes])


def export_result(df: DataFrame, path: str) -> None:
    write_csv(rounded(df), path)


def write_split(df: DataFrame, path: str, rejected: str = "rejected_line") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Writes the rows of a checked reader in one pass: those it could read, and the rejected lines to a quarantine beside them.

    Returns both tables, read back, and the numbers of their rows, counted while writing."""
    seen, mark = Observation(), "_quarantine"
    is_bad = F.col(rejected).isNotNull()
    counted = df.observe(seen, F.count(F.when(~is_bad, 1)).alias("kept"), F.count(F.when(is_bad, 1)).alias("rejected"))
    counted.withColumn(mark, is_bad).write.mode("overwrite").partitionBy(mark).parquet(path)
    schema = StructType([*df.schema.fields]).add(mark, "boolean")
    rows = df.sparkSession.read.schema(schema).parquet(path)
    kept = rows.where(~F.col(mark)).drop(mark, rejected)
    return kept, rows.where(F.col(mark)).select(rejected), {k: seen.get[k] for k in ("kept", "rejected")}
