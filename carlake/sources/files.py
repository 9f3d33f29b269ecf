"""Delimited, zipped and JSON files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carlake.functions.derived import any_of
from carlake.schemas import text_schema
from carlake.sources.archives import ZipMembers


def read_csv(
    spark: SparkSession,
    path,
    schema: StructType | str,
    charset: str = "ISO-8859-1",
    multi_line: bool = False,
    only_present: bool = False,
) -> DataFrame:
    """Header CSV files under a path or glob, by column name: the header says where a column stands.

    Only the header line is looked at beforehand. Columns of the schema that the files lack are NULL, or left out with
    ``only_present``; other columns are dropped. Files whose headers differ from each other are refused, so read
    each kind by itself and union them by name. Quotes in a quoted cell are doubled. ``multi_line`` allows line breaks
    in quoted cells; such files are not split."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"header": True, "enforceSchema": False, "charset": charset, "escape": '"', "multiLine": multi_line}
    raw = spark.read.options(**options).csv(path)
    there = set(raw.columns)

    def column(field):
        cell = F.col(f"`{field.name}`") if field.name in there else F.lit(None)
        return cell.try_cast(field.dataType).alias(field.name)

    return raw.select(*[column(f) for f in wanted if f.name in there or not only_present])


def read_tsv(
    spark: SparkSession,
    path,
    names: Sequence[str],
    nrows: int | None = None,
    charset: str = "ISO-8859-1",
    quote: str = "",
) -> DataFrame:
    """Headerless tab-separated files by position. A line with too many fields is skipped, a short one
    is filled with NULL: one spare column at the end catches what is too much. No character quotes, by default."""
    reader = spark.read.schema(text_schema([*names, "_spare"])).option("sep", "\t").option("charset", charset)
    reader = reader.option("quote", quote)
    rows = reader.csv(path).filter(F.col("_spare").isNull()).select(*names)
    return rows if nrows is None else rows.limit(nrows)


def read_zip(spark: SparkSession, path, pattern: str = r".*\.(txt|csv)$", charset: str = "ISO-8859-1") -> DataFrame:
    """Lines of the text files inside ZIP archives: (archive, member, line_no, line)."""
    return unzip_lines(spark.read.format("binaryFile").load(path).select("path", "content"), pattern, charset)


def unzip_lines(
    archives: DataFrame, pattern: str = r".*\.(txt|csv)$", charset: str = "ISO-8859-1", batch: int = 20000
) -> DataFrame:
    """Unpacks a column ``content`` of ZIP archives into lines.

    A ZIP archive cannot be split, so it is one task; members are unpacked as a stream and handed on in
    batches, so a task holds the packed archive and one batch. Archives are read in parallel."""
    wanted = re.compile(pattern)

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in zip(part["path"], part["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    for member in filter(wanted.match, packed.namelist()):
                        with io.TextIOWrapper(packed.open(member), encoding=charset, newline="") as lines:
                            yield from _batches(archive, member, lines, batch)

    return archives.mapInPandas(unpack, "archive string, member string, line_no long, line string")


def _batches(archive: str, member: str, lines: Iterable[str], size: int) -> Iterator[pd.DataFrame]:
    numbered = enumerate(line.rstrip("\r\n") for line in lines)
    while chunk := list(islice(numbered, size)):
        yield pd.DataFrame(
            {"archive": archive, "member": member, "line_no": [n for n, _ in chunk], "line": [x for _, x in chunk]}
        )


def read_json(spark: SparkSession, path, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """JSON files: whole arrays (``multi_line``) or one object per line, which also splits large files."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


# --- readers that keep what they cannot read ---------------------------------------------------

REJECTED = "rejected_line"  # the raw line of a record that does not fit; NULL for the others
CORRUPT, SPARE = "_corrupt_record", "_spare"


def _checked(reader, fields: StructType, separator: str, charset: str, options: dict, path) -> DataFrame:
    """Cells by position, and the raw line where there are more cells than fields.

    One spare column takes the first cell too many. Spark hands on the raw line where the number of cells differs from
    the schema's; where it does not, there is exactly one too many, and the line is put together again."""
    schema = StructType([*text_schema([f.name for f in fields]).fields]).add(SPARE, "string").add(CORRUPT, "string")
    options = {"sep": separator, "charset": charset, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    cells = reader.schema(schema).options(**options).csv(path)
    whole = F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in [*fields.names, SPARE]])
    return cells.withColumn(REJECTED, F.when(F.col(SPARE).isNotNull(), F.coalesce(CORRUPT, whole)))


def read_csv_checked(
    spark: SparkSession, path, schema: StructType | str, charset: str = "ISO-8859-1", multi_line: bool = False
) -> DataFrame:
    """As ``read_csv``, with the lines that it cannot take in ``rejected_line``: more cells than the header has, or a cell
    that is not of its column's type. Such a row has NULL in all other columns. ``write_split`` parts the two."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    header = spark.read.options(enforceSchema=False, charset=charset, **options).csv(path).schema
    cells = _checked(spark.read, header, ",", charset, options, path)
    quoted = F.concat_ws(",", *[_quoted_cell(F.col(f"`{c}`")) for c in header.names])
    there = {f.name: F.col(f"`{f.name}`") for f in header}
    cast = {f.name: there[f.name].try_cast(f.dataType) for f in wanted if f.name in there}
    bad = [there[c].isNotNull() & value.isNull() for c, value in cast.items()]
    rejected = F.coalesce(REJECTED, F.when(any_of(bad), quoted)) if bad else F.col(REJECTED)
    shown = [F.when(rejected.isNull(), cast[f.name] if f.name in cast else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
    return cells.select(*shown, rejected.alias(REJECTED))


def _quoted_cell(cell: Column) -> Column:
    needs = cell.rlike('[",\r\n]')
    return F.coalesce(F.when(needs, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell), F.lit(""))


def read_tsv_checked(spark: SparkSession, path, names: Sequence[str], charset: str = "ISO-8859-1", quote: str = "") -> DataFrame:
    """As ``read_tsv``, with the lines of too many fields in ``rejected_line`` instead of skipped.

    An empty cell is NULL, so a line that only ends in too many tabs fits; a line of blanks is no record."""
    cells = _checked(spark.read, text_schema(names), "\t", charset, {"quote": quote}, path)
    kept = F.col(REJECTED).isNull()
    return cells.select(*[F.when(kept, F.col(f"`{c}`")).alias(c) for c in names], REJECTED)


def read_json_checked(spark: SparkSession, path, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """As ``read_json``, with the records that are no JSON, or whose values do not fit the schema, in ``rejected_line``."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*wanted.fields]).add(CORRUPT, "string")
    rows = spark.read.schema(full).options(multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).json(path)
    kept = F.col(CORRUPT).isNull()
    return rows.select(*[F.when(kept, F.col(f"`{f.name}`")).alias(f.name) for f in wanted], F.col(CORRUPT).alias(REJECTED))


def read_archive_members(spark: SparkSession, path: str, pattern: str = r".*\.(txt|csv)$", charset: str = "ISO-8859-1") -> DataFrame:
    """As ``read_zip``, with a task for each member of each archive, or for many small archives (see ``archives``)."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format(ZipMembers.name()).options(pattern=pattern, charset=charset).load(path)
