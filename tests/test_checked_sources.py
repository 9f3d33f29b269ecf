"""Readers that keep rejected lines, counts out of footers, and members of archives."""

import zipfile

import pytest
from pyspark.sql import functions as F

from carlake.session import new_path
from carlake.sources import catalog, files, sinks


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tsv_keeps_lines_of_too_many_fields(spark, tmp_path):
    lines = ["a\tb", "one", "x\ty\tz", "x\ty\tz\tw", "x\t\tz", 'q"\tr', "", "\t\t"]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n", encoding="latin-1")
    found = files.read_tsv_checked(spark, str(tmp_path), ["m", "n"])
    assert rows_of(found) == sorted(
        [("a", "b", None), ("one", None, None), (None, None, "x\ty\tz"), (None, None, "x\ty\tz\tw"), (None, None, "x\t\tz"), ('q"', "r", None)]
        # a line of blanks is no record
        ,
        key=str,
    )
    kept, rejected, counts = sinks.write_split(found, new_path(spark, "split"))
    assert counts == {"kept": 3, "rejected": 3} and kept.columns == ["m", "n"]
    assert rows_of(rejected) == [("x\t\tz",), ("x\ty\tz",), ("x\ty\tz\tw",)]


def test_csv_keeps_lines_that_do_not_fit_the_header_or_the_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,what,extra\n1,"say ""no"", now",x\n2,b\n3,c,x,more\nfour,"d, e",x\n,f,x\n')
    found = files.read_csv_checked(spark, str(tmp_path), "what string, id int, absent double")
    assert rows_of(found) == sorted(
        [('say "no", now', 1, None, None), ("b", 2, None, None), (None, None, None, "3,c,x,more"), (None, None, None, 'four,"d, e",x'), ("f", None, None, None)],
        key=str,
    )


def test_json_keeps_what_is_no_record(spark, tmp_path):
    lines = ['{"id": 1, "t": "a"}', '{"id": 2}', '{"id": "x", "t": "b"}', "not json", '{"id": 3, "t": ']
    (tmp_path / "a.json").write_text("\n".join(lines))
    found = files.read_json_checked(spark, str(tmp_path), "id long, t string")
    assert rows_of(found) == sorted([(1, "a", None), (2, None, None), *[(None, None, x) for x in lines[2:]]], key=str)
    assert sinks.write_split(found, new_path(spark, "split"))[2] == {"kept": 2, "rejected": 3}


def test_counts_come_out_of_footers(spark):
    paths = {}
    for name, n in (("some", 1000), ("none", 0)):
        paths[name] = new_path(spark, name)
        spark.range(n).repartition(3).write.parquet(paths[name])
    counts = catalog.footer_counts(spark, paths)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 2
    assert rows_of(counts) == [("none", 0), ("some", 1000)]
    assert rows_of(catalog.catalog_of_files(spark, paths)) == [("none", 0, 1, "id", "bigint", True), ("some", 1000, 1, "id", "bigint", True)]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


# --- archives -----------------------------------------------------------------------------------


def packed(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as archive:
        for name, text in members.items():
            archive.writestr(name, text.encode("latin-1"))


def test_members_are_read_one_by_one(spark, tmp_path):
    packed(tmp_path / "a.zip", {"x.txt": "one\r\ntwö\n", "dir/y.csv": "three", "skip.pdf": "no", "empty.txt": ""})
    packed(tmp_path / "b.zip", {"z.txt": "\n".join(f"line {i}" for i in range(50_000))}, zipfile.ZIP_STORED)
    (tmp_path / "c.zip").write_bytes(b"not an archive")
    found = files.read_archive_members(spark, str(tmp_path / "[ab].zip"))
    assert found.rdd.getNumPartitions() == 4  # x.txt, y.csv, empty.txt, z.txt
    assert found.count() == 50_003
    of_a = [(r.member, r.line_no, r.line) for r in found.where("member <> 'z.txt'").collect()]
    assert sorted(of_a) == [("dir/y.csv", 0, "three"), ("x.txt", 0, "one"), ("x.txt", 1, "twö")]
    old = files.read_zip(spark, str(tmp_path / "[ab].zip"))
    assert rows_of(found.select("member", "line_no", "line")) == rows_of(old.select("member", "line_no", "line"))
    with pytest.raises(Exception, match="c.zip"):
        files.read_archive_members(spark, str(tmp_path / "c.zip")).count()


def test_many_small_archives_share_tasks(spark, tmp_path):
    for k in range(300):
        packed(tmp_path / f"{k:03d}.zip", {"x.txt": f"one of {k}\r\ntwo", "skip.pdf": "no", "y.csv": f"three of {k}"})
    found = files.read_archive_members(spark, str(tmp_path))
    assert 40 <= found.rdd.getNumPartitions() < 150
    old = files.read_zip(spark, str(tmp_path))
    assert rows_of(found.select("member", "line_no", "line")) == rows_of(old.select("member", "line_no", "line"))
    assert found.select("archive").distinct().count() == 300
    (tmp_path / "bad.zip").write_bytes(b"not an archive")
    with pytest.raises(Exception, match="bad.zip is no sound archive"):
        files.read_archive_members(spark, str(tmp_path)).count()


def test_no_archives_no_rows(spark, tmp_path):
    packed(tmp_path / "a.zip", {"skip.pdf": "no"})
    assert files.read_archive_members(spark, str(tmp_path / "*.zip")).count() == 0


# --- replacing a table --------------------------------------------------------------------------


def test_a_failed_write_leaves_the_old_table(spark):
    path = new_path(spark, "lake") + "/cleaned/t"
    sinks.safe_overwrite(spark.range(5), path)
    bad = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("no"))).otherwise("x").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.safe_overwrite(bad, path)
    assert spark.read.parquet(path).count() == 5
    # a table may be made out of itself
    sinks.safe_overwrite(spark.read.parquet(path).selectExpr("id + 1 as id"), path)
    assert rows_of(spark.read.parquet(path)) == [(i,) for i in range(1, 6)]
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    assert [f.getPath().getName() for f in fs.listStatus(parent)] == ["t"]
    # a run that died between the renames
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs.rename(place(path), place(path + ".old"))
    with pytest.raises(Exception, match="no"):
        sinks.safe_overwrite(bad, path)
    assert spark.read.parquet(path).count() == 5
