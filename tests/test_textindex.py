"""Trigram postings: the rows of a full scan out of fewer files."""

import pytest
from pyspark.sql import functions as F

from carlake.operators import textindex as X
from carlake.operators.search import _mentions
from carlake.session import new_path

TEXTS = [
    ("a", "Battery plant opens", "Ford builds"), ("a", "Quiet day", None), ("b", "A BATTERY of tests", "plant life"), ("c", None, "ÉLAN plané ß"),
    ("c", "ab", "xy"), (None, "no group battery plant", "x"), ("7", "number 7", "Honda 100%_sure"), ("d", "", ""),
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(TEXTS, "grp string, title string, summary string")
    path = new_path(spark, "index")
    X.write_index(df, path, ["title", "summary"], F.col("grp"))
    return df, path


@pytest.mark.parametrize("term", ["battery plant", "BATTERY", "élan", "honda", "100%_", "ab", "x", "", "nowhere", "tery o"])
def test_candidates_hold_all_rows_of_a_scan(spark, index, term):
    df, path = index
    want = sorted(map(tuple, df.where(_mentions(term, "title", "summary")).collect()), key=str)
    rows, read = X.candidates(spark, path, all_of=[term])
    assert sorted(map(tuple, rows.where(_mentions(term, "title", "summary")).collect()), key=str) == want
    assert (read["groups_read"] is None) == (len(term) < 3)
    if len(term) >= 3:
        assert read["groups_read"] <= 3


def test_files_of_other_groups_are_not_read(spark, index):
    _, path = index
    rows, read = X.candidates(spark, path, all_of=["battery"], any_of=["ford", "nothing"])
    assert read["groups_read"] == 1
    assert {f.split("_group=")[1].split("/")[0] for f in (r[0] for r in rows.select(F.col("_metadata.file_path")).distinct().collect())} == {"a"}
    rows, _ = X.candidates(spark, path, all_of=["battery", "ab"], any_of=["fo"])
    assert rows.count() == 4  # short terms rule out nothing
    assert X.candidates(spark, path, all_of=["nowhere"])[0].count() == 0
    assert X.candidates(spark, path)[0].count() == len(TEXTS)
