"""The bucketed table against a plain fold of its batches, the files it leaves alone, and feeds with repeats."""

import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carlake.operators import merge_table as M
from carlake.operators.upsert import match_keys, read_snapshot
from carlake.schemas import RAW_EVENT_DDL
from carlake.session import new_path
from carlake.streaming.feed import EVENTS, SEQUENCE, run_feed, without_repeats

DDL = "a string, b int, kept string, value string"
SCHEMA = StructType().add("a", "string").add("b", "integer").add("kept", "string").add("value", "string")


def plain(batches, null_safe):
    rows, loose = {}, []
    for batch in batches:
        for a, b, kept, value, _ in sorted(batch, key=lambda r: r[4]):
            if not null_safe and (a is None or b is None):
                loose.append((a, b, kept, value))
            elif (a, b) in rows:
                rows[a, b] = (a, b, rows[a, b][2], value)
            else:
                rows[a, b] = (a, b, kept, value)
    return sorted([*rows.values(), *loose], key=str)


def batches_of(seed, n=4):
    rng = random.Random(seed)
    return [
        [(rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, 4, 5, None]), f"k{i}.{k}", rng.choice([None, f"v{i}.{k}"]), k) for k in range(25)]
        for i in range(n)
    ]


def local(path):
    return path.removeprefix("file:").replace("//", "/")


def files_of(root):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{local(root)}/rows") for f in names if f.startswith("part-")
    }


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("null_safe", [True, False])
def test_merges_equal_a_plain_fold(spark, null_safe, monkeypatch):
    monkeypatch.setattr(M, "KEYLESS_VERSIONS", 2)
    table = M.MergeTable(new_path(spark, "merged"), SCHEMA, ["a", "b"], ["kept"], null_safe, buckets=7)
    batches = batches_of(1)
    assert table.read(spark).count() == 0 and M.read_table(spark, table.root) is None
    for i, batch in enumerate(batches):
        table.merge(spark.createDataFrame(batch, DDL + ", seq int").repartition(3), "seq")
        assert rows_of(table.read(spark)) == plain(batches[: i + 1], null_safe)
    assert rows_of(table.read(spark, before=3)) == plain(batches[:2], null_safe)
    assert rows_of(read_snapshot(spark, table.root)) == plain(batches, null_safe)
    table.merge(spark.createDataFrame(batches[3], DDL + ", seq int"), "seq", version=4)  # the last batch again
    assert rows_of(table.read(spark)) == plain(batches, null_safe)
    assert table.vacuum(spark, keep=1) > 0
    assert rows_of(table.read(spark)) == plain(batches, null_safe)
    assert table.merge(spark.createDataFrame([], DDL + ", seq int"), "seq") == []
    assert rows_of(table.read(spark)) == plain(batches, null_safe)


def test_buckets_without_a_key_of_the_batch_stay_as_they_are(spark):
    table = M.MergeTable(new_path(spark, "merged"), SCHEMA, ["a"], buckets=16)
    load = spark.range(400).select(F.concat(F.lit("k"), "id").alias("a"), F.lit(1).alias("b"), F.lit("s").alias("kept"), F.lit("old").alias("value"), "id")
    assert len(table.merge(load, "id")) == 16
    before = files_of(table.root)
    touched = table.merge(spark.createDataFrame([("k7", 2, "s", "new", 1), ("k9", 2, "s", "new", 2)], DDL + ", seq int"), "seq")
    after = files_of(table.root)
    assert len(touched) <= 2
    assert all(after[f] == t for f, t in before.items())
    assert all(int(f.split("_bucket=")[1].split("/")[0]) in touched for f in set(after) - set(before))
    assert len(set(after) - set(before)) == len(touched)  # a file a bucket
    assert table.read(spark).groupBy("value").count().collect() in ([("old", 398), ("new", 2)], [("new", 2), ("old", 398)])


def test_a_merge_that_dies_leaves_the_table_as_it_was(spark, monkeypatch):
    table = M.MergeTable(new_path(spark, "merged"), SCHEMA, ["a"], buckets=4)
    first, second = batches_of(3, 2)
    table.merge(spark.createDataFrame(first, DDL + ", seq int"), "seq")
    whole = rows_of(table.read(spark))

    def dies(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as broken:
        broken.setattr(M, "_write_manifest", dies)
        with pytest.raises(OSError):
            table.merge(spark.createDataFrame(second, DDL + ", seq int"), "seq")
    assert rows_of(table.read(spark)) == whole
    table.merge(spark.createDataFrame(second, DDL + ", seq int"), "seq")
    assert len(rows_of(table.read(spark))) > len(whole) - 1


def test_the_target_is_scanned_once_and_moves_once(spark):
    table = M.MergeTable(new_path(spark, "merged"), SCHEMA, ["a"], buckets=4)
    first = spark.createDataFrame(batches_of(5, 1)[0], DDL + ", seq int")
    table.merge(first, "seq")
    _, files, _, buckets = M._manifest(spark, table.root)
    staged = spark.read.schema(StructType([*SCHEMA.fields]).add("_seq", "integer").add("_bucket", "integer")).parquet(f"{table.root}/staged")
    plan = table._merged(M._rows(spark, table.root, files, SCHEMA), staged, buckets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1 and "Join" not in plan


def test_what_a_merge_would_do(spark):
    old = spark.createDataFrame([("x", 1), ("y", None)], "a string, b int")
    new = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 2)], "a string, b int")
    keys = ["a", "b"]
    assert rows_of(match_keys(old, new, keys, True)) == [("x", 1, "update", 2), ("y", None, "update", 1), ("z", 2, "insert", 1)]
    assert rows_of(match_keys(old, new, keys)) == [("x", 1, "update", 2), ("y", None, "insert", 1), ("y", None, "keep", 0), ("z", 2, "insert", 1)]


# --- repeated deliveries ------------------------------------------------------------------------


def record(url, title, author="Ann"):
    return {"url": url, "title": title, "author": author, "source": "wire", "summary": "s", "published_date": "2024-01-01T00:00:00"}


@pytest.fixture
def feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    places = [str(tmp_path / d) for d in ("in", "out", "check")]
    clock = [1_700_000_000]

    def deliver(name, *rows, **more):
        path = tmp_path / "in" / name
        path.write_text("\n".join(json.dumps(r) for r in rows))
        clock[0] += 10
        os.utime(path, (clock[0], clock[0]))
        run_feed(spark, *places, datetime(2026, 1, 1), remember_days=7, **more)
        return read_snapshot(spark, places[1])

    deliver.root = places[1]
    return deliver


def test_repeated_deliveries_give_one_row_and_rewrite_nothing(spark, feed):
    feed("a.json", record("u1", "Ford recall"), record("u2", "Quiet"), record(None, "lost"))
    files = files_of(feed.root)
    # each call is a new run on the old checkpoint
    rows = feed("b.json", record("u1", "Ford recall"), record("u2", "Quiet"), record("u1", "Ford recall"))
    assert files_of(feed.root) == files
    assert sorted((r.url, r.title) for r in rows.where("url is not null").collect()) == [("u1", "Ford recall"), ("u2", "Quiet")]
    rows = feed("c.json", record("u1", "Ford profit", "Bob"), record("u2", "Quiet"), record(None, "lost"))
    assert sorted((r.url, r.title, r.author) for r in rows.where("url is not null").collect()) == [("u1", "Ford profit", "Ann"), ("u2", "Quiet", "Ann")]
    assert rows.where("url is null").count() == 2  # such rows never match
    # an earlier wording that comes back is a change
    rows = feed("d.json", record("u1", "Ford recall"))
    assert [r.title for r in rows.where("url = 'u1'").collect()] == ["Ford recall"]


def test_first_and_last_row_of_a_batch_count(spark, feed):
    rows = feed("a.json", *[record("u1", f"title {k}", f"author {k}") for k in range(30)], record("u2", "x"))
    assert sorted((r.url, r.title, r.author) for r in rows.collect()) == [("u1", "title 29", "author 0"), ("u2", "x", "Ann")]


def test_late_files_are_merged(spark, feed, tmp_path):
    feed("a.json", record("u1", "new"))
    late = tmp_path / "in" / "late.json"
    late.write_text(json.dumps(record("u9", "from long ago")))
    os.utime(late, (1_000_000_000, 1_000_000_000))
    rows = feed("b.json", record("u1", "new"))
    assert sorted(r.url for r in rows.collect()) == ["u1", "u9"]


def test_repeated_events(spark, feed):
    blurb = {"title": "Chicago auto show", "url": "u1", "block_text": "Chicago auto show Feb. 6-7, 2025, held in Detroit, MI"}
    for name in ("a.json", "b.json", "c.json"):
        rows = feed(name, blurb, kind=EVENTS)
    assert [(r.title, str(r.date_start)) for r in rows.collect()] == [("Chicago auto show", "2025-02-06")]


def test_digests_are_kept_by_batch_and_forgotten_by_time(spark, tmp_path):
    """Batches as tables: no state store and no Python a record; a replay passes the same rows."""
    root, day = str(tmp_path / "digests"), 86_400_000

    def passed(batch_id, now, *rows):
        numbered = [(*r, (k,)) for k, r in enumerate(rows)]
        df = spark.createDataFrame(numbered, f"{RAW_EVENT_DDL}, {SEQUENCE} struct<k: int>")
        kept = without_repeats(df, EVENTS, root, batch_id, 7, now)
        assert "InPandas" not in kept._jdf.queryExecution().toString()
        assert kept.columns == df.columns
        return sorted((r["title"] or "none", r["block_text"]) for r in kept.collect())

    a, b, lost = ("a", "u", "one"), ("b", "u", "one"), (None, "u", "lost")
    assert passed(0, 0, a, b, lost, lost) == [("a", "one"), ("b", "one"), ("none", "lost"), ("none", "lost")]
    assert passed(1, day, a, ("b", "u", "two")) == [("b", "two")]
    assert passed(1, day, a, ("b", "u", "two")) == [("b", "two")]  # a replay
    assert passed(2, 2 * day, ("b", "u", "one"), ("b", "u", "x"), ("b", "u", "two")) == []  # its last row says nothing new
    assert passed(3, 8 * day + 1, a, ("b", "u", "two")) == [("a", "one")]  # a last came on day 1
    assert passed(7, 9 * day, a) == [("a", "one")]  # the batch before this one kept no digests
