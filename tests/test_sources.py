"""Readers on files written by hand."""

import json
import zipfile
from datetime import datetime

import pytest

from carlake.sources import files, markup
from carlake.streaming.feed import EVENTS, run_feed
from carlake.operators.upsert import read_snapshot


def test_zip(spark, tmp_path):
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"a{n}.zip", "w") as z:
            z.writestr("data.txt", "one\r\ntwo\nthré".encode("latin-1"))
            z.writestr("skip.pdf", "no")
    rows = files.read_zip(spark, str(tmp_path / "*.zip")).orderBy("archive", "line_no").collect()
    assert [r["line"] for r in rows] == ["one", "two", "thré"] * 2
    assert [r["line_no"] for r in rows] == [0, 1, 2] * 2


def test_zip_in_small_batches(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data.csv", "\n".join(str(i) for i in range(25)))
    archives = spark.read.format("binaryFile").load(str(tmp_path / "a.zip"))
    rows = files.unzip_lines(archives.select("path", "content"), batch=10).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == [str(i) for i in range(25)]


def test_tsv_skips_long_and_fills_short_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("1\tx\té\n2\ty\n3\ta\tb\tc\n".encode("latin-1"))
    rows = files.read_tsv(spark, str(tmp_path / "a.txt"), ["a", "b", "c"]).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", "x", "é"), ("2", "y", None)]
    assert files.read_tsv(spark, str(tmp_path / "a.txt"), ["a", "b", "c"], nrows=1).count() == 1


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "a", "key_topics": ["x"], "location": None}, {"title": "b", "key_topics": []}]))
    rows = files.read_json(spark, str(tmp_path / "a.json"), "title string, key_topics array<string>, location string")
    assert [(r["title"], r["key_topics"]) for r in rows.orderBy("title").collect()] == [("a", ["x"]), ("b", [])]


def test_vehicle_xml_defaults(spark, tmp_path):
    (tmp_path / "v.xml").write_text(
        "<vehicles><vehicle><id>7</id><make>Kia</make><range/><VClass></VClass><displ>2.0</displ></vehicle></vehicles>"
    )
    row = markup.read_vehicle_xml(spark, str(tmp_path / "v.xml")).first()
    assert len(row) == 31
    assert (row["epa_id"], row["make"], row["electric_range"], row["vehicle_class"]) == ("7", "Kia", "0", "Unknown")
    assert (row["model"], row["displacement_liters"], row["engine_descriptor"]) == (None, "2.0", "")


def test_rss(spark, tmp_path):
    def item(i, title="t", date="Tue, 02 Jan 2024 03:04:05 +0000"):
        return (
            f"<item><title>{title}</title><link>https://x/{i}</link><description>a &lt;i&gt;b&lt;/i&gt;</description>"
            f"<pubDate>{date}</pubDate><dc:creator>Ann</dc:creator></item>"
        )

    body = item(1) + item(2, title="") + item(3, date="soon") + item(4)
    (tmp_path / "f.xml").write_text(
        f'<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>{body}</channel></rss>'
    )
    rows = markup.read_rss(spark, str(tmp_path / "f.xml"), datetime(2026, 1, 1), cap=3).orderBy("url").collect()
    assert [(r["url"], r["published_date"]) for r in rows] == [
        ("https://x/1", datetime(2024, 1, 2, 3, 4, 5)), ("https://x/3", datetime(2026, 1, 1))
    ]
    assert rows[0]["summary"] == "a b" and rows[0]["author"] == "Ann"


def test_headline_blocks(spark):
    html = '<h3><a href="/a">Auto  <b>show</b></a></h3><h3>no link</h3><h3><a href="http://y/z">Go</a></h3><h3><a href="http://y/z">Expo</a> 2025</h3>'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = markup.extract_blocks(df, "html", "https://x").collect()
    assert [(r["title"], r["url"], r["block_text"]) for r in rows] == [
        ("Auto show", "https://x/a", "Auto show"), ("Expo", "http://y/z", "Expo 2025")
    ]


def test_feed_takes_new_files_only(spark, tmp_path):
    landing, target, checkpoint = (str(tmp_path / d) for d in ("landing", "target", "checkpoint"))
    (tmp_path / "landing").mkdir()

    def deliver(name, *rows):
        (tmp_path / "landing" / name).write_text("\n".join(json.dumps(r) for r in rows))

    def row(url, title, author):
        return {"url": url, "title": title, "author": author, "source": "wire", "summary": "s", "published_date": "2024-01-01T00:00:00"}

    deliver("a.json", row("u1", "Ford recall", "Ann"), row("u1", "Ford recall again", "Bob"))
    assert run_feed(spark, landing, target, checkpoint, datetime(2026, 1, 1)) == 1
    first = read_snapshot(spark, target).collect()
    assert [(r["url"], r["title"], r["author"], r["category"]) for r in first] == [("u1", "Ford recall again", "Ann", "recalls")]
    deliver("b.json", row("u2", "Quiet", "Cid"), row("u1", "Ford profit", "Dan"))
    assert run_feed(spark, landing, target, checkpoint, datetime(2026, 1, 1)) == 1
    assert run_feed(spark, landing, target, checkpoint, datetime(2026, 1, 1)) == 0
    rows = sorted((r["url"], r["title"], r["author"]) for r in read_snapshot(spark, target).collect())
    assert rows == [("u1", "Ford profit", "Ann"), ("u2", "Quiet", "Cid")]


def test_event_feed_reads_arrays_and_merges(spark, tmp_path):
    places = [str(tmp_path / d) for d in ("in", "out", "check")]
    (tmp_path / "in").mkdir()

    def deliver(name, *rows):
        (tmp_path / "in" / name).write_text(json.dumps([{"title": t, "url": u, "block_text": b} for t, u, b in rows]))
        return run_feed(spark, *places, datetime(2025, 1, 1), kind=EVENTS, arrays=True)

    dated = "Chicago auto show Feb. 6-7, 2025, held in Detroit, MI"
    assert deliver("a.json", ("Chicago auto show", "u1", dated), ("Expo", "u2", "no date")) == 1
    assert deliver("b.json", ("Chicago auto show", "u3", dated), ("Expo", "u4", "no date at all")) == 1
    rows = sorted((r["title"], r["url"], str(r["date_start"])) for r in read_snapshot(spark, places[1]).collect())
    assert rows == [("Chicago auto show", "u3", "2025-02-06"), ("Expo", "u4", "None")]


def test_feed_refuses_a_new_checkpoint_on_an_old_target(spark, tmp_path):
    from carlake.operators.upsert import read_snapshot
    from carlake.streaming.feed import run_feed

    def deliver(name, url):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(f'{{"title": "t", "url": "{url}", "summary": "s"}}\n')

    places = [str(tmp_path / n) for n in ("in", "out", "check")]
    deliver("a.json", "u1")
    assert run_feed(spark, *places, datetime(2026, 1, 1)) == 1
    deliver("b.json", "u2")
    with pytest.raises(ValueError):
        run_feed(spark, *places[:2], str(tmp_path / "new"), datetime(2026, 1, 1))
    assert run_feed(spark, *places, datetime(2026, 1, 1)) == 1
    assert sorted(r["url"] for r in read_snapshot(spark, places[1]).collect()) == ["u1", "u2"]


def test_csv_headers_that_differ_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,txt\n1,x\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path), "txt string, id int, z string").collect()] == [("x", 1, None)]
    (tmp_path / "b.csv").write_text("txt,id\ny,2\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path), "txt string, id int").collect()


def test_quotes_in_csv_and_none_in_tsv(spark, tmp_path):
    (tmp_path / "q.csv").write_text('z,id,txt\nZ,1,"he said ""stop"", then"\n')
    assert files.read_csv(spark, str(tmp_path / "q.csv"), "id int, txt string").first()["txt"] == 'he said "stop", then'
    (tmp_path / "q.tsv").write_text('1\t"loose quote\tx\n')
    assert tuple(files.read_tsv(spark, str(tmp_path / "q.tsv"), ["a", "b", "c"]).first()) == ("1", '"loose quote', "x")
