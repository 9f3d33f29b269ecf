"""Stages of the pipeline: clashing columns, ties, one label, many blocks of items, damaged archives, and run as a whole."""

import gzip
import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from carlake.llm import decontaminate, simhash, substrings, toxicity, warc
from tests.llm import brute

CLASHES = "score string, r string, found string, row_key string, text_key string, _toxicity string, _items_found string, _text_key string, one string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def clashing(spark, rows):
    names = [c.split()[0] for c in CLASHES.split(", ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in names])


def test_columns_that_clash_come_back_as_they_were(spark):
    passage = prose(1, 80)
    rows = [(i, prose(10 + i, 90)) for i in range(12)] + [(20, passage + " x"), (21, "y " + passage), (22, None), (23, "")]
    documents = clashing(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    benchmark = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    made = [
        toxicity.drop_toxic(documents, labels), simhash.keep_first(documents), substrings.remove_repeats(documents),
        decontaminate.clean_documents(documents, benchmark),
    ]
    for stage in made:
        assert stage.columns == documents.columns
        for r in stage.collect():
            assert all(r[c] == f"{c} {r['doc_id']}" for c in stage.columns[2:])
    assert {r.doc_id for r in made[3].collect()} == {d for d, _ in rows} - {3}
    assert {r.doc_id: r.text for r in made[2].collect()}[21] == "y"


def test_one_known_label_drops_nothing(spark):
    documents = clashing(spark, [(i, prose(i, 30)) for i in range(8)])
    for value in (0, 1):
        labels = spark.createDataFrame([(i, value) for i in range(8)], "doc_id long, toxic int")
        assert toxicity.drop_toxic(documents, labels).count() == 8
    assert toxicity.drop_toxic(documents, labels.limit(0)).count() == 8


def test_of_equal_rows_the_first_in_order_stays(spark):
    rows = [(1, "same text here now", source) for source in ("b", "a", "c", None)] + [(2, "same text here now", "a"), (1, "another text", "z")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        assert sorted(map(tuple, simhash.keep_first(df).collect()), key=str) == [(1, "another text", "z"), (1, "same text here now", None)]


def test_many_blocks_of_items_use_one_worker_each(spark):
    items = [(i, prose(100 + i, 40)) for i in range(50)]
    rows = [(i, f"{prose(i, 20)} {items[i][1]} {prose(i + 7, 20)}" if i % 3 == 0 else prose(i, 60)) for i in range(50)] + [(None, items[4][1]), (7, None)]
    documents, benchmark = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((rows, "doc_id"), (items, "item_id")))
    want = brute.contained(rows, items)
    for block in (400_000, 30):
        pairs = decontaminate.contaminated_pairs(documents, benchmark, block_shingles=block)
        assert sorted((tuple(r) for r in pairs.drop("containment").collect()), key=str) == want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") <= 1
        clean = decontaminate.clean_documents(documents, benchmark, block_shingles=block)
        assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, t in rows if not brute.contained([(d, t)], items))
        assert clean._jdf.queryExecution().executedPlan().toString().count("EvalPython") <= 1


def test_damaged_archives_end_no_job(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", prose(i, 60)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "whole")
    warc.write_archives(pages, path)
    content = gzip.decompress(next((tmp_path / "whole").glob("*.gz")).read_bytes())
    packed = gzip.compress(content)
    bad = {
        "cut": packed[: len(packed) // 2], "noise": b"this is no archive", "empty": b"", "flipped": packed[:200] + b"\x00" * 40 + packed[240:],
        "length": gzip.compress(content.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 1)),
        "number": gzip.compress(content.replace(b"Page-Id: ", b"Page-Id: seven", 1)),
        "short": gzip.compress(content[:-700]),
    }
    for name, data in bad.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.gz").write_bytes(data)
        found = warc.read_archives(spark, str(folder)).collect()
        for r in found:
            if r.complete:
                assert sha256((r.payload or b"")).hexdigest() == r.payload_digest
        if name in ("length", "number", "short"):
            assert sum(r.complete for r in found) >= 18
        if name in ("length", "short", "cut"):
            assert any(not r.complete for r in found) or name == "cut"


# --- the pipeline as a whole --------------------------------------------------------------------


@pytest.fixture(scope="module")
def encode():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tables(spark, folder, documents, labels, items):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_equals_the_stages_done_by_hand(spark, tmp_path, encode):
    passage, item = prose(5, 70), prose(6, 30)
    texts = [prose(10 + i, 80) for i in range(12)]
    texts += [texts[0], f"{passage} one", f"two {passage} three", f"{prose(8, 10)} {item}", None, "", "Ünï çödé"]
    documents = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id at all", "en", "s", 12)]
    folder = tables(spark, tmp_path / "in", documents, [], [(1, item)])  # no labels: the toxicity stage keeps all
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    prints = {d: c for d, _, c in brute.near_components([(d, t) for d, t, *_ in documents if d is not None])}
    kept = [(d, t) for d, t, *_ in documents if d is None or prints[d] == d]
    cut = {d: words for d, _, words in ((d, None, w) for d, w in plain_cut(kept))}
    left = [(d, cut[d]) for d, _ in kept if not brute.contained([(d, cut[d])], [(1, item)])]
    assert set(found) == {d for d, _ in left} and 15 not in found and 12 not in found
    for d, t in left:
        ids = encode(t or "")
        assert found[d].n_tokens == len(ids)
        assert found[d].ids_sha256 == sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert found[d].decoded_sha256 == sha256((t or "").encode()).hexdigest()


def plain_cut(rows):
    """Texts without the words of windows that start in a smaller document too; unchanged texts as they are."""
    for (d, t), (_, n_words, kept) in zip(rows, (one for one in removed(rows))):
        yield d, t if len(kept) == n_words else " ".join(kept)


def removed(rows):
    for d, t in rows:
        words = brute.words(t)
        gone = set()
        for i in range(len(words) - 49):
            window = words[i : i + 50]
            for e, u in rows:
                other = brute.words(u)
                if d is not None and e is not None and e < d and any(other[k : k + 50] == window for k in range(len(other) - 49)):
                    gone.update(range(i, i + 50))
        yield d, len(words), [w for i, w in enumerate(words) if i not in gone]


def test_run_on_empty_tables_and_tokens_of_odd_rows(spark, tmp_path, encode):
    folder = tables(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.createDataFrame([(1, None, "en", "s"), (1, "", "en", "s"), (2, "a b", None, None), (2, "a b", None, None)], "doc_id long, text string, lang string, source string")
    made = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.to_tokens(spark, docs, folder).collect())
    assert made == [(1, 0), (1, 0), (2, len(encode("a b"))), (2, len(encode("a b")))]
