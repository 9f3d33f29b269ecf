"""Every operator against a plain version, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from carlake.llm import bpe, decontaminate, langid, quality, sharding, simhash, substrings, toxicity, urls, warc
from carlake.llm.components import components
from tests.llm import brute

DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, r string, fp string, label string"


def some_words(rng, n, letters="abcdefg"):
    return [" ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))][0].split()


def corpus():
    rng = random.Random(3)
    passage = " ".join(some_words(rng, 70))
    base = [" ".join(some_words(rng, rng.choice([0, 1, 2, 3, 8, 60, 120, 300]))) for _ in range(40)]
    texts = [*base, None, "", " \t\n", "one", "one two", "Ünï çödé 日本語 " * 20, "x" * 3000, "ha " * 200, "# * $ | " * 30]
    texts += [base[5] + " tail", base[6].upper(), base[7], base[7], base[7]]
    texts += [f"{some_words(rng, 5)} {passage} {some_words(rng, 9)}" for _ in range(6)]
    near = some_words(rng, 400)
    for k in range(12):
        changed = list(near)
        changed[k * 30] = f"new{k}"
        texts.append(" ".join(changed))
    texts += ["line one is here\n" * 9 + " ".join(some_words(rng, 80)), " ".join(some_words(rng, 4000))]
    rows = [(i * 3 % 101 + i // 101, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[50], (None, base[6]), (None, None)]  # repeated rows and rows without an id


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "k", "r", "f", "l") for d, t in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- quality ----------------------------------------------------------------------------------


def test_quality_counts_and_verdict(documents, rows, empty):
    found = got(quality.judge_quality(documents).select("doc_id", *"n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()))
    want = []
    for d, t in rows:
        n, chars, symbols, lines, repeated = brute.base_counts(t)
        failed = n < 50 or 100 * repeated > 50 * n
        look = quality.Text(t)
        want.append((d, n, chars, symbols, lines, repeated, failed, not failed and not any(r(look) for r in quality.RULES.values())))
    assert found == sorted(want, key=str)
    assert quality.judge_quality(empty).count() == 0


def test_cascade_order_is_by_rejections_per_second():
    measured = [("symbols", 2.0, 10), ("one_word", 1.0, 9), ("long_words", 0.1, 0)]
    order = quality.cascade_order(measured)
    assert order[:2] == ["one_word", "symbols"] and set(order) == set(quality.RULES)


def test_rules_are_measured_behind_the_base(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, good + " ###" * 90), (None, "too short ####"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hits = {name: n for name, _, n in quality.measure(df, sample_rows=10)}
    # the repeated symbols make the second text fail the base already: no rule is credited with it
    assert set(hits) == set(quality.RULES) and sum(hits.values()) == 0
    spread = good + " " + " ".join("#" * 3 + str(i) for i in range(90))
    assert {n: h for n, _, h in quality.measure(df.union(spark.createDataFrame([(5, spread)], df.schema)), sample_rows=10)}["symbols"] == 1


def test_verdict_does_not_depend_on_the_order(documents):
    names = list(quality.RULES)
    verdicts = [got(documents.select("doc_id", quality.cascade(F.col("text"), o)["kept"])) for o in (names, names[::-1])]
    assert verdicts[0] == verdicts[1]


def test_repeat_words_of_many_distinct_words():
    words = [b"%d" % i for i in range(2_000_010)] + [b"1", b"2", b"3"]
    assert quality.repeat_words(words) == 6


# --- decontamination --------------------------------------------------------------------------


def test_contained_items(spark, documents, rows, empty):
    items = [(i, t) for i, t in enumerate([rows[6][1], rows[9][1], "one two", "nothing of this is in any text at all", None, "", "... !"])]
    items += [(20, rows[6][1]), (21, " ".join(rows[30][1].split()[:20] if rows[30][1] else []) or "absent words here today now then")]
    words = rows[69][1].split()
    items += [(22, " ".join(words[100:150])), (23, " ".join([*words[5:45], *some_words(random.Random(1), 6)]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pairs = decontaminate.contaminated_pairs(documents, benchmark)
    want = brute.contained(rows, items)
    assert got(pairs.drop("containment")) == want and want
    assert got(decontaminate.contaminated_pairs(documents, benchmark, block_shingles=10).drop("containment")) == want
    dirty = {d for d, *_ in want}
    clean = decontaminate.clean_documents(documents, benchmark)
    assert clean.columns == documents.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _ in rows if d not in dirty or d is None and not brute.contained([(d, _)], items))
    assert decontaminate.contaminated_pairs(empty, benchmark).count() == 0
    assert decontaminate.contaminated_pairs(documents, benchmark.limit(0)).count() == 0


def test_sketch_never_misses_a_contained_item():
    for n in range(1, 200):
        assert decontaminate.sketch_size(n) > n - -(-n * 8 // 10)


# --- simhash ----------------------------------------------------------------------------------


def test_near_duplicates(documents, rows, empty):
    want = brute.near_components(rows)
    assert got(simhash.near_duplicates(documents)) == want
    assert got(simhash.near_duplicates(documents, list_rows=2)) == want  # every list is cut
    assert simhash.near_duplicates(empty).count() == 0


def test_every_three_positions_are_avoided_by_a_block():
    from itertools import combinations

    assert len(simhash.blocks()) == 14
    assert all(any(not set(b) & set(t) for b in simhash.blocks()) for t in combinations(range(8), 3))


def test_forest_joins_a_chain():
    fps = np.array([0, 1, 3, 7, 15, 31, 2**64 - 1], np.uint64)
    links = simhash.forest(fps)
    assert len(links) == 5 and not any(6 in pair for pair in links)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 90)], "a long, b long")
    found = dict(got(components(links)))
    assert found == {i: 0 for i in range(61)} | {90: 90, 100: 90}
    assert components(links.limit(0)).count() == 0


def test_keep_first_keeps_one_of_each_component(documents, rows):
    kept = simhash.keep_first(documents)
    assert kept.columns == documents.columns
    least = {c for _, _, c in brute.near_components(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(least) and ids.count(None) == 2


# --- toxicity ---------------------------------------------------------------------------------


def toxic_corpus():
    rng = random.Random(8)
    common = [" ".join(some_words(rng, 1, "etaoinshr")) for _ in range(400)]
    bad = ["zqvakkor", "wuxxplim", "jjorkbat"]
    rows = []
    for i in range(500):
        words = rng.choices(common, k=80)
        if i % 5 == 0:
            for _ in range(6):
                words[rng.randrange(80)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_on_held_out_documents(spark, empty):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(1000, None), (1001, ""), (None, "zqvakkor"), (5, rows[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows] + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == 504
    truth = {d: y for d, _, y in rows}
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in found if not r["predicted"])
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


# --- substrings -------------------------------------------------------------------------------


def test_removed_words(documents, rows, empty):
    assert got(substrings.repeat_digest(documents)) == brute.repeat_rows(rows)
    assert sum(r[2] for r in brute.repeat_rows(rows)) > 500
    assert substrings.repeat_digest(empty).count() == 0


def test_remove_repeats_changes_texts_only(documents, rows):
    made = substrings.remove_repeats(documents)
    assert made.columns == documents.columns
    want = []
    for (d, t), (_, w, kept) in zip(rows, brute.without_repeats(rows)):
        text = " ".join(kept) if len(kept) < len(w) else t
        want.append((d, text, None if text is None else len(text)))
    assert got(made.select("doc_id", "text", "n_chars")) == sorted(want, key=str)


def test_one_id_for_two_texts(spark):
    rng = random.Random(5)
    a, b = some_words(rng, 120), some_words(rng, 80)
    rows = [(5, " ".join(a)), (5, " ".join(b + a[:60])), (7, " ".join(a[20:90])), (2, " ".join(b[10:75])), (9, " ".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substrings.repeat_digest(df)) == brute.repeat_rows(rows)


def test_greedy_factors_cross_their_boundaries():
    places = np.array([0, 1, 2, 3, 4, 30, 31, 60, 140])
    references = np.array([7, 7, 7, 5, 5, 5, 5, 5, 5])
    spots = np.array([10, 11, 12, 90, 91, 117, 200, 300, 20])
    # the first factor ends at word 52; of the windows that cross that end the last opens the next factor
    want = [(0, 52, 7, 10), (31, 81, 5, 200), (60, 110, 5, 300), (140, 190, 5, 20)]
    assert substrings.factors(places, references, spots) == want
    words = [b"%d" % i for i in range(200)]
    assert substrings.left_over(words, want) == words[110:140] + words[190:]
    pieces = substrings.pieces_of(words, want)
    assert [p[:4] for p in pieces[:2]] == [(0, 52, 7, 10), (31, 50, 5, 200)] and pieces[1][4] == substrings.digest_of(words[31:81])
    assert [(p[0], p[1], p[3]) for p in pieces[2:]] == [(60, 20, 300), (80, 30, 320), (140, 44, 20), (184, 6, 64)]
    assert substrings.factors(places[:0], references[:0], spots[:0]) == []


def test_factors_name_their_reference(spark):
    rng = random.Random(8)
    a, b, c = some_words(rng, 300), some_words(rng, 90), some_words(rng, 40)
    texts = {4: a, 6: c + b + c, 8: c + a[100:260] + b[10:75] + c, 9: b[:49], 12: a[:60] + a[:60]}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    found = substrings.duplicate_factors(df).collect()
    for f in found:
        own, there = texts[f.doc_id], texts[f.reference]
        assert f.reference < f.doc_id and f.n_words >= substrings.WINDOW
        assert own[f.start : f.start + f.n_words] == there[f.reference_start : f.reference_start + f.n_words]
    spans = sorted((f.doc_id, f.start, f.n_words, f.reference, f.reference_start) for f in found)
    assert spans == [(8, 40, 160, 4, 100), (8, 200, 65, 6, 50), (12, 0, 60, 4, 0), (12, 60, 60, 4, 0)]
    assert got(substrings.repeat_digest(df)) == brute.repeat_rows([(d, " ".join(w)) for d, w in texts.items()])


def test_pieces_that_differ_from_their_reference_are_no_factors(spark):
    rng = random.Random(9)
    a, b = some_words(rng, 120), some_words(rng, 70)
    texts = spark.createDataFrame(
        [(1, 0, b"k1", " ".join(a)), (2, 0, b"k2", " ".join(a[:60] + b)), (3, 0, b"k3", " ".join(a))], "doc_id long, tag int, key binary, text string"
    )
    # windows as colliding hashes would give them: of document 2 every piece has words that document 1 lacks there
    claims = [(d, 0, [(p, 1, p) for p in range(n)]) for d, n in ((2, 81), (3, 71))]
    windows = spark.createDataFrame(claims, "doc_id long, tag int, windows array<struct<place: int, reference: bigint, there: bigint>>")
    parsed = texts.select("doc_id", "tag", "key", "text").join(windows, ["doc_id", "tag"]).mapInArrow(substrings._parse, substrings.PARSED)
    assert sorted((u.reference, u.spot, u.n) for u in substrings.unlike_references(parsed, texts).collect()) == [(1, 0, 64), (1, 64, 64), (1, 128, 2)]
    settled = {r.doc_id: r for r in substrings._settled(parsed, texts, windows).collect()}
    assert settled[3].n_removed == 120 and settled[2].n_removed == 0
    assert substrings.unlike_references(substrings._settled(parsed, texts, windows), texts).isEmpty()


# --- language ---------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark, empty):
    rng = random.Random(4)
    letters = {"aa": "abcdeé", "bb": "mnopqß", "cc": "stuvwx"}
    rows = [(i, " ".join(some_words(rng, rng.randint(3, 90), letters[k])), k) for i in range(300) for k in [rng.choice(list(letters))]]
    extra = [(900, None, "aa"), (901, "12 34 --", "bb"), (902, "", None), (903, "abc dé", None), (None, "abc", "aa"), rows[0]]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    found = langid.identify(docs).collect()
    assert len(found) == 306 and all(0 <= r["score"] <= 1 for r in found)
    truth = {d: k for d, _, k in rows}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    by_id = {r["doc_id"]: r["lang_pred"] for r in found}
    assert [by_id[i] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(empty).count() == 0


def test_gradients_of_the_network():
    model = langid.LanguageModel(["ab", "cd"], ["x", "y"], steps=0)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 3)), np.array([0, 1, 1])
    weights = [*model.sides[0].parameters(), *model.sides[1].parameters(), model.bias]
    for name in ("byte", "state", "out"):
        for side in model.sides:
            setattr(side, name, getattr(side, name).astype(np.float64))
    model.bias = model.bias.astype(np.float64)
    weights = [*model.sides[0].parameters(), *model.sides[1].parameters(), model.bias]

    def loss():
        (hf, _), (hb, _) = model.sides[0].run(x), model.sides[1].run(x[::-1])
        logits = model.sides[0].out @ hf + model.sides[1].out @ hb[::-1] + model.bias
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        return -np.log(p[:, y, np.arange(3)]).mean()

    for w, g in zip(weights, model._gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = w[at], 1e-3
        w[at] = before + step
        up = loss()
        w[at] = before - step
        down = loss()
        w[at] = before
        assert abs((up - down) / (2 * step) - g[at]) < 2e-3 * max(1, abs(g[at]))


# --- URLs -------------------------------------------------------------------------------------

URLS = {
    "https://A.Example.NET/en/1?x=1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "http://x.net/de": ("x.net", "/de", "net/", "block"),
    "http://x.net": ("x.net", "", None, None),
    "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
    "http://notexample.com/de/1": ("notexample.com", "/de/1", None, None),
    "http://w.org/fr/a#b?c": ("w.org", "/fr/a", "org/fr/", "allow"),
    "http://w.org/FR/a": ("w.org", "/FR/a", None, None),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "a://b?c://d/e": ("b", "", None, None),
    "s://h.net/p\nq?r": ("h.net", "/p\nq", "net/", "block"),
}


def test_url_rules(spark, empty):
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(URLS)] + [(1, "http://x.net/de", 0), (None, "http://x.net/", 0)], "page_id long, url string, rule int")
    found = urls.judge_urls(pages).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        if r["page_id"] is None:
            continue
        host, path, rule, verdict = list(URLS.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_trees_learn_lexical_features():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = urls.Trees(x[:1500], y[:1500])
    assert np.mean((model.score(x[1500:]) >= 0.5) == y[1500:]) > 0.95


# --- byte-level BPE ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks_path():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_tokens_equal_the_library(documents, rows, ranks_path, empty):
    found = got(bpe.token_digest(documents, ranks_path, public_tokenizers.PATTERN))
    ranks = bpe.Vocabulary(open(ranks_path, "rb").read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), sha256(ids.tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)
    assert bpe.token_digest(empty, ranks_path, public_tokenizers.PATTERN).count() == 0


def test_long_texts_and_forgotten_pieces(ranks_path, monkeypatch):
    import regex

    v = bpe.Vocabulary(open(ranks_path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 5)
    monkeypatch.setattr(bpe, "PART_CHARS", 40)
    monkeypatch.setattr(bpe, "PART_PIECES", 3)
    texts = ["antidisestablishmentarianism " * 5, "short", None, "ñandú über 12345 ...\n\n  end", "z" * 200 + "é" * 90, "don't  stop"]
    found = bpe.encode_texts(texts, v, regex.compile(public_tokenizers.PATTERN))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library.encode_ordinary(t or "") for t in texts]


# --- shards -----------------------------------------------------------------------------------


def test_shards(documents, rows, empty):
    found = sharding.shard_digest(documents, 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(7)) and {len(s) for s in slots.values()} <= {len(rows) // 7, len(rows) // 7 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    assert sharding.shard_digest(empty).count() == 0


def test_shards_keep_records_and_repeat_by_seed(documents):
    once, again, other = (sharding.shard_documents(documents, 5, seed=s) for s in (1, 1, 2))
    assert once.select("record.*").columns == documents.columns
    assert got(once.select("record.*")) == got(documents)
    place = lambda df: got(df.select("shard", "slot", "record.doc_id"))
    assert place(once) == place(again) != place(other)


# --- archives ---------------------------------------------------------------------------------


def html_rows():
    big, same = "<p>é\r\n\r\n</p>" * 9000, "s" * 100
    return [
        (1, "http://a/", "<html>"), (2, None, None), (3, "http://b/\r\nx", big), (9, "u", same), (4, "u", same), (7, "u", same),
        (5, "u", "t" * 99), (6, "u", "t" * 99), (None, "u", same), (8, "", ""), (3, "http://b/\r\nx", big), (10, "u", "WARC/1.1\r\n" * 30),
    ]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in html_rows()], "page_id long, url string, html string, payload string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "a"), segment_bytes=1000, archive_records=50)
    found = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(r["complete"] for r in found) and len(found) == len(html_rows())
    want = []
    for p, _, h in html_rows():
        data = (h or "").encode()
        later = h == "s" * 100 and p != 4
        want.append((p, len(data), sha256(data).hexdigest(), "revisit" if later else "response", 4 if later else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_damaged_segments_are_told(spark):
    page = {"page_id": 1, "row": 0, "url": "u", "record_type": "response", "payload": b"y" * 5000, "payload_bytes": 5000, "payload_digest": "d", "refers_to": None}
    records = list(warc.records_of(page, 1000))
    assert len(records) == 6 and b"WARC-Segment-Total-Length" in records[-1]
    for lost in range(6):
        block = b"".join(r.split(b"\r\n\r\n", 1)[1] for i, r in enumerate(records) if i != lost)
        payload, _ = warc.payload_of(block)
        assert payload != page["payload"]
    assert warc.unchunked(warc.chunked(b"abc" * 9, 4)) == b"abc" * 9
    assert warc.unchunked(b"5;ext=1\r\nhello\r\n0\r\n\r\n") == b"hello"
    assert warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"") is None
