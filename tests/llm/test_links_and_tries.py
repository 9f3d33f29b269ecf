"""Spelling variants, the Jaccard join, the conversation trie, shards and URL trees against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from carlake.llm import jaccard, sharding, spelling, trie, urls
from carlake.session import new_path

DDL = "doc_id long, text string, word string, n long, node long, key string, label string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "w", 1, 2, "k", "l") for d, t in rows], DDL).repartition(parts)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- spelling ---------------------------------------------------------------------------------


def variants(rng, n=40):
    base = ["".join(rng.choices("abcdeéÿ", k=rng.randint(4, 9))) for _ in range(n)]
    out = []
    for w in base:
        out += [w] * rng.choice([1, 3, 9, 20])
        for _ in range(6):
            at, c = rng.randrange(len(w)), rng.choice("abcdeéÿ")
            out += [rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])] * rng.choice([1, 3, 4])
    rng.shuffle(out)
    return out


def spelled_rows():
    rng = random.Random(5)
    words = variants(rng)
    rows = [(i, " ".join(words[i::30])) for i in range(30)]
    rows += [(30, None), (31, ""), (32, "1 2 3 ... \t\n"), (None, "ABCDE abcde Abcde É é"), (7, rows[7][1]), (7, "other words " * 40)]
    return [*rows, (40, "longlonglong " * 3000 + "x" * 5000)]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_spelling(rows):
    total = Counter()
    for d, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    vocab = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    around = {w: [v for v in vocab if near(w, v)] for w in vocab}
    form = {}
    for w, vs in around.items():
        if vs and vocab[best := min(vs, key=lambda v: (-vocab[v], v))] >= 2 * vocab[w]:
            form[w] = best
    out = []
    for w, n in vocab.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(around[w]), form.get(w), vocab.get(form.get(w)), root))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4096, 7])
def test_spelling_groups(spark, block):
    rows = spelled_rows()
    want = plain_spelling(rows)
    assert got(spelling.spelling_groups(table(spark, rows), spelling.planted_typos, block=block)) == want
    assert any(w[2] > 3 for w in want) and any(w[3] and w[5] != w[3] for w in want)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(table(spark, []).where("false")).count() == 0
    assert spelling.spelling_groups(table(spark, [(1, None), (2, "one two")])).count() == 0


def test_counts_handed_on_early_and_long_texts_are_whole(spark, monkeypatch):
    rows = spelled_rows()
    monkeypatch.setattr(spelling, "COUNTED", 3)
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    batch = table(spark, rows)
    assert got(spelling.spelling_groups(batch, spelling.planted_typos)) == plain_spelling(rows)


def test_sliced_index_finds_each_pair_once():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(5, 8))) for _ in range(150)})
    seen = Counter()
    for b in range(5, 9):
        for is_head in (True, False):
            groups = defaultdict(list)
            for w in words:
                if len(w) in (b, b + 1):
                    groups[w[: b // 2] if is_head else w[len(w) - (b - b // 2) :]].append((w, rng.randint(1, 9)))
            for group in groups.values():
                index = spelling.SlicedIndex(group)
                for w, _ in group:
                    found = index.near(w, b, 0 if is_head else b // 2)
                    seen.update((w, index.members[i][0]) for i in range(len(group)) if found >> i & 1)
    assert set(seen) == {(a, b) for a in words for b in words if near(a, b)} and set(seen.values()) == {1}


# --- Jaccard ----------------------------------------------------------------------------------


def near_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [None, "", " \n", "one", "one two", "ONE two", "one two three", "Öne two", "ha " * 50]
    for size in (12, 40, 150, 600):
        base = [word() for _ in range(size)]
        texts += [" ".join(base)] * 3
        for k in range(14):
            changed = list(base)
            for _ in range(rng.randint(0, max(1, size // 45))):
                changed[rng.randrange(size)] = word()
            texts.append(" ".join(changed if k % 3 else changed[rng.randint(0, size // 25) :]))
    chain = [word() for _ in range(300)]
    for k in range(10):  # neighbours link, ends do not
        chain = chain[9:] + [word() for _ in range(9)]
        texts.append(" ".join(chain))
    texts.append(" ".join(word() for _ in range(6000)))
    rows = [(i * 7 % 97 + 97 * (i // 97), t) for i, t in enumerate(texts)]
    return [*rows, rows[12], (None, texts[12]), (None, None), (None, texts[60])]


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def plain_jaccard(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                old, new = group[i], group[k]
                group = [new if g == old else g for g in group]
    least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, group)), key=str)


@pytest.mark.parametrize("list_rows", [2048, 3])
def test_jaccard_components(spark, list_rows):
    rows = near_texts()
    want = plain_jaccard(rows)
    assert got(jaccard.jaccard_components(table(spark, rows), list_rows=list_rows)) == want
    assert len({c for _, _, c in want}) < len({d for d, _, _ in want}) - 20


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(table(spark, []).where("false")).count() == 0


def test_failed_links_are_searched_again(spark, monkeypatch):
    """With sketches that let every pair pass, forests are wrong and all links come from the second search."""
    monkeypatch.setattr(jaccard.List, "near", lambda self, at, others: others)
    rows = [r for r in near_texts() if r[1] is None or len(r[1]) < 2000]
    documents = table(spark, rows)
    prints = documents.select("doc_id", "text").mapInArrow(jaccard._prints(3, 90), jaccard.PRINTS).toPandas()
    assert len(prints) == len(rows)
    lists = [jaccard.List.__new__(jaccard.List)]
    lists[0].nodes, lists[0].labels = np.arange(4), np.array([0, 0, 2, 3])
    assert lists[0].unjoined() == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert len(lists[0].forest()) == 3


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_always_share_a_key(percent):
    rng = np.random.default_rng(1)
    for n in [2, 5, 9, 10, 11, 19, 20, 30, 47, 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, n // 10) + 1)
            add = rng.integers(0, max(1, n // 10) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if drop + add and 100 * shared >= percent * (len(a) + len(b) - shared):
                keys = [np.concatenate([jaccard.block_keys(s, j, percent) for j in jaccard.bands_of(len(s), percent)]) for s in (a, b)]
                assert np.intersect1d(*keys).size
                assert len(a) + len(b) - 2 * shared <= jaccard.most_apart(len(a) + len(b), percent)
                for j in set(jaccard.bands_of(len(a), percent)) & set(jaccard.bands_of(len(b), percent)):
                    x, y = (np.frombuffer(jaccard.parity_sketch(s, j, percent), np.uint8) for s in (a, b))
                    assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * shared


# --- trie -------------------------------------------------------------------------------------


def turns():
    rng = random.Random(4)
    said = ["yes", "no", "", "what é", "well now"]
    rows = []
    for c in [0, 1, 2, 5, 17, 60, 99, 100, 101, 150, 199, 205, 333, -3, -200, -150]:
        for k in range(rng.choice([1, 2, 3, 5, 7])):
            rows.append((c, k, rng.choice(["user", "assistant"]), rng.choice(said[:2])))
    rows += [(400, k, "user", "yes") for k in range(150)] + [(c, k, "user", "yes") for c in (401, 402, 403) for k in range(140)]
    rows += [(500, None, None, "first"), (500, 1, "b", None), (500, 1, "a", "z"), (500, 1, "a", "z"), (None, 1, "user", "lost")]
    return rows


def plain_trie(rows, borrow):
    own = defaultdict(list)
    for c, k, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            own[c].append((role or "", text or ""))
    seqs = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        first = c - int(np.fmod(c, 100))
        seqs[c] = [*own.get(first, [])[:h], *seq[h:]] if borrow else seq
    nodes = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in below)
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), up, len(members), len(kids), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [(*r, 1, "x", 0) for r in turns()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long, h1 string, n long").repartition(5)


def test_trie_of_conversations(conversations):
    assert got(trie.conversation_trie(conversations)) == plain_trie(turns(), False)


def test_trie_of_borrowed_beginnings(spark, conversations):
    want = plain_trie(turns(), True)
    assert got(trie.borrowed_trie(conversations)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # many blocks, and intervals that they cut
    try:
        assert got(trie.borrowed_trie(conversations)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_of_nothing(conversations):
    assert trie.borrowed_trie(conversations.where("false")).count() == 0
    assert trie.borrowed_trie(conversations.where("conv_id is null")).count() == 0


def test_a_conversation_that_becomes_empty(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = spark.createDataFrame([(lone, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert got(trie.borrowed_trie(rows)) == [(lone, 0, None, 1, 0, 1, 0, sha256(str(lone).encode()).hexdigest())]


def test_extents_by_range_minima():
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 8, 50]:
        lcp = rng.integers(0, 4, n)
        lcp[0] = 0
        table = trie.RangeTable(lcp)
        for i in range(n):
            for depth in range(1, 5):
                at, d = np.array([i]), np.array([depth])
                left = i
                while left and lcp[left] >= depth:
                    left -= 1
                right = i
                while right + 1 < n and lcp[right + 1] >= depth:
                    right += 1
                assert trie.left_extent(table, at, d)[0] == left and trie.right_extent(table, at, d)[0] == right
                assert table.least(np.array([left]), np.array([right]))[0] == lcp[left : right + 1].min()


# --- shards -----------------------------------------------------------------------------------


def test_shards_are_runs_of_one_permutation(spark):
    rng = random.Random(8)
    rows = [(rng.choice([i, 7, None]), rng.choice([None, "", "é" * rng.randint(0, 40), "same"])) for i in range(500)]
    found = sharding.shard_digest(table(spark, rows)).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and {len(s) for s in slots.values()} <= {500 // 24, 500 // 24 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rows_that_repeat_fill_no_bucket(spark):
    rows = [(1, "copy of one text")] * 3000 + [(i, f"text {i}") for i in range(1000)]
    paths = [new_path(spark, "shards") for _ in range(2)]
    for parts, path in zip((3, 7), paths):
        sharding.scatter_and_shuffle(table(spark, rows, parts), path, bucket_bytes=1 << 10)
    written = [spark.read.parquet(p) for p in paths]
    assert written[0].groupBy("bucket").count().agg(F.max("count")).first()[0] < 200
    assert Counter((r.record.doc_id, r.record.text) for r in written[0].collect()) == Counter(rows)
    # the same places whatever the splits of the input
    places = [sorted((r.bucket, r.place, r.record.doc_id) for r in w.collect()) for w in written]
    assert places[0] == places[1]


def test_records_move_once(spark):
    path = new_path(spark, "shards")
    sharding.scatter_and_shuffle(table(spark, [(i, "x") for i in range(50)]), path)
    plan = sharding.read_shards(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    lines = [x for x in plan.split("\n") if "Exchange" in x and "record" in x]
    assert not lines
    assert sharding.shard_documents(table(spark, [])).count() == 0


# --- URL trees ----------------------------------------------------------------------------------


def test_trees_are_worth_something_on_hosts_they_have_not_seen(spark):
    """Blocked sites have long queries and many digits; whole hosts are left out of the fit."""
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        bad = i % 2
        host = f"h{rng.randrange(40)}.{'ads' if bad else 'news'}.test"
        tail = "?" + "&".join(f"p{k}={rng.randrange(10**6)}" for k in range(rng.randint(2, 5))) if bad else ""
        rows.append((i, f"https://{host}/{'x/' * rng.randint(0, 3)}{rng.choice(['page', 'story'])}{tail}"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("ads.test", "/", "block"), ("news.test", "/", "allow")]
    accuracy, commoner = urls.held_out_accuracy(pages, rules)
    assert accuracy > 0.95 and commoner < 0.55
    judged = urls.judge_urls(pages.union(spark.createDataFrame([(9000, "https://new.site/page"), (9001, "https://new.site/page?p0=123456&p1=654321&p2=999")], "page_id long, url string")), rules)
    assert [r.verdict for r in judged.where("page_id >= 9000").orderBy("page_id").collect()] == ["allow", "block"]
    assert judged.where("rule is not null and score is not null").count() == 0


def test_no_label_of_a_host_enters_its_own_features():
    rows = [([1.0], "a.b.c.test", 1)] * 5 + [([1.0], "z.b.c.test", 0)] * 3 + [([2.0], "q.test", 0)]
    model = urls.UrlModel(rows)
    average = 5 / 9
    assert model.rate("a.b.c.test") == (0 + urls.PRIOR * average) / (3 + urls.PRIOR)
    assert model.rate("z.b.c.test") == (5 + urls.PRIOR * average) / (5 + urls.PRIOR)
    assert model.rate("new.b.c.test") == (5 + urls.PRIOR * average) / (8 + urls.PRIOR)
    assert model.rate("other.org") == pytest.approx(average)


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (80, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(80) < 0.2)).astype(float)
    trees = urls.Trees(x, y, trees=1, depth=1)
    feature, cut, _ = trees.trees[0][0]
    g, h = y - y.mean(), np.full(80, y.mean() * (1 - y.mean()))

    def gain(f, at):
        left = x[:, f] <= at
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))

    best = max(gain(f, at) for f in range(3) for at in trees.cuts[f])
    assert gain(feature, trees.cuts[feature][cut]) == pytest.approx(best)
