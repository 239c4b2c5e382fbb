import hashlib
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup as nd
from tessera.llm.common import shared_dir

SCHEMA = "doc_id long, text string, class_id string, cls string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_banded_distance(seed):
    rng = random.Random(seed)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
        b = a[:]
        for _ in range(rng.randint(0, 20)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 2)] = [rng.choice("abcd")] * rng.randint(0, 2)
        d = levenshtein(a, b)
        for most in (0, 1, 3, 10, 100):
            assert nd.edit_distance(a, b, most) == (d if d <= most else None)


def test_sketch_keeps_order_and_occurrences():
    a, b = b"one two three four five six seven " * 9, b"seven six five four three two one " * 9
    ka, kb = nd.sketch([a, b])[0]
    assert not set(ka.tolist()) & set(kb.tolist())
    alone = nd.sketch([a])[0][0]
    assert alone.tolist() == ka.tolist()
    keys, n, hist = nd.sketch([b"", b"  \n ", b"x", b"x y", b"w " * 500])
    assert n.tolist() == [0, 0, 1, 2, 500] and hist[4].max() == 255 and all(len(k) for k in keys)


def corpus(seed=0):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 200, 900]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = base[:]
            for _ in range(int(len(t) * rng.choice([0, 0.03, 0.1]) + 0.5)):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [rng.choice(words)], [t[i], rng.choice(words)]])
            texts.append(" ".join(t))
    texts += [passage + "\n" + " ".join(rng.choice(words) for _ in range(200)) for _ in range(40)]
    texts += [None, "", "", "!", "hi", "hi", "word " * 4000, "word " * 4001]
    return [(i, t) for i, t in enumerate(texts)]


def brute(rows):
    """Classes by comparing all texts."""
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and nd.similar(a or "", b or "") and ((a or "").split() or not (b or "").split() and (a or "") == (b or "")):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def test_classes_match_all_pairs(spark):
    rows = corpus()
    got = nd.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows) and len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.class_id].add(dict(rows)[r.doc_id] or "")
    assert all((r.n_links > 0) == (len(by[r.class_id]) > 1) for r in got)
    count = defaultdict(int)
    for _, t in rows:
        count[t or ""] += 1
    assert all(r.n_copies == count[dict(rows)[r.doc_id] or ""] for r in got)


def test_odd_tables(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f g h i j", "x", "y"), (1, "a b c d e f g h i j", "x", "y"), (None, "a b c d e f g h i j", "x", "y"), (1, "other text with nothing in common at all", "x", "y"), (None, "a lone text whose id is null and long enough", "x", "y")]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.class_id or 0, r.n_copies) for r in got) == [(False, 1, 1, 1), (False, 1, 1, 3), (False, 1, 1, 3), (True, 0, 0, 1), (True, 0, 1, 3)]


def test_keys_and_texts_travel_once(spark, monkeypatch):
    """One shuffle finds the buckets of more than one class, none the texts, unless rows repeat; a text comes once then too."""
    made, written = {}, nd.written
    monkeypatch.setattr(nd, "written", lambda df, what: made.update({what: (df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"), got := written(df, what), got.collect())}) or got)
    rows = [(i, " ".join(f"w{(i // 3) * 50 + j + (i % 3 == j)}" for j in range(30))) for i in range(12)] + [(None, "a b c d"), (None, "a b c d e"), (99, "alone " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once = sorted(map(tuple, nd.near_duplicates(df).collect()), key=str)
    assert made["buckets"][0] == 1 and made["texts"][0] == 0 and "texts-once" not in made
    keys = defaultdict(set)
    for r in made["classes"][2]:
        for place, key in enumerate(r["keys"]):
            if key:
                keys[key].add((bytes(r.cls), place))
    want = {(key, cls, place, len(of)) for key, of in keys.items() if len(of) > 1 for cls, place in of}
    assert len(want) > 20 and {(r.key, bytes(r.cls), r.place, r.n) for r in made["buckets"][2]} == want and len(made["buckets"][2]) == len(want)
    twice = nd.near_duplicates(df.unionByName(df)).collect()
    assert sorted(map(tuple, twice), key=str) == sorted([(*r[:3], 2 * r[3]) for r in once for _ in range(2)], key=str)
    assert sorted(r.text for r in made["texts-once"][2]) == sorted({t for _, t in rows if "alone" not in t})


def test_disk_is_freed_on_the_way(spark, monkeypatch):
    """Shuffle files go with the write that made them, tables with their last reader; the session's setting stays."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")
    root, left, written = shared_dir(spark).removeprefix("file://"), [], nd.written

    def watched(df, what):
        before, setting = files(), spark.conf.get(nd._FREE)
        got = written(df, what)
        left.append((what, files() - before))
        assert spark.conf.get(nd._FREE) == setting
        return got

    monkeypatch.setattr(nd, "written", watched)
    there = set(os.listdir(root))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in corpus()], SCHEMA).repartition(3)
    got = nd.near_duplicates(docs)
    kept = {x.rpartition("-")[0] for x in set(os.listdir(root)) - there}
    assert len(left) > 12 and max(n for _, n in left) <= 0, left
    assert kept <= {"members", "info", "link-counts", "small-star"}
    assert got.count() == len(corpus())


@pytest.mark.parametrize("seed", range(3))
def test_buckets_of_the_same_classes_meet_once(spark, seed):
    """Of buckets of the same classes the first stays, so every pair keeps the bucket of its first common key."""
    rng = random.Random(seed)
    keys = {i: [rng.choice([0, 0, 10 * place + rng.randrange(1, 4)]) for place in range(8)] for i in range(12)}
    keys |= {i: [1000 * (i // 2) + place for place in range(1, 9)] for i in range(20, 26)}
    one = spark.createDataFrame([(bytes([i]) * 16, k) for i, k in keys.items()], "cls binary, keys array<long>").repartition(3)
    of = defaultdict(set)
    for i, k in keys.items():
        for place, key in enumerate(k):
            if key:
                of[place, key].add(i)
    want = {}
    for (place, key), some in sorted(of.items()):
        if len(some) > 1:
            want.setdefault(frozenset(some), (place, key))
    got = nd._first_of_same(nd._shared(one)).collect()
    assert sorted((r.place, r.key, r.cls[0], r.n) for r in got) == sorted((place, key, i, len(some)) for some, (place, key) in want.items() for i in some)
    assert len(want) < sum(len(some) > 1 for some in of.values())


def test_one_row_of_each_class_stays(spark):
    rows = [(5, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (4, "a b c d e f g h i k"), (3, "z z y"), (9, None), (8, ""), (None, "q"), (None, "q")]
    got = nd.deduplicated(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "text", "class_id", "cls"]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "q"), (3, "a b c d e f g h i j"), (3, "z z y"), (8, "")]


def test_a_chain_of_links(spark):
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 60]), "x", "y") for i in range(40)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([r[:2] for r in rows]) and set(got.values()) == {0}


@pytest.mark.parametrize("chunk", [512, 5])
def test_a_pair_behind_unlike_texts_of_its_bucket(spark, monkeypatch, chunk):
    """One bucket whose least classes are like nothing, with a similar pair behind them and no other link anywhere."""
    monkeypatch.setattr(nd, "CHUNK", chunk, raising=False)
    rng = random.Random(4)
    text = lambda n: " ".join("u%d" % rng.randrange(10**6) for _ in range(n))
    texts = sorted((text(100) for _ in range(23)), key=lambda t: hashlib.sha256(t.encode()).digest())
    pair = text(100)
    pair = [pair + " " + text(1) for _ in range(200)]
    pair = [t for t in pair if hashlib.sha256(t.encode()).digest() > hashlib.sha256(texts[2].encode()).digest()][:2]
    texts += pair
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    one, _ = nd.classes(docs)
    one = one.withColumn("keys", F.array(F.lit(5).cast("long")))  # one key for all
    monkeypatch.setattr(nd, "classes", lambda d: (one, docs.select("id", nd._class_of(F.col("text")).alias("cls"))))
    got = {r.doc_id: r for r in nd.near_duplicates(docs, "id").collect()}
    assert got[24].class_id == got[23].class_id == 23 and all(got[i].class_id == i for i in range(23))


def near_copies(rng, words, base, count):
    """Texts that each differ from the base in a few words."""
    out = []
    for _ in range(count):
        t = base[:]
        for _ in range(max(1, len(t) // 25)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("chunk, tile", [(512, 32), (3, 2)])
def test_links_match_all_candidates(spark, monkeypatch, chunk, tile):
    monkeypatch.setattr(nd, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(nd, "TILE", tile, raising=False)
    rng = random.Random(7)
    words = ["w%d" % i for i in range(2000)]
    texts = [t for n in (15, 80, 300) for t in near_copies(rng, words, [rng.choice(words) for _ in range(n)], 14)]
    texts += texts[:5] + [None, "", "!"]
    got = nd.near_duplicates(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)).collect()
    distinct = sorted({t or "" for t in texts})
    keys = [set(k.tolist()) for k in nd.sketch([t.encode() for t in distinct])[0]]
    want = {a: sum(x != y and bool(keys[x] & keys[y]) and nd.similar(a, b) for y, b in enumerate(distinct)) for x, a in enumerate(distinct)}
    assert max(want.values()) > 5
    assert [want[texts[r.doc_id] or ""] for r in got] == [r.n_links for r in got]
