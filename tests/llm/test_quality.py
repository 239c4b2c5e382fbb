import random
import zlib

import numpy as np

from tessera.llm import quality as q

GOOD = ["The cat sat on the mat and looked at the sea.", "Another line of prose follows, with some words in it.", "It was late when they came home."]
BAD = ["BUY!! NOW!! CHEAP!! WATCHES!!", "home | about | news | login | more", "spam spam spam spam spam spam"]
SCHEMA = "doc_id long, text string, score string, quality string"


def tables(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(300):
        y = int(i % 3 > 0)
        rows.append((i, "\n".join(rng.choice(GOOD if y else BAD) for _ in range(rng.randint(1, 6))), "x", "y"))
        labels.append((i, y, 0))
    rows += [(900, None, "x", "y"), (901, "", "x", "y"), (902, "\n".join(GOOD * 20_000), "x", "y"), (903, "\n\n\n", "x", "y"), (904, "a" * 300_000, "x", "y"), (1, rows[1][1], "x", "y"), (None, GOOD[0], "x", "y")]
    labels += [(901, None, 0), (5000, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = tables(spark)
    got = q.score_all(docs, labels).collect()
    assert len(got) == 307 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held) and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and by[902] > 0.9


def test_lines_of_a_mixed_document(spark):
    docs, labels = tables(spark)
    model = q.fit(docs, labels)
    mixed = spark.createDataFrame([(1, "\n".join(GOOD * 3 + BAD * 3), "x", "y")], SCHEMA)
    rows = q.lines_table(mixed, model).orderBy("n").collect()
    assert [r.size for r in rows] == [len(x) for x in GOOD * 3 + BAD * 3]
    assert [r.good > 0.5 for r in rows] == [True] * 9 + [False] * 9


def test_features_do_not_depend_on_neighbouring_texts():
    texts = [b"", b"One line.", b"A A A\n\nb | c\n" + "é!!".encode() * 50, b"x" * 999, b"\n\n"]
    x, size, lines = q.line_features(texts)
    parts = [q.line_features([t]) for t in texts]
    assert np.allclose(x, np.concatenate([p[0] for p in parts])) and lines.tolist() == [1, 1, 4, 1, 3]
    assert size.tolist() == np.concatenate([p[1] for p in parts]).tolist()


def test_empty_tables_and_one_label(spark):
    docs, labels = tables(spark)
    assert q.score_all(docs.limit(0), labels).collect() == []
    assert {round(r.score, 6) for r in q.score_all(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.predicted == 1 for r in q.score_all(docs, labels.filter("quality = 1")).collect())
