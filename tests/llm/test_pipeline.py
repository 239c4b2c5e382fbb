import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

GOOD = "The cat sat on the mat and looked at the sea. It was late when they came home with {}."
BAD = "BUY!! NOW!! CHEAP!! {}!! WATCHES!!"


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    text = lambda form: "\n".join(form.format(" ".join(word() for _ in range(12)).upper() if "!!" in form else " ".join(word() for _ in range(12))) for _ in range(4))
    docs = [(i, text(BAD if i % 4 == 0 else GOOD)) for i in range(120)]
    docs += [(200, docs[1][1]), (201, docs[1][1].replace("late", "early")), (202, None), (203, "12345 !!!"), (204, docs[2][1] + " mail joe.doe@mail.example.com")]
    return docs


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = rows()
    sf = str(tmp_path / "sf")
    df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    at, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, at, sf).write.parquet(out)
        at = spark.read.parquet(out)
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
        if k < 4:
            assert at.columns == df.columns
    good = {i for i in range(120) if i % 4}
    assert kept[0] == {i for i, _ in docs} - {202, 203}
    assert kept[1] == good | {200, 201, 204}
    assert kept[2] == good  # copies of 1, and 204 which only adds to 2
    assert kept[3] == kept[2] and kept[4] == kept[2]
    assert spark.read.parquet(str(tmp_path / "4")).agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_run_covers_all_stages(spark):
    got = cp.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100
