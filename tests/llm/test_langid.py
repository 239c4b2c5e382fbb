from pyspark.sql import functions as F

from tessera.llm import langid

EN = "the cat and the dog with another thing that was over there"
FR = "le chat et une autre chose que nous avions dans les maisons"
SCHEMA = "doc_id long, text string, lang string, score string, words string"


def corpus(spark):
    rows = [(i, " ".join((EN if i % 2 else FR).split()[i % 5 :] * 3), "en" if i % 2 else "fr", "x", "y") for i in range(200)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !!! ½²", "fr"), (1003, EN * 5000, None), (1004, "x" * 100_000, None), (1005, f"{EN}. {FR}. {FR}", "en"), (1, EN, "en"), (None, FR, "fr")]
    return spark.createDataFrame(rows + [(*r, "x", "y") for r in odd], SCHEMA)


def test_predict_all(spark):
    got = {r.doc_id: r for r in langid.predict_all(corpus(spark)).collect()}
    assert langid.predict_all(corpus(spark)).count() == 208
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(200))
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1005, None)] == ["und", "und", "und", "en", "fr", "fr"]
    assert got[1000].score == 0 and all(0 <= r.score <= 1 for r in got.values()) and 0.5 < got[1005].score < 0.9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values() if r.doc_id is not None)


def test_words_are_labelled_in_code_switched_text(spark):
    docs = corpus(spark)
    rows = langid.words_table(docs.filter("doc_id = 1005"), langid.fit(docs)).orderBy("n").collect()
    assert [r.word for r in rows] == f"{EN} {FR} {FR}".split()
    assert [r.label for r in rows] == ["en"] * len(EN.split()) + ["fr"] * 2 * len(FR.split())


def test_no_rows_and_no_languages(spark):
    docs = corpus(spark)
    assert langid.predict_all(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.predict_all(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_features_do_not_depend_on_the_batch():
    words = ["a", "ab", "abc", "été", "x" * 1000, "漢字", "abc"]
    together = {w: f[j].tolist() for part, f in langid.word_features(words) for j, w in enumerate(words[i] for i in part)}
    for w in words:
        (_, f), = langid.word_features([w])
        assert f[0].tolist() == together[w]
