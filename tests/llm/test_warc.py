import hashlib

import pytest

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, offset long"
LONG = "<p>é same</p>" * 20
ROWS = [(5, "http://a/", LONG), (3, "http://b/\r\nX: y%0A", LONG), (9, None, LONG), (4, "u", None), (6, "u", ""), (7, "u", "tiny"), (8, "u", "tiny"), (10, "u", "z" * 500_000), (None, "n", LONG), (11, "u", "\r\n\r\n" + LONG), (3, "http://b/", LONG)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, u, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and i != first[h or ""]
        yield (i, u, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h or ""] if revisit else None)


key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_ROWS, 0])
def test_archive(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    index = warc.write_archives(spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(3))
    got = warc.read_records(index).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(expected(ROWS), key=key)
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    some = warc.read_records(index.filter("page_id in (10, 11)")).collect()
    assert sorted(r.page_id for r in some) == [10, 11]


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bad_records():
    for bad in (b"x", warc.record(1, "u", b"abc", "d", None, False)[:-9]):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_wrong_index(spark):
    index = warc.write_archives(spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA))
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="not the indexed record"):
        warc.read_records(index.withColumn("digest", F.lit("0" * 64))).collect()
