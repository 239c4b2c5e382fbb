import pytest

from tessera.llm import urlfilter as u

EVENTS = [("a", "host", "example.com", "add", 10), ("a", "host", "example.com", "remove", 20), ("a", "host", "example.com", "add", 30), ("b", "host", "m.example.com", "add", 15), ("b", "host", "m.example.com", "add", 18), ("c", "path", "x.org/bad", "add", 5), ("c", "path", "x.org/bad/worse", "add", 6), ("d", "host", "same.net", "add", 7), ("d", "host", "same.net", "remove", 7), ("a", None, "example.com", "add", 1), ("a", "host", None, "add", 1), ("e", "host", "org", "add", 50)]
CAPTURES = [(1, "https://m.example.com/p", 12), (2, "https://M.Example.com:80/p?q", 20), (3, "http://u@example.com", 31), (4, "http://x.org/bad/worse/z", 6), (5, "http://x.org/badness", 9), (6, "http://x.org/bad?x=/a", 60), (7, None, 12), (8, "no url", 12), (9, "http://example.com/", None), (10, "http://same.net/", 8), (1, "https://m.example.com/p", 12), (None, "https://m.example.com/p", 12), (11, "http://notexample.com/" + "a/" * 5000, 12), (12, "", 1), (13, "https://m.example.com/p", 9), (14, "https://m.example.com/p", 10)]
SCHEMA = "page_id long, url string, fetched long, lists string, salt string, key string"


def slow(url, t):
    """Hits of one capture by looking at all events."""
    import re

    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
    hits = []
    if not m or not m[1] or t is None:
        return hits
    host, path = m[1].lower(), m[1].lower() + "/" + "/".join(x for x in m[2].split("/") if x) + "/"
    for entry in sorted({e[:3] for e in EVENTS if None not in e}):
        past = sorted((e[4], e[3]) for e in EVENTS if e[:3] == entry and e[4] <= t)
        if past and past[-1][1] == "add":
            _, kind, key = entry
            if (kind == "host" and ("." + host).endswith("." + key)) or (kind == "path" and path.startswith(key + "/")):
                hits.append(entry[0])
    return hits


@pytest.mark.parametrize("broadcast", [u.BROADCAST_ROWS, 0])
def test_against_all_events(spark, monkeypatch, broadcast):
    monkeypatch.setattr(u, "BROADCAST_ROWS", broadcast)
    events = spark.createDataFrame(EVENTS, "list string, kind string, key string, action string, day long")
    got = u.evaluate(spark.createDataFrame([(*c, "x", "y", "z") for c in CAPTURES], SCHEMA), events).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, url, t, len(h := slow(url, t)), ",".join(sorted(set(h))) or None) for i, url, t in CAPTURES]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty(spark):
    events = spark.createDataFrame(EVENTS, "list string, kind string, key string, action string, day long")
    captures = spark.createDataFrame([(*c, "x", "y", "z") for c in CAPTURES], SCHEMA)
    assert u.evaluate(captures.limit(0), events).collect() == []
    assert {r.n_hits for r in u.evaluate(captures, events.limit(0)).collect()} == {0}
