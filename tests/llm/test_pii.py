import hashlib
import random
import re
import time

import numpy as np
import pytest

from tessera.llm import crf, pii

PROSE = ["The cat sat on the mat and looked at the wide sea for hours.", "Une autre chose que nous avions dans les maisons, et puis le reste.", "Version 2.0 of it came out on the 3rd day."] * 5
SCHEMA = "doc_id long, text string, spans string, n_ip string"


@pytest.fixture(scope="module")
def model():
    return pii.train(PROSE)


def slow_base(text):
    """The patterns and checks as stated, without short cuts."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m.group().split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c in "0123456789"]
        if 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]


TEXTS = [None, "", "no data here", "mail a.b+c@x-y.example.com, ip 10.0.0.255 not 10.0.0.256", "card 4539 1488 0343 6467 or 4539148803436468", "tel +1 (942) 555-3818 é 4539148803436467 +12", "x" * 9_000 + " a@b.co", "٣٤ 1.2.3.4.5 @@ +1+1 a@b a@b.c.", "1 2 3 4 5 6 7 8 9 0 " * 300]


def test_base_spans():
    rng = random.Random(0)
    for t in TEXTS + ["".join(rng.choice("1205. -+()a@b.c") for _ in range(rng.randint(0, 60))) for _ in range(5000)]:
        assert pii.base_spans(t or "") == slow_base(t or "")


@pytest.mark.parametrize("t", [".1.2.3.4", "v.1.2.3.4", "...192.168.1.1", "host.10.0.0.1", "x.1.2.3.4.5", "1..2.3.4.5", ".1.2.3", "..1.2.3.4.5.6.7.8.9", "1.2.3.4..5.6.7.8"])
def test_addresses_after_a_dot(t):
    assert pii.base_spans(t) == slow_base(t)


@pytest.mark.parametrize("t", ["x" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "." * 300_000])
def test_long_runs_take_linear_time(t):
    began = time.time()
    pii.base_spans(t)
    parts = pii.stretches(t + " " + t)
    assert time.time() - began < 8
    assert all(a < b for a, b in parts) and all(x[1] < y[0] for x, y in zip(parts, parts[1:]))


def test_find(spark, model):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(1, "a@b.co", "x", "y"), (None, "a@b.co", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    for m in (model, None):
        got = pii.find(df, m).collect()
        assert len(got) == len(rows)
        for r in got:
            t = dict((x[0], x[1]) for x in rows[: len(TEXTS)]).get(r.doc_id) if r.doc_id not in (1, None) else None
            if t is not None:
                base = pii.joined(slow_base(t))
                assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert pii.find(df.limit(0), model).collect() == []


def test_the_network_adds_spans_and_leaves_prose_alone(model):
    found = {t: pii.all_spans(model.narrow(), [t])[0] for t in (f"please call {a} or write soon" for a in ("(942) 555-3818", "(271) 555-0042", "(555) 123-4567"))}
    assert sum(bool(spans) and not base for base, spans in found.values()) >= 2
    for t in PROSE + ["Licensed under the Apache License, Version 2.0. See 2024-01-02."]:
        assert pii.all_spans(model.narrow(), [t])[0] == ([], [])


def test_gradient(model):
    m = pii.Model.new(3, 1)
    xs, ys = pii.labelled_windows(PROSE, 3, 1)

    def likelihood():
        e, a, total = pii.run_lstm(m, xs), m.trans + pii.BAD, 0.0
        for r in range(len(xs)):
            first = m.init + pii.BAD_START + e[r, 0]
            v, s = first, first[ys[r, 0]]
            for i in range(1, pii.WINDOW):
                v = np.logaddexp.reduce(v[:, None] + a, axis=0) + e[r, i]
                s += a[ys[r, i - 1], ys[r, i]] + e[r, i, ys[r, i]]
            total += s - np.logaddexp.reduce(v)
        return total / xs.size

    rng = np.random.default_rng(0)
    for part, g in zip(m.parts(), pii.gradient(m, xs, ys)):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in part.shape)
            old = part[at]
            part[at] = old + 1e-5
            up = likelihood()
            part[at] = old - 1e-5
            down = likelihood()
            part[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_spans_that_the_patterns_miss(model):
    """Held-out made-up spans in prose: what the patterns miss is mostly found, and little else."""
    rng = random.Random(77)
    right, added, missed = 0, 0, 0
    for _ in range(1500):
        text, own = pii._number(rng, rng.choice(pii.ALL_KINDS)) if rng.random() < 0.6 else (pii._noise(rng), [])
        head = rng.choice(["Nous avions une autre maison ", "they sat and looked at the wide sea ", "and another one: "])
        text, own = head + text + " was what they had.", [(k, a + len(head), b + len(head)) for k, a, b in own]
        base, spans = pii.all_spans(model.narrow(), [text])[0]
        want, got = set(own) - set(base), set(spans) - set(base)
        right, added, missed = right + len(want & got), added + len(got), missed + len(want)
    assert missed > 400 and right > 0.9 * added and right > 0.6 * missed  # trained on three sentences


def test_repeated_cards_and_long_spaced_addresses(model):
    rng, found = random.Random(1), 0
    for _ in range(60):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = body + next(c for c in "0123456789" if pii.luhn(body + c))
        text = rng.choice(["they said that the cards were ", "il y a une autre chose ", "cards: "]) + f"{card} {card}" + rng.choice([" and then went on", ". Une autre", "\n"])
        spans = [x for x in pii.all_spans(model.narrow(), [text])[0][1] if x[0] == "card"]
        assert pii.base_spans(text) == [] and all(text[a:b] == card for _, a, b in spans)
        found += len(spans)
    assert found > 25  # trained on three sentences
    text = "write to " + "first.middle.last-of-a-very-long-name.department" + " @ mail.department.university.example for more, they said"
    a, b = text.index("first"), text.index(" for more")
    assert any(x <= a and b <= y for x, y in pii.stretches(text))


def test_windows_are_reconciled(model):
    long = "tel (942) 555-3818 " * 40
    spans = pii.all_spans(model.narrow(), [long])[0][1]
    assert len(spans) > 30 and all(re.fullmatch(r"\(942\) 555-3818", long[a:b]) for _, a, b in spans)


def slow_tags(model, text):
    """Spans by the windows' averaged emissions of the whole text and one path through all of it."""
    x = pii.encode(text)
    emit, weight = np.zeros((len(x) + pii.WINDOW, pii.TAGS), np.float32), np.zeros(len(x) + pii.WINDOW, np.float32)
    for at in range(0, max(1, len(x) - (pii.WINDOW - pii.STRIDE)), pii.STRIDE):
        w = np.full((1, pii.WINDOW), 99)
        w[0, : len(x[at : at + pii.WINDOW])] = x[at : at + pii.WINDOW]
        emit[at : at + pii.WINDOW] += pii.run_lstm(model, w)[0] * pii._WEIGHT[:, None]
        weight[at : at + pii.WINDOW] += pii._WEIGHT
    emit, n = emit[None, : len(x)] / weight[: len(x), None], np.array([len(x)])
    y = crf.best_paths(emit, n, model.trans + pii.BAD, model.init + pii.BAD_START)[0].tolist()
    m = crf.forward_backward_padded(emit, n, model.trans + pii.BAD, model.init + pii.BAD_START)[0]
    out = []
    for a in (i for i, k in enumerate(y) if k % 2):
        b = next((i for i in range(a + 1, len(y)) if y[i] != y[a] + 1), len(y))
        out.append((pii.ALL_KINDS[y[a] // 2], a, b, pytest.approx(float(np.mean([m[i, y[i]] for i in range(a, b)])), abs=1e-3)))
    return out


def test_tags_are_those_of_whole_texts(model, monkeypatch):
    """Bounds on the gain of spans, chunks of texts and contexts of probabilities change nothing."""
    rng, sharp, texts = random.Random(3), model.narrow(), []
    for _ in range(60):
        parts = [rng.choice([rng.choice(PROSE), pii._number(rng, rng.choice(pii.ALL_KINDS))[0], pii._noise(rng)]) for _ in range(rng.randint(0, 12))]
        texts.append(rng.choice([" ", "\n"]).join(parts))
    texts += ["1", "x" * 48, "x" * 96, "1" * 97, "1 2 3 " * 60, "(942) 555-3818"]
    vague = pii.Model(*[(x * 0.3).astype(np.float32) for x in model.parts()])
    for m in (sharp, vague):
        want = [slow_tags(m, t) if t else [] for t in texts]
        assert sum(map(len, want)) > 50
        assert pii.tag(m, texts) == want
        monkeypatch.setattr(pii, "AT_ONCE", 500)
        assert pii.tag(m, texts) == want
        monkeypatch.undo()


def test_gates_are_looked_up_once_for_both_windows(model, monkeypatch):
    """A place is in two windows; its gates are looked up once in each direction, but for ends of texts and lanes."""
    texts, looked_up, take = [" ".join(PROSE) * n for n in (40, 3, 100)], [], np.take
    monkeypatch.setattr(np, "take", lambda a, ids, **more: (a.dtype == np.float32 and a.size == pii.CHARS * 80 and looked_up.append(np.size(ids)), take(a, ids, **more))[1])
    pii.scores(model.narrow(), texts)
    assert 2 <= sum(looked_up) / sum(map(len, texts)) < 2.4


def test_lanes_change_no_emission(model, monkeypatch):
    texts = ["x", "(942) 555-3818 " * 9, *("a1 @" * n for n in (11, 12, 13, 23, 24, 25, 36, 37))]
    got = []
    for lanes in (480, 7, 1):
        monkeypatch.setattr(pii, "LANES", lanes)
        emit, first = pii.scores(model.narrow(), texts)
        got.append(np.concatenate([emit[:, a : a + len(t)] for a, t in zip(first, texts)], 1))
    assert np.allclose(got[0], got[1], atol=1e-4) and np.allclose(got[0], got[2], atol=1e-4)


def test_only_spans_that_may_be_added_get_a_probability(model, monkeypatch):
    text, sharp = "please call +1 (942) 555-3818 or write soon", model.narrow()
    assert pii.tag(sharp, [text]) and pii.tag(sharp, [text], lambda *_: False) == [[]]
    monkeypatch.setattr(pii, "forward_backward_padded", None)
    assert pii.all_spans(sharp, [text]) == [([("phone", 12, 29)], [("phone", 12, 29)])]


def test_letters_are_no_address():
    assert [pii.passes("ip", s) for s in ("1.a", "a.1.2.3", "1.2.3.256", "001.2.3.4", "1..2")] == [False, False, False, True, True]


def letter_q():
    """A network of one unit that takes every q as part of a secret."""
    m = pii.Model(*(x * 0 for x in pii.Model.new(1, 0).parts()))
    m.inputs[:, :, :] = [20, -20, 20, -20]  # input, forget and output gate, cell
    m.inputs[:, ord("q") - 30, 3] = 20
    m.out[:, 9:] = [9, 10]
    return m


def test_every_place_of_a_text_is_tagged():
    """Spans far from digits, at and equals signs are found."""
    m = letter_q()
    text = f"a 1 {'word ' * 60}qqqqqqqqqq {'word ' * 60}1 b"
    a = text.index("q")
    assert not any(x < a + 10 and a < y for x, y in pii.stretches(text))
    assert pii.all_spans(m.narrow(), ["qqqqqqqq", "", text, "q q"]) == [([], [("secret", 0, 8)]), ([], []), ([], [("secret", a, a + 10)]), ([], [])]


def test_every_place_of_a_text_is_masked(spark):
    rows = [(1, f"a 1 {'word ' * 60}qqqqqqqqqq {'word ' * 60}1 b", "x", "y"), (2, None, "x", "y")]
    got = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(rows, SCHEMA), letter_q()).collect()}
    assert got == {1: rows[0][1].replace("qqqqqqqqqq", "[SECRET]"), 2: None}


def test_masking(spark, model):
    rows = [(1, "write a@b.co now", "x", "y"), (2, None, "x", "y"), (3, "clean", "x", "y")]
    got = {r.doc_id: r for r in pii.masked(spark.createDataFrame(rows, SCHEMA), None).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["write [EMAIL] now", None, "clean"] and got[1].spans == "x"
    assert pii.mask("0123456789", [("card", 2, 6), ("phone", 4, 8)]) == "01[CARD]89"


def test_masked_texts_go_back_in_parts(spark):
    rows = [(i, None if i % 7 == 0 else f"{i} to a{i}@b.co", "x", "y") for i in range(2 * pii.RETURNED + 5)]
    got = pii.masked(spark.createDataFrame(rows, SCHEMA).coalesce(1), None).collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, None if t is None else f"{i} to [EMAIL]") for i, t, _, _ in rows]
