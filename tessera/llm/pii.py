"""Personal data: pattern matches, and more spans by a character-level bidirectional LSTM with CRF transitions.

The base spans are exact pattern matches with checks. The network, trained in numpy from labelled spans, adds what the
patterns miss: phone numbers without a country code, cards in other groupings, repeated or after other numbers, addresses
with blanks around the sign, and secrets (keys, tokens and passwords), a fifth kind. It tags overlapping windows, whose
scores are averaged with weights that favour a window's middle; one best path through the CRF then runs over the whole
text. An added span must be likely, end at word ends, pass the checks of its kind (as base spans must) and touch no base
span.

Every window of every text goes through the network. The path is worked out where scores leave room for a span: bounds
on what any span could gain over none prove that the rest has none, and that it changes no path.

Scale: fitting reads a bounded sample (`max_docs` documents, 3 snippets of each); tagging is a map over whole texts with
no shuffle, linear in their length, with the scores of `AT_ONCE` characters or of one longer text in memory.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, text_or_empty
from tessera.llm.crf import Adam, best_paths, forward_backward_padded

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PART = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@=]+")
TAGS = 1 + 2 * len(ALL_KINDS)
CHARS = 100
WINDOW, STRIDE, AROUND = 96, 48, 40
#: Characters and lanes taken at once. They bound memory and change no result.
AT_ONCE, LANES = 1 << 18, 480
#: Masked texts that go back to Spark at once.
RETURNED = 1000
#: Characters on both sides of a span that its probability is worked out with: farther ones don't tell in it.
CONTEXT = 2 * WINDOW
#: Room for rounding in the bounds of a span's gain.
ROUNDING = 1e-2
#: Least mean probability of an added span's tags.
SURE = 0.8
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def passes(kind: str, s: str) -> bool:
    """The checks of a kind: parts of an address at most 255, lengths, Luhn."""
    if kind == "ip":
        parts = [x.lstrip("0") for x in s.split(".")]
        return all(len(x) <= 3 and (not x or x.isdecimal() and int(x) <= 255) for x in parts)
    if kind == "card":
        d = _digits(s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    if kind == "secret":
        return len(s) >= 8 and not any(map(str.isspace, s))
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain in linear time: a match begins where the run of local characters before an at sign does."""
    end, p = 0, text.find("@")
    while p >= 0:
        a = p
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < p and (m := DOMAIN.match(text, p)):
            end = m.end()
            yield a, end
        p = text.find("@", max(p + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four dotted numbers in linear time: each whole run of dotted numbers is used four by four."""
    at = text.find(".")
    while at >= 0:
        a = at
        while a and text[a - 1] in "0123456789":
            a -= 1
        b, parts = at, [(a, at)]
        while b < len(text) and text[b] == "." and (m := PART.match(text, b + 1)):
            b = m.end()
            parts.append(m.span())
        if a == at:  # no number before the first dot
            del parts[0]
        for i in range(0, len(parts) - 3, 4):
            yield parts[i][0], parts[i + 3][1]
        at = text.find(".", max(at + 1, b))


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind, then start; leftmost and non-overlapping within a kind."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", a, b) for a, b in addresses(text) if passes("ip", text[a:b])]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if passes("card", m.group())]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if passes("phone", m.group())]
    return out


_IDS = np.full(193, 99, np.uint8)
_IDS[32:127], _IDS[10], _IDS[192] = np.arange(2, 97), 97, 98


def encode(text: str) -> np.ndarray:
    """Character ids: printable ASCII and newline have their own, letters beyond share one, anything else another."""
    return _IDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 192)]


@dataclass
class Model:
    inputs: np.ndarray  # direction x character x gates
    hidden: np.ndarray  # direction x units x gates
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    init: np.ndarray

    @classmethod
    def new(cls, units: int, seed: int) -> "Model":
        r = np.random.default_rng(seed)
        inputs = r.normal(0, 0.3, (2, CHARS, 4 * units))
        inputs[:, :, units : 2 * units] += 0.5
        return cls(inputs, r.normal(0, 0.6 / np.sqrt(units), (2, units, 4 * units)), r.normal(0, 0.3, (2 * units, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.out, self.bias, self.trans, self.init]

    def narrow(self) -> "Model":
        return Model(*[x.astype(np.float32) for x in self.parts()])


def _forbidden() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and beginnings that aren't spans: an inner tag needs its kind before it."""
    bad, start = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for k in range(len(ALL_KINDS)):
        bad[:, 2 + 2 * k] = -50
        bad[1 + 2 * k, 2 + 2 * k] = bad[2 + 2 * k, 2 + 2 * k] = 0
        start[2 + 2 * k] = -50
    return bad, start


BAD, BAD_START = _forbidden()


def run_lstm(model: Model, x: np.ndarray, keep: bool = False):
    """Emissions (rows x positions x tags) of character rows; with keep, what the gradient needs."""
    n, t = x.shape
    u = model.hidden.shape[1]
    both, kept = np.empty((n, t, 2 * u), model.out.dtype), []
    for d in (0, 1):
        h = c = np.zeros((n, u), model.out.dtype)
        states = []
        for i in range(t) if d == 0 else range(t - 1, -1, -1):
            z = model.inputs[d][x[:, i]] + h @ model.hidden[d]
            s = 0.5 * np.tanh(0.5 * z[:, : 3 * u]) + 0.5
            g = np.tanh(z[:, 3 * u :])
            before_h, before_c = h, c
            c = s[:, :u] * g + s[:, u : 2 * u] * c
            tc = np.tanh(c)
            h = s[:, 2 * u :] * tc
            both[:, i, d * u : (d + 1) * u] = h
            if keep:
                states.append((i, s, g, tc, before_h, before_c))
        kept.append(states)
    emit = both @ model.out + model.bias
    return (emit, both, kept) if keep else emit


def gradient(model: Model, x: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean log-likelihood by position."""
    n, t = x.shape
    u = model.hidden.shape[1]
    emit, both, kept = run_lstm(model, x, keep=True)
    m, pairs, first = forward_backward_padded(emit, np.full(n, t), model.trans + BAD, model.init + BAD_START, pairs=True)
    gold = np.zeros_like(m)
    np.put_along_axis(gold, tags[:, :, None], 1.0, 2)
    de = (gold - m) / (n * t)
    seen = np.bincount((tags[:, :-1] * TAGS + tags[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
    d_trans, d_init = (seen - pairs) / (n * t), (np.bincount(tags[:, 0], minlength=TAGS) - first) / (n * t)
    d_both, d_out = de @ model.out.T, np.tensordot(both, de, ((0, 1), (0, 1)))
    d_in, d_hidden = np.zeros_like(model.inputs), np.zeros_like(model.hidden)
    for d in (0, 1):
        dh, dc, dz_all = np.zeros((n, u)), np.zeros((n, u)), np.empty((t, n, 4 * u))
        for i, s, g, tc, h0, c0 in reversed(kept[d]):
            gi, gf, go = s[:, :u], s[:, u : 2 * u], s[:, 2 * u :]
            dh = dh + d_both[:, i, d * u : (d + 1) * u]
            dc = dc + dh * go * (1 - tc * tc)
            dz = np.concatenate([dc * g * gi * (1 - gi), dc * c0 * gf * (1 - gf), dh * tc * go * (1 - go), dc * gi * (1 - g * g)], 1)
            d_hidden[d] += h0.T @ dz
            dz_all[i] = dz
            dh, dc = dz @ model.hidden[d].T, dc * gf
        hot = np.zeros((CHARS, t * n), np.float32)
        hot[x.T.ravel(), np.arange(t * n)] = 1
        d_in[d] = hot @ dz_all.reshape(t * n, -1)
    return [d_in, d_hidden, d_out, de.sum((0, 1)), d_trans, d_init]


def _number(rng: random.Random, kind: str) -> tuple[str, list[Span]]:
    """A made-up text with its spans, in forms that the patterns know and forms that they don't."""
    d = lambda n, a="0123456789": "".join(rng.choice(a) for _ in range(n))
    word = lambda: d(rng.randint(3, 9), "abcdefghijklmnopqrstuvwxyz")
    if kind == "email":
        at = rng.choice(["@", "@", " @ ", "@ ", " @"])
        local = rng.choice([f"{word()}{rng.choice(['.', '_', '', '-'])}{rng.choice([word(), d(2), ''])}", f"{word()}.{word()}.{word()}-{word()}", f".{d(2)}"])
        s = f"{local}{at}{rng.choice(['', '', word() + '.', word() + '.' + word() + '.'])}{word()}{rng.choice(['', d(1)])}.{rng.choice(['example.com', 'com', 'org', 'net', 'example.org', 'example'])}"
    elif kind == "ip":
        s = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        body = rng.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-", ".", "  ", "_"])
        s = sep.join(body[i : i + 4] for i in range(0, 16, 4))
        roll = rng.random()
        if roll < 0.3:  # twice
            gap = rng.choice([" ", " ", "-", ", ", " / "])
            return s + gap + s, [(kind, 0, len(s)), (kind, len(s) + len(gap), 2 * len(s) + len(gap))]
        if roll < 0.45:  # after another number
            head = rng.choice([d(2), d(4), d(8), "1"]) + " "
            return head + s, [(kind, len(head), len(head) + len(s))]
    elif kind == "phone":
        x, y, z = d(3), d(3), d(4)
        s = rng.choice([f"+{rng.randint(1, 99)} ({x}) {y}-{z}", f"+1 {x} {y} {z}", f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}", f"({x}) {y} {z}", f"00{rng.randint(1, 99)} {x} {y} {z}"])
        if rng.random() < 0.3:  # in a list
            gap = rng.choice([" ", ", ", " / ", " or ", f" {d(3, 'abcdefghijklmnopqrstuvwxyz')} ", f", {word()} "])
            return s + gap + s, [(kind, 0, len(s)), (kind, len(s) + len(gap), 2 * len(s) + len(gap))]
    else:
        mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        s = rng.choice([d(40, "0123456789abcdef"), d(40, "0123456789abcdef"), d(32, "0123456789abcdef"), "AKIA" + d(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), d(rng.randint(16, 40), mixed), d(rng.randint(10, 20), mixed), "sk_live_" + d(24, mixed)])
        name = rng.choice(["token", "token", "api_key", "apikey", "secret", "password", "passwd", "access_key", "auth_token", word() + "_key"])
        if rng.random() < 0.2:
            name, s = name.upper(), s.upper()
        head = name + rng.choice([" = ", " = ", "=", ": "]) + (quote := rng.choice(['"', '"', "'", ""]))
        return head + s + quote, [(kind, len(head), len(head) + len(s))]
    return s, [(kind, 0, len(s))]


def _noise(rng: random.Random) -> str:
    """Digits, at and equals signs that are neither personal data nor secrets."""
    d = lambda n, a="0123456789": "".join(rng.choice(a) for _ in range(n))
    return rng.choice([f"Version {d(1)}.{d(1)}", f"version {d(1)}.{d(2)}.{d(1)}", d(40, "0123456789abcdef"), f"commit {d(40, '0123456789abcdef')}", f"{d(4)}-{d(2)}-{d(2)}", f"${d(2)}.{d(2)}", d(rng.randint(1, 7)), f"{d(2)}:{d(2)}", f"{d(3)},{d(3)},{d(3)}", f"@{d(5, 'abcdefgh')}", f"{d(20)}", f"# {d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"{d(1, 'xyz')} = {d(2)}", f"{d(3, 'abc')}={d(1)}", "a == b", "===="])


def labelled_windows(snippets: list[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of characters and tags: snippets with made-up spans or noise put in; base spans are labelled too."""
    rng = random.Random(seed)
    clean = lambda t: DIGIT.sub("", t).replace("@", "").replace("=", "")
    xs, ys = np.full((count, WINDOW), 99, np.int64), np.zeros((count, WINDOW), np.int64)
    for r in range(count):
        text = rng.choice(snippets) if snippets else ""
        spans = [] if rng.random() < 0.5 else base_spans(text)
        if not spans:
            text = clean(text)
            room = rng.randint(10, 60)
            text = text[:room].rsplit(" ", 1)[0]
            rest = snippets and rng.choice(snippets) or ""
            roll = rng.random()
            if roll < 0.75:
                s, own = _number(rng, rng.choice(ALL_KINDS))
                text += rng.choice([" ", "\n", " ", ": "]) if text else ""
                spans = [(kind, len(text) + a, len(text) + b) for kind, a, b in own]
                text += s + rng.choice([" ", ". ", "\n", ", ", " ", "!! "]) + clean(rest)
            elif roll < 0.95:
                text += " " + _noise(rng) + rng.choice([" ", ". ", "\n"]) + clean(rest)
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            if not tags[a:b].any():
                tags[a:b] = 2 + 2 * ALL_KINDS.index(kind)
                tags[a] -= 1
        mid = spans[0][1] if spans else rng.randint(0, max(0, len(text)))
        at = max(0, min(mid - rng.randint(0, WINDOW - 8), max(0, len(text) - WINDOW)))
        part = encode(text[at : at + WINDOW])
        xs[r, : len(part)] = part
        y = tags[at : at + WINDOW]
        if len(y) and y[0] and y[0] % 2 == 0:  # cut in a span
            y = y.copy()
            y[0] -= 1
        ys[r, : len(y)] = y
    return xs, ys


def train(snippets: list[str], units: int = 20, steps: int = 450, rows: int = 32, rate: float = 0.03, seed: int = 5) -> Model:
    model = Model.new(units, seed)
    adams = [Adam(p.shape, rate) for p in model.parts()]
    xs, ys = labelled_windows(sorted(snippets), 6000, seed)
    order = np.random.default_rng(seed)
    for step in range(steps):
        at = order.integers(0, len(xs), rows)
        g = gradient(model, xs[at], ys[at])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g))
        for p, a, x in zip(model.parts(), adams, g):
            a.rate = rate * min(1.0, 2 * (1 - step / steps))
            p += a.step(x * min(1.0, 1.0 / max(norm, 1e-9)))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 1500, **more) -> Model:
    """Fit on snippets of the documents with the smallest id hashes, at most about max_docs, 3 of each: around a base span
    or from a place its id hash names. Labels are the base spans and those of numbers put into the snippets."""
    n = docs.select(id_col).count()
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = [s for _, s, _ in base_spans(t)[:2]]
                for s in [*at, k % max(1, len(t) - 80)]:
                    out.append((k, t[max(0, s - 40) : s + 80]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["h", "text"])

    part = docs.select(h.alias("h"), text_or_empty(text_col).alias("text")).filter(F.col("h") < int(min(1.0, max_docs / max(1, n)) * (1 << 30)) + 1)
    rows = sorted(part.mapInArrow(sample, "h long, text string").collect())[: 6 * max_docs]
    return train([r.text for r in rows], **more)


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text around digits, at and equals signs, where most spans are, merged where they meet; tagging takes
    the whole text. A part ends where a word does, and
    holds the whole words on both sides of its at signs, whatever their length. Linear in the text."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        end = out[-1][1] if out else 0
        a, b = max(0, m.start() - AROUND), max(end, min(len(text), m.end() + AROUND))
        if "@" in m.group():
            i = m.start()
            i -= i > 0 and text[i - 1] == " "
            while i > end and text[i - 1] in LOCAL:
                i -= 1
            a = min(a, max(0, i - 1))
            j = max(m.end(), end - 1)
            j += j < len(text) and text[j] == " "
            while j < len(text) and text[j] in LOCAL:
                j += 1
            b = max(b, min(len(text), j + 1))
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= end:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


_WEIGHT = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)


def _shares() -> np.ndarray:
    """Shares of the window that begins with a block and of the one that ends with it in the block's places (place x window
    x 0 if there is neither, 1 if only the first, 2 if only the second, 3 if both)."""
    out = np.zeros((STRIDE, 2, 4), np.float32)
    out[:, 0, 1] = out[:, 1, 2] = 1
    both = np.stack([_WEIGHT[:STRIDE], _WEIGHT[STRIDE:]], 1)
    out[:, :, 3] = both / both.sum(1, keepdims=True)
    return out


_SHARES = _shares()


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Emissions (tags x places) of texts that aren't empty, averaged over their windows as `run_lstm` gives them, and each
    text's first place. Between texts is at least one place of no text.

    Blocks of STRIDE places lie in lanes, one after the other. A block is in two windows, one that begins with it and one
    that ends with it; both are worked out in the same steps, so that a character's gates are looked up once, and averaged
    there. A lane has the block before it once more (after it, backwards), for the window that it shares with that block.
    A sigmoid is a tanh of the half, so all gates go through one call; outputs are kept doubled, which rounds alike."""
    lengths = np.array([len(t) for t in texts])
    windows = np.maximum(1, -(-(lengths - STRIDE) // STRIDE))
    first = np.concatenate([[0], np.cumsum(np.maximum(2, lengths // STRIDE + 1))])
    deep = -(-int(first[-1]) // LANES)
    n = -(-int(first[-1]) // deep)
    x = np.full((n * deep + 2, STRIDE), 99, np.uint8)
    flat = x[1:].reshape(-1)
    for t, s, size in zip(texts, (first * STRIDE).tolist(), lengths.tolist()):
        flat[s : s + size] = encode(t)
    begins = np.zeros(len(x) + 1, np.int8)
    begins[np.repeat(first[:-1] - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum())) + 2] = 1
    in_windows = begins[1:] + 2 * begins[:-1]

    u, kind = model.hidden.shape[1], model.out.dtype.type
    half = np.ones(4 * u, kind)
    half[: 3 * u] = 0.5
    gates_and_tags, g, last = np.empty((2, 4 * u + TAGS, n), kind), np.empty((4 * u, n), kind), np.empty((2, TAGS, n), kind)
    z, tags = gates_and_tags[:, : 4 * u], gates_and_tags[:, 4 * u :]
    rows = z[0].reshape(n, 4 * u)  # free until z is worked out
    h, c, part = (np.zeros((2, u, n), kind) for _ in range(3))
    out = np.empty((deep, STRIDE, TAGS, n), np.float32)
    for d, steps in enumerate((range(STRIDE), range(STRIDE - 1, -1, -1))):
        table, to_tags = np.ascontiguousarray(model.inputs[d] * half), model.out[d * u : (d + 1) * u].T * kind(0.5)
        hidden = np.concatenate([(model.hidden[d] * half).T * kind(0.5), to_tags])

        def add(k: int, p: int, emits: np.ndarray) -> None:
            np.multiply(emits, share[p], out=last)
            if d == 0:
                np.add(last[0], last[1], out=out[k, p])
            else:
                out[k, p] += last[0]
                out[k, p] += last[1]

        for k in range(-1, deep) if d == 0 else range(deep, -1, -1):
            own = slice(1 + k, 2 + k + (n - 1) * deep, deep)
            ids = np.ascontiguousarray(x[own].T, np.intp)
            share = np.take(_SHARES[:, :: 1 - 2 * d], in_windows[own], axis=2)[:, :, None]
            h[1], c[1] = h[0], c[0]
            h[0] = c[0] = 0
            outside = not 0 <= k < deep
            h2, c2, z2, part2, both2 = (a[:1] if outside else a for a in (h, c, z, part, gates_and_tags))
            i, f, o, a = (z2[:, j * u : (j + 1) * u] for j in range(4))
            sigmoids = z2[:, : 3 * u]
            for p in steps:
                np.take(table, ids[p], axis=0, out=rows, mode="clip")
                np.copyto(g, rows.T)
                np.matmul(hidden, h2, out=both2)
                if p != steps[0] and not outside:  # the tags of the step before
                    add(k, p - 1 + 2 * d, tags)
                np.add(z2, g, out=z2)
                np.tanh(z2, out=z2)
                np.add(sigmoids, 1, out=sigmoids)
                np.multiply(c2, f, out=c2)
                np.multiply(i, a, out=part2)
                np.add(c2, part2, out=c2)
                np.multiply(c2, kind(0.5), out=c2)
                np.tanh(c2, out=part2)
                np.multiply(o, part2, out=h2)
            if not outside:
                add(k, p, np.matmul(to_tags, h))
        h[:] = c[:] = 0
    flat_out = out.transpose(2, 3, 0, 1).reshape(TAGS, -1)
    flat_out += model.bias[:, None]
    return flat_out, first[:-1] * STRIDE


def _room(model: Model, emit: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a best path may leave tag 0: all but the places of which every span through them gains less than none does.

    A span gains its first character's and its inner characters' scores over tag 0 and, at most, the best transitions at
    its ends and in it. The greatest gain of all spans of a kind that end at a place comes from a running sum and maximum;
    in texts where one is enough, the greatest gain of those through a place does too."""
    trans, init = model.trans.astype(np.float64) + BAD, model.init.astype(np.float64) + BAD_START
    edges = np.zeros(emit.shape[1] + 1, np.int8)
    edges[first] += 1
    edges[ends] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8) > 0
    none = np.where(inside, emit[0], np.float32(1e5))
    out = np.zeros(len(inside), bool)
    for k in range(1, TAGS, 2):
        into = max((trans[:, k] - trans[:, 0]).max(), init[k] - init[0])
        after = max((trans[k : k + 2, [0, *range(1, TAGS, 2)]] - trans[0, [0, *range(1, TAGS, 2)]]).max(), 0.0)
        total = np.subtract(emit[k + 1], none, dtype=np.float64)
        total += max(trans[k, k + 1], trans[k + 1, k + 1]) - trans[0, 0]
        np.cumsum(total, out=total)
        left = np.subtract(emit[k], none, dtype=np.float64)
        left -= total
        np.maximum.accumulate(left, out=left)
        enough = np.flatnonzero(left + total > -ROUNDING - into - after)
        for j in np.unique(np.searchsorted(first, enough, side="right") - 1):
            own = slice(first[j], ends[j])
            out[own] |= left[own] + np.maximum.accumulate(total[own][::-1])[::-1] > -ROUNDING - into - after
    return out


def _rows(emits: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Emissions (tags x positions) of like lengths as rows: (their numbers, rows x positions x tags, lengths)."""
    size = [x.shape[1] for x in emits]
    order = sorted(range(len(emits)), key=size.__getitem__)
    s = 0
    while s < len(order):
        e = s + 1
        while e < len(order) and e - s < 2048 and size[order[e]] <= size[order[s]] * 1.3 + 8 and (e - s + 1) * size[order[e]] < 100_000:
            e += 1
        rows = np.zeros((e - s, size[order[e - 1]], TAGS), np.float32)
        for row, i in zip(rows, order[s:e]):
            row[: size[i]] = emits[i].T
        yield order[s:e], rows, np.array([size[i] for i in order[s:e]])
        s = e


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order, those that meet as one."""
    if not len(a):
        return a, b
    new = np.flatnonzero(np.concatenate([[True], a[1:] > np.maximum.accumulate(b)[:-1]]))
    return a[new], np.maximum.reduceat(b, new)


def _tag(model: Model, texts: list[str], wanted: Callable[[int, str, int, int], bool]) -> list[list[tuple[str, int, int, float]]]:
    emit, first = scores(model, texts)
    n = np.array([len(t) for t in texts])
    room = np.flatnonzero(_room(model, emit, first, first + n))
    trans = model.trans + BAD

    def around(a: np.ndarray, b: np.ndarray, more: int):
        """The ranges with more places of their texts around them: (starts, rows of emissions, lengths, initial scores)."""
        own = np.searchsorted(first, a, side="right") - 1
        a, b = _merged(np.maximum(a - more, first[own]), np.minimum(b + more, (first + n)[own]))
        begins = np.isin(a, first)
        for mine, init in ((a[begins], model.init + BAD_START), (a[~begins], trans[0])):
            ends = b[np.searchsorted(a, mine)]
            for ids, rows, lengths in _rows([emit[:, x:y] for x, y in zip(mine, ends)]):
                yield mine[ids], rows, lengths, init

    spans = []
    for starts, rows, lengths, init in around(room, room + 1, 1):
        best = best_paths(rows, lengths, trans, init)
        r, i = np.nonzero(best % 2 == 1)
        goes_on = np.zeros(best.shape, bool)  # an inner tag is always after one of its kind
        goes_on[:, 1:] = (best[:, 1:] > 0) & (best[:, 1:] % 2 == 0)
        stop = np.where(goes_on, best.shape[1], np.arange(best.shape[1]))
        stop = np.concatenate([np.minimum.accumulate(stop[:, ::-1], 1)[:, ::-1], np.full((len(best), 1), best.shape[1])], 1)
        spans.append(np.stack([starts[r] + i, starts[r] + np.minimum(stop[r, i + 1], lengths[r]), best[r, i]], 1))
    out: list[list] = [[] for _ in texts]
    if not sum(map(len, spans)):
        return out
    found = np.concatenate(spans)
    found = found[np.argsort(found[:, 0])]
    own = np.searchsorted(first, found[:, 0], side="right") - 1
    keep = np.array([wanted(i, ALL_KINDS[(k - 1) // 2], a - at, b - at) for i, at, (a, b, k) in zip(own.tolist(), first[own].tolist(), found.tolist())])
    found, own = found[keep], own[keep]
    sure = np.zeros(len(found))
    for starts, rows, lengths, init in around(found[:, 0], found[:, 1], CONTEXT):
        m = forward_backward_padded(rows, lengths, trans, init)
        for s, row, size in zip(starts.tolist(), m, lengths.tolist()):
            for j in range(*np.searchsorted(found[:, 0], [s, s + size])):
                x, y, k = (found[j] - [s, s, 0]).tolist()
                sure[j] = (row[x, k] + row[x + 1 : y, k + 1].sum()) / (y - x)
    for i, at, (a, b, k), p in zip(own.tolist(), first[own].tolist(), found.tolist(), sure.tolist()):
        out[i].append((ALL_KINDS[(k - 1) // 2], a - at, b - at, p))
    return out


def tag(model: Model, texts: list[str], wanted: Callable[[int, str, int, int], bool] = lambda *_: True) -> list[list[tuple[str, int, int, float]]]:
    """Spans of each text (kind, start, end, mean probability): windows' emissions averaged, then one best path. Of the
    spans on it those are given that are wanted (number of the text, kind, start, end); others need no probability."""
    out: list[list] = [[] for _ in texts]
    part, size = [], 0
    for i, t in enumerate(texts):
        if t:
            part.append(i)
            size += len(t) + 2 * STRIDE
        if part and (size >= AT_ONCE or i == len(texts) - 1):
            for j, found in zip(part, _tag(model, [texts[j] for j in part], lambda j, *span, part=part: wanted(part[j], *span))):
                out[j] = found
            part, size = [], 0
    return out


def all_spans(model: Model | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text, by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if model is not None:

        def may_be_added(i: int, kind: str, a: int, b: int) -> bool:
            t = texts[i]
            edge = (t[a - 1 : a] if a else "") + t[b : b + 1]
            return passes(kind, t[a:b]) and not any(c.isalnum() for c in edge) and not any(a < y and x < b for _, x, y in base[i])

        for i, found in enumerate(tag(model, texts, may_be_added)):
            added[i] += [(kind, a, b) for kind, a, b, sure in found if sure >= SURE]
    rank = {k: j for j, k in enumerate(ALL_KINDS)}
    return [(b, sorted(b + a, key=lambda s: (rank[s[0]], *s[1:]))) for b, a in zip(base, added)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_spans (their number);
    offsets in code points. Spans of kind secret are added ones and come last.

    Null and empty texts have no spans; every row gives one row, repeated or not; other columns are ignored; an empty
    table gives no rows. Without a model the spans are the base spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and model.narrow())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def start():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for base, spans in all_spans(shared.value, b.column(1).to_pylist()):
                rows.append((*(sum(k == x for x, _, _ in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), t) for x, t in zip(zip(*rows), types))], names=names)

        return step

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return map_texts(docs.select(F.col(id_col), text_or_empty(text_col)), start, schema)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span (or stretch of overlapping spans) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced; null texts stay null, all other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model and model.narrow())

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            for at in range(0, len(s), RETURNED):
                texts = s.iloc[at : at + RETURNED].tolist()
                found = all_spans(shared.value, [t or "" for t in texts])
                yield pd.Series([None if t is None else mask(t, spans) for t, (_, spans) in zip(texts, found)], dtype=object)

    return docs.withColumn(text_col, clean(text_col))
