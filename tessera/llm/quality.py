"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines around it, with learned transitions, by
forward-backward. The length-weighted mean of the lines' marginals, put through a fitted logistic, is the document's
quality. Line features are counts over bytes and word hashes, computed for all lines of a batch at once.

Scale: fitting reads a bounded sample of labelled documents (`max_docs`, at most `max_lines` lines of each); scoring is a
map over whole texts without any shuffle, linear in their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_bucket, text_or_empty
from tessera.llm.crf import forward_backward, starts_of, train

UPPER, LOWER, DIGIT, SPACE, STOP, MARK, BAR, HIGH = range(8)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = UPPER, LOWER, DIGIT, HIGH
for _c in b" \t\r\n\v\f":
    _CLASS[_c] = SPACE
for _c in b".,;:'-\"()?":
    _CLASS[_c] = STOP
for _c in b"|/\\<>=_{}[]":
    _CLASS[_c] = BAR
BINS = 10
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK = 2 << 20


def split_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes with a newline after each text, line ends, lines per text); an empty text is one empty line."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(data == 10)
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    return data, ends, lines


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, line lengths in bytes, lines per text)."""
    data, ends, lines = split_lines(texts)
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = ends - begins
    cls = _CLASS[data]
    counts = np.empty((len(ends), 8))
    for k in range(8):
        c = np.concatenate([[0], np.cumsum(cls == k, dtype=np.int32)])
        counts[:, k] = c[ends] - c[begins]
    space = cls == SPACE
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data) + 1, _P))
        inverse = np.cumprod(np.full(len(data) + 1, _PINV))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        word = (sums[last] - sums[first]) * inverse[first]
    line = np.searchsorted(ends, first)
    words = np.bincount(line, minlength=len(ends)).astype(float)

    def repeats(lag: int) -> np.ndarray:
        same = (word[lag:] == word[:-lag]) & (line[lag:] == line[:-lag])
        return np.bincount(line[lag:][same], minlength=len(ends)) / np.maximum(words, 1)

    w = last - first
    short = np.bincount(line[w <= 3], minlength=len(ends))
    mixed = np.bincount(line, _CLASS[data[last - 1]] == MARK, minlength=len(ends))
    barred = np.bincount(line, (w == 1) & (_CLASS[data[first]] == BAR), minlength=len(ends))
    caps = np.bincount(line, _CLASS[data[first]] == UPPER, minlength=len(ends))
    n, used = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, UPPER] + counts[:, LOWER] + counts[:, HIGH], 1)
    ended = np.where(size > 0, data[np.maximum(ends - 1, 0)] == 46, False)
    opened = np.where(size > 0, (cls[begins] == UPPER) | (cls[begins] == HIGH), False)
    with np.errstate(over="ignore"):
        line_hash = (sums[ends] - sums[begins]) * inverse[begins]
    again = np.concatenate([[False], line_hash[1:] == line_hash[:-1]]) & ~starts_of(lines)
    out = [np.log1p(size), np.log1p(words), counts[:, UPPER] / letters, letters / n, counts[:, DIGIT] / n, counts[:, MARK] / n, counts[:, BAR] / n, counts[:, STOP] / n]
    out += [size / used, short / used, mixed / used, barred / used, caps / used, repeats(1), repeats(2), repeats(3) + repeats(5), ended, opened, again]
    return np.stack(out, 1), size, lines


@dataclass
class Model:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray
    trans: np.ndarray
    init: np.ndarray
    doc: np.ndarray  # of the logistic over document features


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[f], x[:, f], side="left") + f * BINS for f in range(x.shape[1])], 1) if len(x) else np.zeros((0, x.shape[1]), np.int64)


def with_neighbours(b: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Feature rows of each line: its own, those of the line before and of the line after (an edge has its own row)."""
    n, f = b.shape
    before, after = np.roll(b, 1, 0) + width, np.roll(b, -1, 0) + 2 * width
    ends = np.roll(starts, -1)
    before[starts], after[ends] = 3 * width, 3 * width + 1
    return np.concatenate([b, before, after], 1)


def good_lines(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's probability of being good, line lengths, lines per text."""
    x, size, lines = line_features(texts)
    starts = starts_of(lines)
    rows = with_neighbours(binned(x, model.edges), starts, x.shape[1] * BINS)
    emit = model.weights[rows].sum(1) / np.sqrt(rows.shape[1])
    return forward_backward(emit, starts, model.trans, model.init)[:, 1], size, lines


def document_features(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Of each text: 1, the length-weighted mean of good, its logit, the log length."""
    first = np.concatenate([[0], np.cumsum(lines)[:-1]])
    weight = np.maximum(size, 1).astype(float)
    total = np.add.reduceat(weight, first)
    mean = np.add.reduceat(good * weight, first) / total
    p = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(lines)), mean, np.log(p / (1 - p)), np.log1p(total) / 10], 1)


def chunks(texts: list[str]) -> Iterator[list[bytes]]:
    """The texts as UTF-8, in lists of about CHUNK bytes."""
    part, n = [], 0
    for t in texts:
        raw = t.encode()
        if part and n + len(raw) > CHUNK:
            yield part
            part, n = [], 0
        part.append(raw)
        n += len(raw)
    if part:
        yield part


def score(model: Model, texts: list[str]) -> np.ndarray:
    out = [1 / (1 + np.exp(-(document_features(*good_lines(model, part)) @ model.doc))) for part in chunks(texts)]
    return np.concatenate(out) if out else np.zeros(0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 0, of: int = 5, max_docs: int = 4000, max_lines: int = 400, rounds: int = 60) -> Model:
    """Fit on labelled documents outside the held-out bucket: those with the smallest id hashes, at most about max_docs,
    and max_lines consecutive lines of each from a place its id hash names. Lines take their document's label."""
    known = labels.filter((hash_bucket(id_col, of) != held_out) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    n = known.count()
    h = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30))
    # Bounded by max_docs (the share of the hashes), so that it may be broadcast.
    known = known.withColumn("_h", h).filter(F.col("_h") < int(min(1.0, max_docs / max(1, n)) * (1 << 30)) + 1)
    part = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(known), "_id").select("_h", "_y", "_text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                lines = t.split("\n")
                s = k % max(1, len(lines) - max_lines + 1)
                texts.append("\n".join(lines[s : s + max_lines]).encode())
            x, size, lines = line_features(texts)
            cut = np.cumsum(lines)[:-1]
            rows = [pa.array([r.tobytes() for r in np.split(a, cut)], pa.binary()) for a in (x, size)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *rows], names=["h", "y", "x", "size"])

    got = sorted(part.mapInArrow(sample, "h long, y int, x binary, size binary").collect())[: 2 * max_docs]
    blank = line_features([b""])[0].shape[1]
    if len({r.y > 0 for r in got}) < 2:
        share = float(np.mean([r.y > 0 for r in got])) if got else 0.5
        at = np.log((share + 0.01) / (1.01 - share))
        return Model(np.zeros((blank, BINS - 1)), np.zeros((3 * blank * BINS + 2, 2)), np.zeros((2, 2)), np.zeros(2), np.array([at, 0, 0, 0]))
    size = [np.frombuffer(r.size, np.int64) for r in got]
    x = np.concatenate([np.frombuffer(r.x).reshape(len(s), blank) for r, s in zip(got, size)])
    y, lines, size = np.array([int(r.y > 0) for r in got]), np.array([len(s) for s in size]), np.concatenate(size)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    starts = starts_of(lines)
    rows = with_neighbours(binned(x, edges), starts, blank * BINS)
    w, trans, init = train(np.arange(len(x)), rows.ravel(), np.full(len(x), rows.shape[1]), 3 * blank * BINS + 2, np.repeat(y, lines), starts, 2, rounds)
    good = forward_backward(w[rows].sum(1) / np.sqrt(rows.shape[1]), starts, trans, init)[:, 1]
    return Model(edges, w, trans, init, logistic(document_features(good, size, lines), y))


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with the column `out`, the probability of label 1.

    Null texts count as empty, and an empty text is one empty line, with the score the model gives that. Other columns,
    nulls and repeated rows pass unchanged; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(score(shared.value, s.tolist()))

    return docs.withColumn(out, predict(text_or_empty(text_col)))


def lines_table(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, n, size in bytes, good (its marginal)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, size, lines = good_lines(shared.value, [t.encode() for t in b.column(1).to_pylist()])
            ids = [i for i, n in zip(b.column(0).to_pylist(), lines) for _ in range(n)]
            at = np.concatenate([np.arange(n) for n in lines])
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(at), pa.array(size), pa.array(good)], names=["doc_id", "n", "size", "good"])

    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, n long, size long, good double")


def score_all(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; fitted on labels outside the held-out bucket."""
    got = with_quality(docs.select("doc_id", "text"), fit(docs, labels), out="score")
    return got.select("doc_id", (hash_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
