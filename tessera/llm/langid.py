"""Language identification of words and texts by a linear-chain conditional random field.

Every word of a text gets a label from affix, character n-gram and lexicon features (hashed, with learned weights) and
learned transitions, by forward-backward; a text's language is the label with the largest letter-weighted sum of word
marginals. So code-switched texts are labelled word by word, and the text by what most of it is in.

Scale: fitting reads a bounded sample (`max_docs` texts, `max_words` consecutive words of each), the model has a fixed
size and is broadcast; labelling is a map over whole texts without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_bucket, text_or_empty
from tessera.llm.crf import forward_backward, starts_of, train

WORDS = re.compile(r"[^\W\d_]+")
WIDTH = 1 << 16
UNKNOWN = "und"
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _P
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int32) & (WIDTH - 1)


def word_features(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """(positions in words, hashed features) by length of word: n-grams of 2 to 4 with boundary marks (those at a
    boundary are the affixes of 1 to 3), affixes of 4, and the word itself for the lexicon."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    with np.errstate(over="ignore"):
        for n, at in by.items():
            for s in range(0, len(at), max(1, 400_000 // (n + 1))):
                part = at[s : s + max(1, 400_000 // (n + 1))]
                code = np.array([words[i] for i in part], f"<U{n}").view(np.uint32).reshape(len(part), n).astype(np.uint64)
                c = np.full((len(part), n + 2), 1, np.uint64)
                c[:, 1:-1] = code
                c[:, -1] = 2
                slots, gram = [], c
                for k in range(2, 6):
                    if n + 2 < k:
                        break
                    gram = gram[:, :-1] * np.uint64(1_000_003) + c[:, k - 1 :]
                    slots.append(_mix(gram, k) if k < 5 else _mix(gram[:, [0, -1]], k))
                whole = np.zeros(len(part), np.uint64)
                for j in range(n):
                    whole = whole * np.uint64(1_000_003) + code[:, j]
                slots.append(_mix(whole, 99)[:, None])
                yield part, np.concatenate(slots, 1)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    init: np.ndarray


class Emissions:
    """Log potentials of words, computed once per distinct word; the table is emptied when it is full, which costs time alone."""

    CAPACITY = 300_000

    def __init__(self, model: Model):
        self.w = model.weights.astype(np.float32)
        self.at: dict[str, int] = {}
        self.table = np.zeros((1 << 12, self.w.shape[1]), np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        at = self.at
        new = [w for w in set(words) if w not in at]
        if new:
            if len(at) and len(at) + len(new) > self.CAPACITY:
                at.clear()
                new = list(set(words))
            base = len(at)
            if base + len(new) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), base + len(new)), self.table.shape[1]), np.float32)
                grown[:base] = self.table[:base]
                self.table = grown
            for part, f in word_features(new):
                self.table[base + np.array(part)] = self.w[f].sum(1) / np.float32(np.sqrt(f.shape[1]))
            at.update(zip(new, range(base, base + len(new))))
        return self.table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]


def words_of(text: str) -> list[str]:
    """Lower-case words of letters; none where the text has no letter."""
    words = WORDS.findall(text.lower())
    return words if any(map(str.isalpha, words)) else []


def label_words(model: Model, emissions: Emissions, words: list[list[str]]) -> np.ndarray:
    """Marginals of all words of the texts, end to end."""
    flat = [w for x in words for w in x]
    return forward_backward(emissions(flat), starts_of(np.array([len(x) for x in words])), model.trans, model.init)


def identify(model: Model, emissions: Emissions, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, scores, todo, size = [], [], [], 0

    def flush():
        lengths = np.array([len(x) for x in todo])
        marginals = label_words(model, emissions, todo)
        weight = np.fromiter((len(w) for x in todo for w in x), float, int(lengths.sum()))
        sums = np.zeros((len(todo), len(model.labels)))
        some = np.flatnonzero(lengths)
        if len(some):
            first = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
            sums[some] = np.add.reduceat(marginals * weight[:, None], first, axis=0)
        for s, n in zip(sums, lengths):
            best = int(s.argmax())
            langs.append(model.labels[best] if n else UNKNOWN)
            scores.append(min(1.0, float(s[best] / s.sum())) if n else 0.0)
        todo.clear()

    for text in texts:
        todo.append(words_of(text))
        size += len(todo[-1])
        if size > 150_000:
            flush()
            size = 0
    if todo:
        flush()
    return langs, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, of: int = 4, max_docs: int = 2500, max_words: int = 200, rounds: int = 20) -> Model:
    """Fit on documents outside the held-out bucket that have a language: those with the smallest id hashes, at most
    about max_docs, and max_words consecutive words of each from a place its id hash names."""
    known = docs.filter((hash_bucket(id_col, of) != held_out) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.select(id_col).count()
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30))
    part = known.filter(h < int(min(1.0, max_docs / max(1, n)) * (1 << 30)) + 1) if n else known

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, lang, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                s = k % max(1, len(words) - max_words + 1)
                if words:
                    rows.append((k, lang, " ".join(words[s : s + max_words])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["h", "lang", "words"])

    rows = part.select(h, F.col(lang_col).cast("string"), F.col(text_col)).mapInArrow(sample, "h long, lang string, words string").collect()
    rows = sorted(rows)[: 2 * max_docs]
    labels = sorted({r.lang for r in rows})
    if not labels:
        return Model([UNKNOWN], np.zeros((WIDTH, 1)), np.zeros((1, 1)), np.zeros(1))
    at: dict[str, int] = {}
    types = np.fromiter((at.setdefault(w, len(at)) for r in rows for w in r.words.split(" ")), np.int32)
    lengths = np.array([r.words.count(" ") + 1 for r in rows])
    gold = np.repeat(np.array([labels.index(r.lang) for r in rows], np.int8), lengths)
    starts = starts_of(lengths)
    del rows
    counts = np.zeros(len(at), np.int64)
    words = list(at)
    slots = list(word_features(words))
    for positions, f in slots:
        counts[positions] = f.shape[1]
    index, first = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
    for positions, f in slots:
        index[first[positions][:, None] + np.arange(f.shape[1])] = f
    del slots, words, at
    w, trans, init = train(types, index, counts, WIDTH, gold, starts, len(labels), rounds)
    return Model(labels, w, trans, init)


def with_language(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """docs with a column `out`: struct<lang_pred string, score double>.

    Texts that are null or have no letter are `und` with score 0. Other columns, nulls and repeated rows pass unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(shared.value)
        for s in batches:
            langs, scores = identify(shared.value, emissions, s.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(out, predict(text_or_empty(text_col)))


def words_table(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: doc_id, n, word, label, marginal; texts without letters give none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            m = label_words(shared.value, emissions, words)
            ids = [i for i, x in zip(b.column(0).to_pylist(), words) for _ in x]
            best = m.argmax(1)
            cols = [pa.array(ids, b.schema.field(0).type), pa.array([j for x in words for j in range(len(x))], pa.int64()), pa.array([w for x in words for w in x], pa.string())]
            cols += [pa.array([shared.value.labels[i] for i in best], pa.string()), pa.array(m[np.arange(len(m)), best])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "word", "label", "marginal"])

    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"doc_id {kind}, n long, word string, label string, marginal double")


def predict_all(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; fitted on the documents outside the held-out bucket."""
    got = with_language(docs.select(F.col(id_col).alias("doc_id"), "text"), fit(docs, id_col), out="_lang")
    return got.select("doc_id", (hash_bucket("doc_id", 4) == 2).alias("held_out"), "_lang.lang_pred", "_lang.score")
