"""Tokens, n-grams, stems, count and TF-IDF vectors."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def is_punctuation(c: Column) -> Column:
    """Whether a string is one ASCII punctuation character."""
    return c.rlike(f"^{PUNCTUATION}$")


def tokens(text: Column, lowercase: bool = True, strip: bool = True) -> Column:
    """Words between spaces (not other white space); ASCII letters alone are lowered, ASCII punctuation is a space."""
    if lowercase:
        text = F.translate(text, UPPER, LOWER)
    if strip:
        text = F.regexp_replace(text, PUNCTUATION, " ")
    return F.filter(F.split(text, " "), lambda x: x != "")


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """n-grams joined by _, all of one length before the next; lengths in either order."""
    low, high = min(low, high), max(low, high)
    if low < 1:
        raise ValueError("n must be positive")

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return words if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), "_"))

    parts = [of(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def tokenize(text: Column, low: int = 1, high: int = 1, lowercase: bool = True, strip: bool = True) -> Column:
    words = tokens(text, lowercase, strip)
    # Bound once: inside a lambda the tokens would be made anew for every n-gram.
    return words if low == high == 1 else F.get(F.transform(F.array(words), lambda w: ngrams(w, low, high)), F.lit(0))


#: suffix: (least length of the word, what replaces it); the first that fits counts.
STEMS = {"ational": (8, "ate"), "tional": (7, "tion"), "izer": (5, "ize"), "ator": (5, "ate"), "ies": (4, "y"), "ied": (4, "y"), "ing": (4, ""), "ed": (3, ""), "s": (3, "")}


def stem(word: Column) -> Column:
    """The word with one suffix replaced; lengths are of bytes."""
    out = None
    for suffix, (least, new) in STEMS.items():
        fits = (F.octet_length(word) >= least) & F.endswith(word, F.lit(suffix))
        cut = F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(new))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(word)


_FOLDED = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in string.punctuation else c for c in range(256))


def counts_of_rows(docs: DataFrame, low: int, high: int) -> DataFrame:
    """(doc_id, token, n) of every row by itself: the tokens of `tokenize`, counted where the text is."""
    low, high = min(low, high), max(low, high)
    if low < 1:
        raise ValueError("n must be positive")

    def count(text: bytes) -> Counter:
        words = [w for w in text.translate(_FOLDED).split(b" ") if w]  # UTF-8 has no ASCII bytes inside other signs
        out = Counter(words) if low == 1 else Counter()
        for n in range(max(low, 2), high + 1):
            out.update(map(b"_".join, zip(*(words[i:] for i in range(n)))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, tokens, n = [], [], []

            def flush() -> pa.RecordBatch:
                token = pa.array(tokens, pa.binary()).cast(pa.string())
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places, pa.int32())), token, pa.array(n, pa.int64())], names=["doc_id", "token", "n"])

            for i, text in enumerate(b.column(1).cast(pa.binary())):
                if (text := text.as_py()) is None:
                    continue
                found = count(text)
                places.extend([i] * len(found))
                tokens.extend(found.keys())
                n.extend(found.values())
                if len(tokens) > 100_000:
                    yield flush()
                    places, tokens, n = [], [], []
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, token string, n long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 1, high: int = 1) -> DataFrame:
    """(doc_id, token, n). Rows are counted where they are; only rows whose id is another row's as well meet by a shuffle."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return counts_of_rows(docs, low, high)
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    alone, shared = docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")
    return counts_of_rows(alone, low, high).unionByName(counts_of_rows(shared, low, high).groupBy("doc_id", "token").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame, max_features: int | None = None) -> DataFrame:
    """(token, total, df, col): ranked by total descending, then token bytewise; at most max_features.

    The ranking is an order by with a limit where there is one; else tokens with their totals are written once, and ranks
    come from running sums over groups of equal totals, so no window holds all tokens.
    """
    from tessera.core import prefix_sums
    from tessera.operators.graph import _written as written

    v = counts.groupBy("token").agg(F.sum("n").alias("total"), F.count("*").alias("df"))
    if max_features is not None:
        if max_features < 1:
            raise ValueError("max_features must be positive")
        top = v.orderBy(F.desc("total"), "token").limit(max_features)
        return top.withColumn("col", F.row_number().over(Window.orderBy(F.desc("total"), "token")) - 1)
    v = written(v)
    # Tokens of equal totals are ranked by their first two characters, then inside those.
    v = v.withColumn("_pre", F.left("token", F.lit(2)))
    sizes = prefix_sums(v.groupBy("total").agg(F.count("*").alias("k")), "total", {"upto": "k"}, descending=True).select("total", (F.col("upto") - F.col("k")).alias("_before"))
    groups = v.groupBy("total", "_pre").agg(F.count("*").alias("k")).withColumn("_off", F.coalesce(F.sum("k").over(Window.partitionBy("total").orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    ranked = v.withColumn("_r", F.row_number().over(Window.partitionBy("total", "_pre").orderBy("token")))
    return ranked.join(groups, ["total", "_pre"]).join(sizes, "total").select("token", "total", "df", (F.col("_before") + F.col("_off") + F.col("_r") - 1).cast("int").alias("col"))


class CountVectorizer:
    """Sparse counts (doc_id, col, val) over a fitted vocabulary; unknown tokens are left out."""

    def __init__(self, low: int = 1, high: int = 1, max_features: int | None = None):
        self.low, self.high, self.max_features, self.vocabulary = low, high, max_features, None

    def fit(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "CountVectorizer":
        self.vocabulary = vocabulary(token_counts(docs, id_col, text_col, self.low, self.high), self.max_features)
        return self

    def transform(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        from tessera.core import NotFitted

        if self.vocabulary is None:
            raise NotFitted("fit comes first")
        counts = token_counts(docs, id_col, text_col, self.low, self.high)
        return counts.join(self.vocabulary.select("token", "col"), "token").select("doc_id", "col", F.col("n").cast("double").alias("val"))

    def fit_transform(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return self.fit(docs, id_col, text_col).transform(docs, id_col, text_col)


def most_frequent_ngrams(docs: DataFrame, n: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k most frequent n-grams in rank order: (token, total, col)."""
    return vocabulary(token_counts(docs, id_col, text_col, n, n), k).select("token", "total", "col")


def tf_idf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 1, high: int = 1, max_features: int | None = None) -> DataFrame:
    """(doc_id, token, val): ln(1 + count) ln(documents / (1 + document frequency)), which may be negative; no norm."""
    counts = token_counts(docs, id_col, text_col, low, high)
    v = vocabulary(counts, max_features) if max_features else counts.groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("_docs"))
    return counts.join(v.select("token", "df"), "token").crossJoin(F.broadcast(n)).select("doc_id", "token", (F.log1p("n") * F.ln(F.col("_docs") / (1 + F.col("df")))).alias("val"))
