"""Best-fit decreasing packing of token sequences.

Documents are turned into byte-level BPE ids plus one separator id. A document longer than the capacity is cut into
whole-capacity pieces, its remainder being the first piece; everything else stays in one piece. Pieces are then placed
by best-fit decreasing: longest first, each into the open bin with the least sufficient room, which a segment tree over
the remaining capacities finds in logarithmic time.

Scale: a piece's length is all that its place depends on, so the driver sees only the histogram of lengths (at most
`capacity` rows, whatever the corpus). Equal pieces are placed in runs, bins with equal room are kept as groups, and the
result is a plan of runs that every executor applies to its own pieces; the number of runs depends on the number of
lengths, not of documents. Ranks within a length come from per-task counters in a written table, so no window or sort
ever holds all pieces of one length and a hot length needs no salt.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, written

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, task int, k long"


class SegmentTree:
    """Counts of open bins by remaining room 0..n; finds the least room of at least r in O(log n)."""

    def __init__(self, n: int):
        self.size = 1 << max(1, n).bit_length()
        self.any = [0] * (2 * self.size)

    def add(self, room: int, count: int) -> None:
        i = room + self.size
        while i:
            self.any[i] += count
            i >>= 1

    def tightest(self, r: int) -> int | None:
        """The least room >= r of an open bin, or None."""
        i, t = r + self.size, self.any
        if r >= self.size:
            return None
        if t[i]:
            return r
        while i > 1:
            if not i & 1 and t[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if t[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths, as runs (length, first rank, items, per bin, first bin, offset).

    Item j of a run goes to bin `first bin + j // per bin` at `offset + length * (j % per bin)`. Placing piece by piece
    gives the same bins: the tightest bin stays the tightest while it has room for another piece of that length.
    """
    tree, groups, runs, bins = SegmentTree(capacity), defaultdict(list), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit the capacity {capacity}")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                take = -(-left // per)
                first, bins = bins, bins + take
            else:
                per, (first, have) = room // length, groups[room].pop()
                take = min(have, -(-left // per))
                tree.add(room, -have)
                if have > take:
                    groups[room].append((first + take, have - take))
                    tree.add(room, have - take)
            items = min(left, take * per)
            runs.append((length, rank, items, per, first, capacity - room))
            full, over = divmod(items, per)
            for start, n, used in ((first, full, per), (first + full, 1, over)):
                if n and used and room - used * length:
                    groups[room - used * length].append((start, n))
                    tree.add(room - used * length, n)
            left, rank = left - items, rank + items
    return runs


class ByteLevelIds:
    """Ids of a byte-level BPE tokenizer file as little-endian unsigned 32-bit bytes.

    Words between single spaces are looked up in a bounded cache: a space between two non-space characters always begins
    a pre-token, so words can be encoded apart. Other texts, and those that hold the tokenizer's added tokens, go to the
    tokenizer whole. The cache bound affects speed alone.
    """

    CACHE = 400_000
    SPACES = re.compile(r" \s|\s |^\s|\s$")
    PLAIN = re.compile(r"[\u0000-ɏ‐-‧]*")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.hf = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [a["content"] for a in spec.get("added_tokens") or []]
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.fast = None
        if model["type"] == "BPE" and byte_level and not spec.get("normalizer") and not model.get("ignore_merges"):
            keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
            of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
            vocab = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if all(c in of for c in t)}
            merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
            ranks = [model["vocab"][m] for m in merged]
            if ranks == sorted(ranks) and len(vocab) == 256 + len(set(merged)):
                self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})._core_bpe
        ids = self

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                out = ids.word(" " + word)
                if len(self) < ids.CACHE and len(word) < 64:
                    self[word] = out
                return out

        self.cache = Cache()

    def word(self, word: str) -> bytes:
        if self.fast is not None and self.PLAIN.fullmatch(word):
            return np.array(self.fast.encode_ordinary(word), "<u4").tobytes()
        return np.array(self.hf.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.hf.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.SPACES.search(text):
            return self.word(text)
        first, *words = text.split(" ")
        return self.word(first) + b"".join(map(self.cache.__getitem__, words))


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then whole capacities."""
    head = n % capacity if n > capacity else n
    at = 0
    while at < n:
        size = head if at == 0 and head else min(capacity, n - at)
        yield at, size
        at += size


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces with task and k, the piece's number among those of its length in its task."""
    schema = PIECES.format(id=docs.schema[id_col].dataType.simpleString())
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = ByteLevelIds(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = ids(text) + end
                for piece, (start, size) in enumerate(cut(len(data) // 4, capacity)):
                    row = (doc, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), task, seen[size])
                    seen[size] += 1
                    for to, x in zip(rows, row):
                        to.append(x)
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "k"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `capacity` ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts count as the separator alone; repeated rows are packed once each; ties between equal lengths go
    by task and order in it; an empty table gives no rows; other columns are ignored. Null ids are kept.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, capacity, separator, id_col, text_col), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = written(counts, "piece-counts")
    # One row per task of a length: grows with the number of tasks, not of documents.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs = np.array(plan_best_fit(histogram, capacity), "i8").reshape(-1, 6)
    plan = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = plan.value
        key = r[:, 0] << 48 | r[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = r[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            j = rank - run[:, 1]
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(run[:, 4] + j // run[:, 3]), pa.array(run[:, 5] + length * (j % run[:, 3]))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    ranked = pieces.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
