"""SentencePiece encoding and decoding by a streaming Viterbi.

A text passes once, character by character, through a lattice of pieces. Every position keeps one backpointer; only the
last `longest piece` positions can begin a further piece, and as soon as the backpointers of all of these lead to one
boundary, the ids before it are committed and forgotten. So memory is bounded by the window, not by the text.

Unigram models take the path of the greatest summed score. BPE models have no additive score, but the same lattice gives
exactly the ids that the merges give: a piece may follow another only if merging their concatenation yields these two,
and then each position has just one last piece. Where no piece holds a word boundary inside, which is known from the
model, paths converge at every word; what the lattice commits for a word is kept in a bounded cache, which affects speed
alone: no id comes from anywhere but the lattice.

Scale: a map over whole texts without a shuffle; the model file is read once per Python worker.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, text_or_empty

SPACE = "▁"
#: A word with the marks before it, or the marks that end a text.
WORD = re.compile("▁*[^▁]+|▁+")


class Pieces:
    """A SentencePiece model; identity normalisation is done here, any other by the library's normaliser."""

    #: Words and beginnings of words whose ids and backpointers are kept, and their greatest length: they affect speed alone.
    CACHE, PREFIXES, KEPT = 450_000, 700_000, 64

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece.sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        m.ParseFromString(proto)
        self.bpe = m.trainer_spec.model_type == 2
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("a unigram or BPE model is needed")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        self.scores = [p.score for p in m.pieces]
        self.bytes_ = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.fallback = m.trainer_spec.byte_fallback and len(self.bytes_) == 256
        self.longest = max(map(len, self.ids))
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.normalizer = None
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            import sentencepiece

            self.normalizer = sentencepiece.SentencePieceProcessor(model_proto=proto).normalize
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.out = [b""] * len(m.pieces)
        for p, i in self.ids.items():
            self.out[i] = p.replace(SPACE, " ").encode()
        for p, i in self.bytes_.items():
            self.out[i] = bytes([int(p[3:5], 16)])
        self.out[self.unknown] = " ⁇ ".encode()
        self.joins: dict[tuple[str, str], bool] = {}
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.ends: dict[str, str] = {}
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[-3:], {1, 2}).add(len(p))
        self.spans = {end: tuple(sorted(n, reverse=True)) for end, n in lengths.items()}
        own = self

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                ids = b"".join([own.packed.get(p) or own.pack(p) for p in own.segments(word)])
                if len(self) < own.CACHE and len(word) < own.KEPT:
                    self[word] = ids
                return ids

        self.cache = Cache()

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes_[f"<0x{b:02X}>"] for b in piece.encode()] if self.fallback else [self.unknown]

    def pack(self, piece: str) -> bytes:
        return np.array(self.piece_ids(piece), "<u4").tobytes()

    def merged(self, s: str) -> list[str]:
        """BPE merges of a short string: the best-scored neighbours first, the leftmost of equal ones."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether merging a + b leaves these two."""
        known = self.joins.get((a, b))
        if known is None:
            if len(self.joins) > 500_000:
                self.joins.clear()
            known = self.joins[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def segments(self, text, window: list | None = None) -> Iterator[str]:
        """Pieces of normalised text (an iterable of characters), committed as soon as all paths agree: where a word
        begins, if no piece holds such a place, and wherever all backpointers of the last `longest` positions lead to one
        boundary. window: gets the number of retained characters at each commit.

        A position of a BPE lattice has one last piece, so that is its backpointer."""
        return self._bpe(text, window) if self.bpe else self._unigram(text, window)

    def _bpe(self, text, window: list | None) -> Iterator[str]:
        """`segments` of a BPE model. What a lattice that begins anew has at a position depends on the characters since
        alone; the pieces at beginnings of words are kept, and a string goes on from the longest one known."""
        ids, most, spans, ends, joins, apart = self.ids, self.longest, self.spans, self.ends, self.joins, self.apart
        if len(ends) > self.PREFIXES:
            ends.clear()
        held, last, fresh = "", [""], True
        if isinstance(text, str):
            known = min(len(text), self.KEPT)
            while known and text[:known] not in ends:
                known -= 1
            held, text = text[:known], text[known:]
            last += [None] * known  # looked up where they are needed
        for c in text:
            if c == SPACE and apart and held and held[-1] != SPACE:
                if window is not None:
                    window.append(len(held))
                yield from self._path(last, held)
                held, last, fresh = "", [""], True
            held += c
            piece = ends.get(held) if fresh else None
            if piece is None:
                i = len(held)
                for n in spans.get(held[-3:], (2, 1)):  # lengths of pieces that end so
                    if n > i:
                        continue
                    s = held[-n:]
                    if n == 1 or s in ids:
                        j = i - n
                        before = last[j]
                        if before is None:
                            before = last[j] = ends[held[:j]]
                        fits = joins.get((before, s))
                        if fits or (fits is None and self.follows(before, s)):
                            piece = s
                            break
                if fresh and i < self.KEPT:
                    ends[held] = piece
            last.append(piece)
            i = len(last) - 1
            if i >= most and i % most == 0:
                last = [ends[held[:j]] if x is None else x for j, x in enumerate(last)]
                at = self._agreed(i, [j - len(x) for j, x in enumerate(last)])
                if at:
                    if window is not None:
                        window.append(i)
                    yield from self._path(last[: at + 1], held)
                    held, last, fresh = held[at:], last[at:], False
        if window is not None:
            window.append(len(held))
        yield from self._path(last, held)

    def _unigram(self, text, window: list | None) -> Iterator[str]:
        """`segments` of a unigram model."""
        ids, scores, most, spans, apart = self.ids, self.scores, self.longest, self.spans, self.apart
        held, best, last = "", [0.0], [""]
        for c in text:
            if c == SPACE and apart and held and held[-1] != SPACE:
                if window is not None:
                    window.append(len(held))
                yield from self._path(last, held)
                held, best, last = "", [0.0], [""]
            held += c
            i = len(held)
            top, piece = None, ""
            for n in spans.get(held[-3:], (2, 1)):
                if n > i:
                    continue
                s = held[-n:]
                k = ids.get(s)
                if k is None and n > 1:
                    continue
                score = best[i - n] + (self.least if k is None else scores[k])
                if top is None or score > top:
                    top, piece = score, s
            best.append(top)
            last.append(piece)
            if i >= most and i % most == 0:
                at = self._agreed(i, [j - len(x) for j, x in enumerate(last)])
                if at:
                    if window is not None:
                        window.append(i)
                    yield from self._path(last[: at + 1], held)
                    held, last = held[at:], last[at:]
                    best = [b - best[at] for b in best[at:]]
        if window is not None:
            window.append(len(held))
        yield from self._path(last, held)

    def _agreed(self, i: int, back: list[int]) -> int:
        """The one boundary to which the backpointers of all positions that may begin a further piece lead."""
        open_ = set(range(max(0, i + 1 - self.longest), i + 1))
        while len(open_) > 1:
            j = max(open_)
            open_.remove(j)
            open_.add(back[j])
        return open_.pop()

    def _path(self, last: list[str | None], held: str) -> list[str]:
        """The pieces on the way to the last position; None stands for a kept one."""
        at, out = len(last) - 1, []
        while at:
            out.append(last[at] or self.ends[held[:at]])
            at -= len(out[-1])
        return out[::-1]

    def stream(self, text) -> Iterator[bytes]:
        """Ids of normalised text (an iterable of characters) as little-endian 32-bit bytes, piece by piece as they are
        committed; neither the text nor the ids are held."""
        packed = self.packed
        for p in self.segments(text):
            yield packed.get(p) or self.pack(p)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self.normalizer is not None:
            text = self.normalizer(text)
        elif self.prefix:
            text = " " + text
        text = text.replace(" ", SPACE)
        if self.apart:  # every word's ids are what the lattice gave for it, now or before
            return b"".join(map(self.cache.__getitem__, WORD.findall(text)))
        return b"".join(self.stream(text))

    def decode(self, data: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.out.__getitem__, np.frombuffer(data, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(1)
def _loaded(path: str, changed: int) -> Pieces:
    """A model with its caches, kept for further tasks of the same Python worker."""
    return Pieces(path)


def load(path: str) -> Pieces:
    return _loaded(path, os.stat(path).st_mtime_ns)


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (decoding gives the text).

    Null and empty texts have no ids and round-trip. A text with U+2581 doesn't, as the model reads that as a space.
    Every row gives one row, repeated or not; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_ids", "ids", "ids_crc32", "round_trip"]

    def start():
        pieces = load(model)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            ids = [pieces.encode(t) for t in texts]
            n = np.array([len(x) // 4 for x in ids])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
            same = [pieces.decode(x) == t for x, t in zip(ids, texts)]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), lists, pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same)], names=names)

        return step

    return map_texts(docs.select(F.col(id_col), text_or_empty(text_col)), start, f"doc_id {kind}, n_ids long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode_ids(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of a column of id arrays; null arrays count as empty."""
    kind = rows.schema[id_col].dataType.simpleString()

    def start():
        pieces = load(model)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [pieces.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return step

    return map_texts(rows.select(id_col, ids_col), start, f"doc_id {kind}, text string")
