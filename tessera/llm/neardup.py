"""Near-duplicates by Order MinHash with verification by banded alignment.

A text's k-mers are runs of k words, labelled with their occurrence number. Each of `hashes` hash functions picks the
ell k-mers that it puts lowest and keeps them in the order of the text; two texts that agree on one such sequence are a
candidate pair, which is likelier the smaller their edit distance is. Candidates pass exact lower bounds of the edit
distance (lengths, word histograms) and are then aligned in a band, so that no text is linked on a sketch alone.

Scale. Equal texts are one class from the start, found by a partially aggregated group-by, however many there are. Each
class is first aligned with one leader, the least class of most of its buckets. Then all classes of a bucket are compared
with all, in the bucket of their first common key, so every candidate is met and n_links counts all of them; a hot bucket
is cut into chunks whose meetings are separate, bounded blocks. The triangle inequality over a common leader, lengths and
histograms decide most pairs by array arithmetic without their texts; what they leave is aligned, and texts travel for
these once per pair of tiles, not once per pair. The work is the number of candidates, as is the number of links in a group
of near copies; tables hold undecided pairs alone. Of buckets of the same classes the first stands for all. Components come
from alternating large-star and small-star steps on written tables. Tables are deleted when nothing reads them any more,
shuffle files when their table is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import discard, text_or_empty
from tessera.llm.textbytes import chunks, mix, word_hashes

K, ELL, HASHES = 3, 2, 32
SHORT, SHORT_HASHES = 24, 16
SIMILARITY = 0.75
HISTOGRAM = 256
#: Classes of a chunk of a bucket, and of a tile of texts to be aligned, on average at most; pairs compared at once.
CHUNK, TILE, AT_ONCE = 2048, 128, 1 << 15
#: Rows of (class id, 16 bytes) that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df as a table in the shared folder; the shuffle files that made it go at once, not when the driver
    happens to collect its garbage. The setting holds for queries made under it, hence the select."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        return common.written(df.select("*"), what)
    finally:
        conf.unset(_FREE) if before is None else conf.set(_FREE, before)


def _order_min_hash(grams: np.ndarray, counts: np.ndarray, hashes: int, ell: int, salt: int) -> np.ndarray:
    """(texts x hashes) keys of the ell least occurrence-labelled k-mers in text order; 0 where a text has none."""
    out = np.zeros((len(counts), hashes), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    counts = counts[some]
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    with np.errstate(over="ignore"):
        same = mix(grams + mix(doc.astype(np.uint64), salt))
        order = np.argsort(same, kind="stable")
        s = same[order]
        run = np.concatenate([[True], s[1:] != s[:-1]])
        at = np.arange(len(s))
        number = np.empty(len(s), np.uint64)
        number[order] = at - np.maximum.accumulate(np.where(run, at, 0))
        base = mix(grams + number * np.uint64(0x9E3779B97F4A7C15), salt)
        for j in range(hashes):
            v = mix(base, (salt + j + 1) * 0xD6E8FEB86659FD93)
            picked = []
            for e in range(ell):
                low = np.minimum.reduceat(v, first)
                hit = np.flatnonzero(v == low[doc])
                hit = hit[np.concatenate([[True], doc[hit[1:]] != doc[hit[:-1]]])]  # the first of equal ones
                picked.append(np.where(low == _NONE, len(v), hit))  # no further k-mer
                v[hit] = _NONE
            places = np.sort(np.stack(picked, 1), axis=1)
            kmers = np.concatenate([base, [np.uint64(7)]])
            key = np.full(len(counts), salt + j, np.uint64)
            for e in range(ell):
                key = mix(key * np.uint64(31) + kmers[places[:, e]])
            out[some, j] = key
    return out


def sketch(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(bucket keys, number of words, word histogram) of each text. Texts of up to 24 words also get keys of single words."""
    words, n = word_hashes(texts)
    doc = np.repeat(np.arange(len(n)), n)
    histogram = np.bincount(doc * HISTOGRAM + (words & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=len(n) * HISTOGRAM).reshape(len(n), HISTOGRAM)
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        grams = words.copy()
        for k in range(1, K):
            grams[:-k] = grams[:-k] * np.uint64(0x100000001B3) + words[k:]
    inside = np.arange(len(words)) + K <= ends[doc]
    keys = _order_min_hash(grams[inside], np.maximum(n - K + 1, 0), HASHES, ELL, 1)
    short = n <= SHORT
    few = _order_min_hash(words[short[doc]], n[short], SHORT_HASHES, ELL + 1, 1000)
    out = [row for row in keys]
    for row, i in zip(few, np.flatnonzero(short)):
        out[i] = np.concatenate([keys[i][: HASHES * int(n[i] >= K)], row]) if n[i] else row[:1]
    return out, n, np.minimum(histogram, 255).astype(np.uint8)


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most `most`: bit-parallel alignment in a band that doubles up to it."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    s = 0
    while s < len(b) and a[s] == b[s]:
        s += 1
    e = 0
    while e < len(b) - s and a[len(a) - 1 - e] == b[len(b) - 1 - e]:
        e += 1
    a, b = a[s : len(a) - e], b[s : len(b) - e]
    if not b:
        return len(a) if len(a) <= most else None
    left: dict = {}
    for x in a:
        left[x] = left.get(x, 0) + 1
    common = 0
    for x in b:
        if left.get(x, 0):
            left[x] -= 1
            common += 1
    if len(a) - common > most:
        return None
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    band = max(8, len(a) - len(b))
    while True:
        band = min(band, most, len(a))
        d = _banded(places, len(a), b, band)
        if d is not None or band >= min(most, len(a)):
            return d if d is not None and d <= most else None
        band *= 4


def _banded(places: dict, m: int, b: list, t: int) -> int | None:
    """Distance if at most t, looking only at cells at most t off the diagonal; columns are integers of 2t + 1 bits."""
    width = 2 * t + 1
    ones = (1 << width) - 1
    vp, vn, dist = ones & ~((1 << width - t - 1) - 1), 0, t
    top, start, stop = 1 << width - 1, t + 1 - width, 2 * t + len(b) - m
    last = 1 << width - 2 if width > 1 else 0
    for i, x in enumerate(b):
        eq = places.get(x, 0)
        eq = (eq >> start if start >= 0 else eq << -start) & ones
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & ones
        hp, hn = vn | (ones & ~(d0 | vp)), d0 & vp
        if i < m - t:
            dist += not d0 & top
        else:
            dist += bool(hp & last) - bool(hn & last)
            last >>= 1
        if dist > stop:
            return None
        vp, vn = hn | (ones & ~(d0 >> 1 | hp)), d0 >> 1 & hp
        start += 1
    return dist if dist <= t else None


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length, over words, is at least `least`."""
    return _near(a.split(), b.split(), least)


#: Words to pass over on both sides where a greedy alignment meets a difference, cheapest first.
_SHIFTS = sorted(((x, y) for x in range(7) for y in range(7) if x or y), key=lambda s: (max(s), s[0] != s[1], s))


def _greedy(a: list, b: list, most: int) -> bool:
    """Whether a greedy alignment, an upper bound of the distance, has at most `most` edits; False decides nothing."""
    i = j = d = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for x, y in _SHIFTS:
            if a[i + x : i + x + 2] == b[j + y : j + y + 2]:
                break
        else:
            x = y = 1
        i, j, d = i + x, j + y, d + max(x, y)
        if d > most:
            return False
    return d + max(0, len(a) - i) + max(0, len(b) - j) <= most


def _near(x: list, y: list, least: float) -> bool:
    most = int((1 - least) * max(len(x), len(y)) + 1e-9)
    return _greedy(x, y, most) or edit_distance(x, y, most) is not None


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component."""
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = written(small.filter("a != b").distinct(), "small-star")
        done = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        discard(edges, large)
        if done:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = new


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The rows of a list column as a matrix, filled with 0."""
    at = lists.offsets.to_numpy()
    n = np.diff(at)
    out = np.zeros((len(n), int(n.max(initial=1))), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], n)] = lists.values.to_numpy()[at[0] : at[-1]]
    return out


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A written row per distinct text (cls, least id, copies, n_words, histogram, keys), and (id, cls) of every row.

    Each hash function has its place in keys; 0 stands where a text has no key."""
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", _class_of(F.col("text")).alias("cls"), "text")
    none = np.zeros(HASHES, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, n, hist = [], [], []
            for part in chunks(b.column(2).to_pylist()):
                k, w, h = sketch(part)
                keys += [x if c >= K else np.concatenate([none, x]) if c else np.ones(1, np.uint64) for x, c in zip(k, w.tolist())]
                n.append(w)
                hist += [x.tobytes() for x in h]
            flat = pa.array(np.concatenate(keys).view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n)), pa.array(hist, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], names=["id", "cls", "n_words", "histogram", "keys"])

    made = rows.mapInArrow(run, f"id {kind}, cls binary, n_words long, histogram binary, keys array<long>")
    made = written(made, "sketches")
    one = made.groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("histogram").alias("histogram"), F.first("keys").alias("keys"))
    one, members = written(one, "classes"), written(made.select("id", "cls"), "members")
    discard(made)
    return one, members


def _shared(one: DataFrame) -> DataFrame:
    """(key, cls, place, n, leader, same) of the buckets of n > 1 classes; place is that of the key's hash function, leader
    the least class, same 128 bits that tell sets of classes apart. Keys travel once, to be counted and kept; the rows of a
    bucket wait for their number on disk if there are many."""
    keys = one.select("cls", F.posexplode("keys").alias("place", "key")).filter("key <> 0")
    bucket = Window.partitionBy("key")
    some = keys.withColumn("n", F.count("*").over(bucket)).filter("n > 1")
    same = [F.bit_xor(F.xxhash64("cls", F.lit(salt))).over(bucket) for salt in (1, 2)]
    return some.select("key", "cls", "place", "n", F.min("cls").over(bucket).alias("leader"), F.struct(same[0].alias("x"), same[1].alias("y")).alias("same"))


def _first_of_same(buckets: DataFrame) -> DataFrame:
    """The buckets without those whose classes are all of an earlier one's, and no others: every pair has met there. The
    buckets of a class tell, so each of their classes finds the same."""
    place = F.row_number().over(Window.partitionBy("cls", "n", "same").orderBy("place", "key"))
    return buckets.select("key", "cls", "place", "n", "same").repartition("cls").withColumn("_nth", place).filter("_nth = 1").drop("_nth", "same")


def _most(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Edits that two texts of n and m words may have."""
    return np.floor((1 - least) * np.maximum(n, m) + 1e-9)


def _bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower bounds of the edit distances by word histograms."""
    d = x.astype(np.int16) - y
    up = np.maximum(d, 0).sum(1, dtype=np.int64)
    return np.maximum(up, up - d.sum(1, dtype=np.int64))


def _names(x: np.ndarray) -> pa.Array:
    """Classes, given as two big-endian numbers, as binary values."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(-1, 2)


def _leaders(buckets: DataFrame) -> DataFrame:
    """(cls, leader, tile) of every class that isn't least in all its buckets, as a written table. The leader is the class
    that is least in most of them; classes of one leader make tiles of TILE on average at most."""
    pick = buckets.filter("cls <> leader").groupBy("cls", "leader").agg(F.count("*").alias("n"))
    pick = pick.groupBy("cls").agg(F.max(F.struct("n", "leader")).alias("x")).select("cls", "x.leader")
    size = pick.groupBy("leader").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    return written(pick.join(size, "leader").select("cls", "leader", _tile("leader", F.pmod(F.xxhash64("cls"), F.col("tiles"))).alias("tile")), "leaders")


def _tile(leader, part):
    return F.xxhash64(leader, part.cast("long"))


def _can_link(pairs: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """The pairs (unit, a, b) whose lengths and histograms allow the similarity."""
    side = lambda s: met.select(F.col("cls").alias(s), F.col("n_words").alias(f"n_{s}"), F.col("histogram").alias(f"h_{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("unit", "a", "b", "n_a", "n_b", "h_a", "h_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, HISTOGRAM) for c in (5, 6))
            n, m = b.column(3).to_numpy(), b.column(4).to_numpy()
            can = np.maximum(_bound(x, y), np.abs(n - m)) <= _most(n, m, least)
            yield b.select(["unit", "a", "b"]).filter(pa.array(can))

    return rows.mapInArrow(run, "unit long, a binary, b binary")


class _Block:
    """The columns of rows of whole cells, ready to be compared."""

    def __init__(self, t: pa.Table):
        self.cells = np.stack([t.column(c).to_numpy() for c in range(3)], 1)
        self.own, self.n, self.d, self.tile = (t.column(c).to_numpy() for c in (3, 4, 5, 6))
        self.cls, self.home = _numbers(t.column(7)), _numbers(t.column(8))
        self.hist = np.frombuffer(b"".join(t.column(9).to_pylist()), np.uint8).reshape(-1, HISTOGRAM)
        self.keys = _matrix(t.column(10).combine_chunks())

    def compare(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(undecided pairs of rows, links of each row that need no alignment).

        A pair counts in the bucket of its first common key alone. The distances of two texts to one leader bound theirs
        from both sides; the bounds of lengths and histograms come next, and what they leave is undecided."""
        cells = self.cells
        new = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(1)]))
        end = np.repeat(np.concatenate([new[1:], [len(cells)]]), np.diff(np.concatenate([new, [len(cells)]])))
        count = end - np.arange(len(cells)) - 1
        total, out, links, s = np.concatenate([[0], np.cumsum(count)]), [np.zeros((0, 2), np.int64)], np.zeros(len(cells), np.int64), 0
        while s < len(cells):
            e = max(s + 1, int(np.searchsorted(total, total[s] + AT_ONCE, side="right")) - 1)
            p = np.repeat(np.arange(s, e), count[s:e])
            q = p + 1 + np.arange(len(p)) - np.repeat(total[s:e] - total[s], count[s:e])
            s = e
            met = (cells[p, 1] == cells[p, 2]) | (self.own[p] != self.own[q])  # those of one chunk meet in its own cell
            p, q = p[met], q[met]
            most = _most(self.n[p], self.n[q], least)
            can = np.abs(self.n[p] - self.n[q]) <= most
            p, q, most = p[can], q[can], most[can]
            x = self.keys[p]  # those before the bucket's own
            first = ~((x == self.keys[q]) & (x != 0)).any(1)
            p, q, most = p[first], q[first], most[first]
            one = (self.home[p] == self.home[q]).all(1)
            near = one & (self.d[p] + self.d[q] <= most)
            links += np.bincount(p[near], minlength=len(links)) + np.bincount(q[near], minlength=len(links))
            can = ~near & ~(one & (np.abs(self.d[p] - self.d[q]) > most))
            p, q, most = p[can], q[can], most[can]
            can = _bound(self.hist[p], self.hist[q]) <= most
            p, q = p[can], q[can]
            swap = (self.cls[p, 0] > self.cls[q, 0]) | ((self.cls[p, 0] == self.cls[q, 0]) & (self.cls[p, 1] > self.cls[q, 1]))
            out.append(np.stack([np.where(swap, q, p), np.where(swap, p, q)], 1))
        return np.concatenate(out), links


def _compared(buckets: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """A written table of all classes of a bucket compared with all: undecided pairs (a, b, their tiles), each once, and
    rows (a, links) of links that need no alignment. Chunks i and j of a bucket meet in cell (i, j). A row takes along the
    keys before its bucket's own alone, which tell whether the bucket is that of a pair's first common key."""
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = _first_of_same(buckets).withColumn("own", F.pmod(F.xxhash64("cls"), parts).cast("int")).join(met, "cls")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    long = lambda c: F.col(c).cast("long")
    rows = rows.select("key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), long("own"), "n_words", long("d"), "tile", "cls", "home", "histogram", F.slice("keys", F.lit(1), F.col("place")).alias("keys"))
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["a", "b", "t_a", "t_b", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            block = _Block(t)
            pairs, links = block.compare(least)
            for at in range(0, len(pairs), AT_ONCE):
                a, b = pairs[at : at + AT_ONCE].T
                yield pa.RecordBatch.from_arrays([_names(block.cls[a]), _names(block.cls[b]), pa.array(block.tile[a]), pa.array(block.tile[b]), pa.nulls(len(a), pa.int64())], names=names)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([_names(block.cls[some]), *(pa.nulls(len(some), k) for k in kinds[1:4]), pa.array(links[some])], names=names)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            cells = np.stack([t.column(c).to_numpy() for c in range(3)], 1)
            other = np.flatnonzero((cells != cells[-1:]).any(1)) if len(cells) else np.zeros(0, np.int64)
            whole = int(other[-1]) + 1 if len(other) else 0  # the last cell may go on
            if whole:
                yield from compare(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield from compare(rest)

    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(rows.mapInArrow(run, "a binary, b binary, t_a long, t_b long, links long"), "compared")


def _class_of(text):
    """16 bytes of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, text) of the classes in ids (cls and its id), as a written table. docs: id and text."""
    need = ids.select("cls", F.col("id").alias("_of"))
    n = need.count()
    side = F.broadcast(need) if n <= BROADCAST_ROWS else need
    texts = docs.join(side, F.col("id").eqNullSafe(F.col("_of"))).filter(_class_of(F.col("text")) == F.col("cls"))
    texts = written(texts.select("cls", "text"), "texts")
    if texts.count() == n:
        return texts
    once = written(texts.dropDuplicates(["cls"]), "texts-once")  # rows repeat
    discard(texts)
    return once


def _aligned(pairs: DataFrame, texts: DataFrame, least: float, exact: bool) -> DataFrame:
    """(a, b, d) of the pairs (unit, a, b) whose texts are similar, as a written table; d is the edit distance if exact.

    A text goes once to each unit that it has a pair in."""
    places = pairs.select("unit", F.explode(F.array("a", "b")).alias("cls")).distinct()
    rows = places.join(texts, "cls").select("unit", F.col("cls").alias("a"), F.lit(None).cast("binary").alias("b"), "text")
    rows = rows.unionByName(pairs.select("unit", "a", "b", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, words = None, {}
        for batch in batches:
            out = []
            for u, a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit:
                    unit, words = u, {}
                if b is None:
                    words[a] = text.split()
                elif exact:
                    x, y = words[a], words[b]
                    d = edit_distance(x, y, int((1 - least) * max(len(x), len(y)) + 1e-9))
                    if d is not None:
                        out.append((a, b, d))
                elif _near(words[a], words[b], least):
                    out.append((a, b, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "d"])

    rows = rows.repartition("unit").sortWithinPartitions("unit", F.col("b").isNotNull())
    return written(rows.mapInArrow(run, "a binary, b binary, d long"), "links")


def _links(one: DataFrame, docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b) of links that join all classes that verified links join, (cls, n_links) of all verified links, and (cls, id,
    n_copies) of all classes. The table of the classes is deleted when its keys and histograms have been read."""
    buckets = written(_shared(one), "buckets")
    lead = _leaders(buckets)
    met = written(one.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "id", "n_words", "histogram", "keys"), "met")
    info = written(one.select("cls", "id", F.col("copies").alias("n_copies")), "info")
    discard(one)
    texts = _texts(docs, met)
    to_leader = _can_link(lead.select(F.col("tile").alias("unit"), F.col("leader").alias("a"), F.col("cls").alias("b")), met, least)
    to_leader = written(to_leader, "to-leader")
    first = _aligned(to_leader, texts, least, exact=True)
    known = met.drop("id").join(lead.select("cls", "tile"), "cls", "left").join(first.select(F.col("b").alias("cls"), F.col("a").alias("home"), "d"), "cls", "left")
    known = known.select("cls", "n_words", "histogram", "keys", F.coalesce("home", "cls").alias("home"), F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("tile", _tile("cls", F.lit(0))).alias("tile"))
    compared = _compared(buckets, known, least)
    rest = compared.filter("b is not null").select(F.xxhash64(F.least("t_a", "t_b"), F.greatest("t_a", "t_b")).alias("unit"), "a", "b")
    more = _aligned(rest, texts, least, exact=False)
    count = compared.filter("b is null").select(F.col("a").alias("cls"), "links").unionByName(more.select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).cast("long").alias("links")))
    count = written(count.groupBy("cls").agg(F.sum("links").alias("n_links")), "link-counts")
    edges = written(first.select("a", "b").unionByName(more.select("a", "b")), "all-links")
    discard(buckets, lead, met, texts, to_leader, first, compared, more)
    return edges, count, info


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of its class), n_links (other texts that share a sketch key with its text and
    are similar to it, all verified), n_copies (rows with its text).

    See `classified`, which adds the text's class and whether that class's rows with class_id stay."""
    return classified(docs, id_col, text_col, least).drop("cls", "keep")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all columns, that stay: one of each class, that with the least id.

    What goes is joined away by id and text class; the list of it is broadcast only if it has at most BROADCAST_ROWS rows.
    """
    rows = written(classified(docs, id_col, text_col, least).groupBy("doc_id", "cls").agg(F.count("*").alias("n"), F.first(F.col("keep") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays")), "kept")
    gone = rows.filter(~F.col("stays")).select(F.col("doc_id").alias("_gone_id"), F.col("cls").alias("_gone_cls"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    cls = _class_of(text_or_empty(text_col))
    stay = docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone_id")) & (cls == F.col("_gone_cls")), "left_anti")
    again = rows.filter("stays and n > 1").select(F.col("doc_id").alias("_gone_id"), F.col("cls").alias("_gone_cls"))
    if again.isEmpty():
        return stay
    where = stay[id_col].eqNullSafe(F.col("_gone_id")) & (cls == F.col("_gone_cls"))
    once = stay.join(again, where, "left_semi").withColumn("_cls", cls).dropDuplicates([id_col, "_cls"]).drop("_cls")
    return stay.join(again, where, "left_anti").unionByName(once)


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, cls (16 bytes of its text's hash), class_id, keep, n_links, n_copies.

    One row per row of docs. Null texts count as empty, and all empty texts are copies of each other; null ids are
    never the least unless all of a class are null; repeated rows are copies; texts without words are compared whole.
    Other columns are ignored and an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    one, members = classes(texts)
    edges, count, info = _links(one, texts, least)
    roots = components(edges)
    discard(edges)
    info = info.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(count, "cls", "left")
    best = info.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "cls")).alias("best"))
    info = info.join(best, "root").select("cls", F.col("best.id").alias("class_id"), (F.col("best.cls") == F.col("cls")).alias("keep"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return members.join(info, "cls").select(F.col("id").cast(kind).alias("doc_id"), "cls", "class_id", "keep", "n_links", "n_copies")
