import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import SegmentTree, cut, pack, plan_best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sequence_id string"


def best_fit_one_by_one(lengths, capacity):
    """Rooms of the bins after placing piece by piece; tightest bin by looking at all."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return rooms


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
    fill, seen = {}, Counter()
    for length, rank, items, per, first, offset in plan_best_fit(Counter(lengths), capacity):
        assert rank == seen[length]
        seen[length] += items
        for j in range(items):
            assert fill.get(first + j // per, 0) == offset + length * (j % per)
            fill[first + j // per] = fill.get(first + j // per, 0) + length
    assert seen == Counter(lengths)
    assert Counter(capacity - x for x in fill.values()) == Counter(best_fit_one_by_one(lengths, capacity))


def test_segment_tree():
    tree = SegmentTree(10)
    assert tree.tightest(0) is None
    for r in (3, 7):
        tree.add(r, 2)
    assert [tree.tightest(r) for r in (0, 3, 4, 7, 8)] == [3, 3, 7, 7, None]


def test_cut():
    assert list(cut(5, 4)) == [(0, 1), (1, 4)] and list(cut(8, 4)) == [(0, 4), (4, 4)] and list(cut(4, 4)) == [(0, 4)] and list(cut(1, 4)) == [(0, 1)]


TEXTS = ["", None, "a", "Hello  world \n x", "the cat " * 900, "the cat " * 900, "é ñ ü 漢字 かな 🙂 <|endoftext|> don't", "x" * 5000, " lead", "trail ", "tab\tin side", "a b  c", "1234 5678,9"]


def test_pack_against_the_tokenizer(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(2, "a", "again"), (None, "no id", "x")]
    got = pack(spark.createDataFrame(rows, SCHEMA), PATH, capacity=64).collect()
    t, want = Tokenizer.from_file(PATH), Counter()
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 64 if len(ids) > 64 else len(ids)
        cuts = [0, *([head] if head else []), *range(head + 64, len(ids) + 1, 64)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64 and len(at) == len(best_fit_one_by_one([r.length for r in got], 64))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
