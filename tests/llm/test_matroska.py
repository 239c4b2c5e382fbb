import hashlib
import random
import zlib

import pytest

from tessera.llm import matroska as m

SCHEMA = "doc_id long, text string, feature string"


@pytest.mark.parametrize("n", [192, 384, 768, 960, 768 * 2, 768 * 7 + 192, 768 * 8, 768 * 8 * 32, 768 * 8 * 32 + 192, 768 * 8 * 70 + 576])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = m.mux_pcm(payload)
    movie = m.parse(media)
    assert m.samples_of(media, movie) == payload
    assert [t for _, t, _, _, _ in movie.packets] == [i * 96_000_000 for i in range(len(movie.packets))]
    assert len(movie.cues) == len(movie.clusters) and movie.tracks == {1: {"type": 2, "codec": "A_PCM/INT/LIT", "duration": 96_000_000}}
    for (_, _, p), c in zip(movie.cues, movie.clusters):
        assert media[p : p + 4] == b"\x1f\x43\xb6\x75" and p < c


@pytest.mark.parametrize("mode,lace", [(1, m.lace_xiph), (3, m.lace_ebml)])
def test_lacing(mode, lace):
    rng = random.Random(mode)
    for _ in range(200):
        sizes = [rng.choice([rng.randint(0, 300), rng.randint(0, 70_000)]) for _ in range(rng.randint(2, 9))]
        data = bytes([len(sizes) - 1]) + lace(sizes) + b"x" * sum(sizes)
        got, at = m.lace_sizes(data, 0, len(data), mode)
        assert got == sizes and len(data) - at == sum(sizes)


def test_unknown_sizes_and_block_groups():
    block = b"\x81\x00\x05\x00abc"
    cluster = b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + m.uint(m.TIMESTAMP, 7) + m.element(0xEC, b"void") + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block))
    data = m.element(m.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + cluster + cluster + m.element(m.CUES, b"")
    movie = m.parse(data)
    assert [(t, time, data[p : p + n]) for t, time, p, n, _ in movie.packets] == [(1, 12_000_000, b"abc")] * 2


def test_vint():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**40):
        assert m.read_vint(m.write_size(n), 0)[:2] == (n, len(m.write_size(n)))
    with pytest.raises(ValueError):
        m.read_vint(b"\x00", 0)


def test_packets(spark):
    good = m.mux_pcm(b"ab" * 960)
    rows = [(1, good, "x"), (2, None, "x"), (3, b"", "x"), (4, good[:-300], "x"), (None, good, "x"), (1, good, "x")]
    got = m.packets(spark.createDataFrame(rows, "id long, media binary, track string")).collect()
    assert sum(r.id == 1 for r in got) == 6 and sum(r.id is None for r in got) == 3
    assert [(r.track, r.codec, r.n, r.time_ns, r.size, r.indexed) for r in got if r.id is None] == [(1, "A_PCM/INT/LIT", i, i * 96_000_000, s, True) for i, s in enumerate((768, 768, 384))]
    assert b"".join(good[r.position : r.position + r.size] for r in got if r.id is None) == b"ab" * 960
    assert [r.error is not None for r in got if r.id == 4] == [True]


def test_store_texts(spark):
    texts = ["", None, "hello", "é" * 96, "x" * 400_000, "hello"]
    got = m.store_texts(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(m.mux_pcm(payload)).hexdigest()
    assert got[2][1:] == got[5][1:] and got[0][1:] == got[1][1:]
    assert m.store_texts(spark.createDataFrame([], SCHEMA)).count() == 0
