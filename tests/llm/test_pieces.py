import random

import public_tokenizers
import pytest
import sentencepiece
import sentencepiece.sentencepiece_model_pb2 as pb

from tessera.llm import pieces as p

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string"
TEXTS = ["", "a", " lead", "trail ", "two  spaces   here", "Hello, world!\nThe cat's été über 漢字かな 🙂 \t x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300, "1234567 +1 (942) 555-3818", "        " * 9, "internationalisation and re-entrant behaviour", "ñ ü ö ÀÉ Thblewh onanin"]


def random_texts(n):
    rng = random.Random(1)
    words = "the and tion er on an th re in ha é ü ß un ça 12 , . ! \n x".split(" ")
    return ["".join(rng.choice(words) + rng.choice(["", "", " ", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def unigram():
    """The same pieces as a unigram model, with scores of their order."""
    m = pb.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, x in enumerate(m.pieces):
        x.score = -8.0 - (i % 4096) / 256 if x.type == 1 else 0.0
    return m.SerializeToString()


def test_bpe_ids_are_the_library_s():
    mine, lib = p.Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in TEXTS + random_texts(300):
        got = mine.encode(t)
        assert memoryview(got).cast("I").tolist() == lib.encode(t) if got else lib.encode(t) == []
        assert mine.decode(got) == t


def test_unigram_ids_are_the_library_s(unigram):
    mine, lib = p.Pieces(proto=unigram), sentencepiece.SentencePieceProcessor(model_proto=unigram)
    for t in TEXTS + random_texts(300):
        got = mine.encode(t)
        assert memoryview(got).cast("I").tolist() == lib.encode(t) if got else lib.encode(t) == []


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_the_window_stays_bounded(kind, unigram):
    mine = p.Pieces(PATH) if kind == "bpe" else p.Pieces(proto=unigram)
    window = []
    text = "".join(random_texts(200)).replace(" ", p.SPACE)
    assert "".join(mine.segments(iter(text), window)) == text
    assert len(window) > len(text) / (8 * mine.longest) and max(window) <= 8 * mine.longest


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_every_id_comes_from_the_lattice(kind, unigram, monkeypatch):
    mine = p.Pieces(PATH) if kind == "bpe" else p.Pieces(proto=unigram)
    made, inner = {}, mine.segments
    monkeypatch.setattr(mine, "segments", lambda t, window=None: made.setdefault(t, list(inner(t, window))))
    lib = sentencepiece.SentencePieceProcessor(**({"model_file": PATH} if kind == "bpe" else {"model_proto": unigram}))
    for t in TEXTS + random_texts(200):
        words = p.WORD.findall((" " + t if t else t).replace(" ", p.SPACE))
        assert memoryview(mine.encode(t)).cast("I").tolist() == lib.encode(t) if t else True
        assert sum(len(mine.piece_ids(x)) for w in words for x in made[w]) == len(lib.encode(t))  # each from the lattice


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_a_million_characters(kind, unigram):
    """Streamed from an iterator and encoded at once: the library's ids, the window bounded however long the text."""
    mine = p.Pieces(PATH) if kind == "bpe" else p.Pieces(proto=unigram)
    lib = sentencepiece.SentencePieceProcessor(**({"model_file": PATH} if kind == "bpe" else {"model_proto": unigram}))
    rng = random.Random(5)
    for alphabet, n in (("etaoin shrdlu", 1_000_000), ("abcdefghij", 100_000)):
        text = "".join(rng.choices(alphabet, k=n))
        want, got = lib.encode(text), memoryview(mine.encode(text)).cast("I").tolist()
        if kind == "bpe":
            assert got == want
        else:  # the library sums 32-bit scores over the whole text
            assert mine.decode(mine.encode(text)) == text and sum(mine.scores[i] for i in got) >= sum(mine.scores[i] for i in want) - 1e-6
        window = []
        assert [i for x in mine.segments(iter((" " + text).replace(" ", p.SPACE)), window) for i in mine.piece_ids(x)] == got
        assert max(window) <= 8 * mine.longest
        assert b"".join(mine.stream(iter((" " + text).replace(" ", p.SPACE)))) == mine.encode(text)


def test_columns(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, *TEXTS, "has ▁ mark"])] + [(1, "", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = p.encode_texts(df, PATH)
    assert got.count() == len(rows) and [r.doc_id for r in got.filter("not round_trip").collect()] == [len(TEXTS) + 1]
    texts = {r.doc_id: r.text for r in p.decode_ids(got.filter("doc_id is not null and round_trip"), PATH).collect()}
    assert all(texts[i] == (t or "") for i, t, _ in rows if i in texts)
    assert p.encode_texts(df.limit(0), PATH).collect() == []
