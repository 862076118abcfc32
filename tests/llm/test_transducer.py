"""Byte-level BPE by the lazily determinised transducer against the library, and the streaming decoder against the codec."""

import gc
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mercato.llm import transducer
from mercato.llm.queries import op11_byte_level_bpe

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string"
rnd = random.Random(11)


@pytest.fixture(scope="module")
def ranks():
    return transducer.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return transducer.Encoder(ranks, tokenizers.PATTERN)


def odd_texts(ranks):
    names = list(ranks)
    yield from ("", " ", "\n\n  a", "don't I'll 123 45", "\x1c\x1d\x85  x", "a\x00b", "<|endoftext|>", "ａｂｃ", "é")
    yield from (ch * n for ch in (" ", "a", "\n", "=", "é", "中", "\U0001f600") for n in (1, 2, 31, 700))
    for _ in range(3000):
        yield b"".join(rnd.choice(names) for _ in range(rnd.randint(1, 12))).decode("utf-8", "replace")
        yield "".join(rnd.choice("ab aAeé中\n\t '") for _ in range(rnd.randint(1, 60)))


def test_equals_the_library(ranks, library, encoder):
    for text in odd_texts(ranks):
        assert list(encoder.ids(text)) == library.encode_ordinary(text), text


def test_every_kind_of_character(library, encoder):
    for c in range(0, 0x110000, 13):
        if not 0xD800 <= c < 0xE000:
            ch = chr(c)
            text = f"a{ch}1{ch} {ch}a {ch}{ch}!{ch}"
            assert list(encoder.ids(text)) == library.encode_ordinary(text), hex(c)


def test_few_states_give_the_same(ranks, library):
    small = transducer.Encoder(ranks, tokenizers.PATTERN, most_states=50)
    for text in list(odd_texts(ranks))[:800]:
        assert list(small.ids(text)) == library.encode_ordinary(text)
        assert len(small.states) <= 51


def test_emits_within_one_token(ranks, encoder):
    """Whatever the input, the bytes read but not yet emitted are fewer than those of two longest tokens."""
    longest = max(map(len, ranks))
    for unit in (b"a", b" the", "中".encode(), b"=-"):
        state, emitted = encoder.start, []
        for n, byte in enumerate(unit * 200, 1):
            state, out = state[byte]
            emitted += out
            assert n - sum(len(encoder.merges.bytes_of[i]) for i in emitted) < 2 * longest


def test_neighbours_by_merging(encoder):
    """``fit`` says whether plain merging of both tokens' bytes gives the two tokens."""
    m = encoder.merges

    def merge(data):
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            joined = [m.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            if not joined or min(joined) == 1 << 40:
                return parts
            i = joined.index(min(joined))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(4000):
        a, b = rnd.choice(list(m.bytes_of)), rnd.choice(list(m.bytes_of))
        assert m.fit(a, b) == (merge(m.bytes_of[a] + m.bytes_of[b]) == [m.bytes_of[a], m.bytes_of[b]])


def test_unfit_files_are_refused():
    with pytest.raises(ValueError, match="byte"):
        transducer.Merges({b"a": 0})
    # "abc" stands before both of its halves, so that no merge in order makes it
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257}
    with pytest.raises(ValueError, match="rank order"):
        transducer.Merges(ranks).merged(b"abc")


def test_streaming_decoder_equals_the_codec(ranks):
    one = transducer.Decoder({i: bytes([i]) for i in range(256)})
    some = [0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(30_000):
        data = bytes(rnd.choice(some) for _ in range(rnd.randint(0, 9)))
        assert one.text(data) == data.decode("utf-8", "replace"), data
    whole = transducer.Decoder({i: t for t, i in ranks.items()})
    for _ in range(2000):
        ids = [rnd.randrange(len(ranks)) for _ in range(rnd.randint(0, 20))]
        assert whole.text(ids) == b"".join(whole.bytes_of[i] for i in ids).decode("utf-8", "replace")


def test_stream_gives_characters_as_they_are_complete():
    one = transducer.Decoder({i: bytes([i]) for i in range(256)})
    assert list(one.stream("aé中".encode())) == ["a", "", "é", "", "", "中"]
    assert list(one.stream("é".encode()[:1])) == ["", transducer.REPLACEMENT]


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "the same text"), (5, "the same text"), (None, "a null id"), (None, "another"),
         (6, "word and wörter 中文 " * 60_000), (7, "x" * 300_000), (8, "a\x00b <|endoftext|>")]


def test_table(spark, library):
    docs = spark.createDataFrame([(i, t, "en") for i, t in EDGES], DOCS).withColumns({c: F.lit("clash") for c in ("ids", "n_tokens", "decoded")})
    encoded = transducer.encode(docs, PATH, tokenizers.PATTERN)
    decoded = transducer.decode(encoded, PATH)
    got = {(r["doc_id"], r["text"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["n_tokens"]) for r in decoded.collect()}
    wanted = [library.encode_ordinary(t or "") for _, t in EDGES]
    assert got == {(i, t or "", tuple(ids), len(ids)) for (i, t), ids in zip(EDGES, wanted)}
    assert transducer.digests(decoded).count() == len(EDGES)
    # the given column text is replaced, the ids of a cut character end in a replacement character
    cut = spark.createDataFrame([(1, bytearray(b""), "old"), (2, None, "old"), (3, bytearray(np.array(library.encode_ordinary("é"), "<u4").tobytes()), "old")],
                                "doc_id long, ids binary, text string")
    assert [r["text"] for r in transducer.decode(cut, PATH).orderBy("doc_id").collect()] == ["", None, "é"]


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert transducer.digests(transducer.decode(transducer.encode(none, PATH, tokenizers.PATTERN), PATH)).collect() == []


def test_query_against_the_library(spark, library, duck):
    got = {r["doc_id"]: r for r in op11_byte_level_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert tuple(got[doc_id]) == (doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_pieces_met_lately_are_read_once(ranks, library):
    e = transducer.Encoder(ranks, tokenizers.PATTERN, most_pieces=3)
    read, plain = [], e.read
    e.read = lambda piece: read.append(piece) or plain(piece)
    for text in ("the the the", " one the the", " two three four the one", "z" * 60, "z" * 60, *list(odd_texts(ranks))[:300]):
        assert list(e.ids(text)) == library.encode_ordinary(text)
        assert len(e.known) <= 3 and len(e.known.older) <= 3
    assert read[:3] == ["the", " the", " one"] and read.count(" the") < 6 and read.count("z" * 60) == 2  # long ones are not held


def test_a_state_takes_little_memory(ranks):
    e = transducer.Encoder(ranks, tokenizers.PATTERN, most_pieces=1)
    texts = list(odd_texts(ranks))[:2500]
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for text in texts:
            e.ids(text)
        e.merges = None  # its edges are no part of the states
        held, states = tracemalloc.get_traced_memory()[0], len(e.states)
        assert states > 10_000 and held < 600 * states
        e._restart()  # all of them go at once, without a run of the garbage collector
        assert tracemalloc.get_traced_memory()[0] < 0.1 * held
    finally:
        tracemalloc.stop()
        gc.enable()


def test_classes_are_compared_in_little_memory():
    assert transducer.Pieces(tokenizers.PATTERN).exact  # what is loaded once is loaded
    tracemalloc.start()
    try:
        assert transducer.Pieces(tokenizers.PATTERN).exact
        assert tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()
