"""Byte-level BPE by a finite-state transducer that is determinised while it reads, and a streaming decoder.

Merges.  A rank file gives the tokens in merge order.  Two tokens may stand side by
side in an encoding if no merge across their border comes before the merges that
build them.  In a file whose tokens all come about by their own merges, a sequence
of tokens is the encoding of its bytes just if all neighbours may stand side by side.

Encoding.  The nondeterministic transducer reads a byte at a time inside a prefix of
some token and may end the token where its bytes are complete, if it may follow the
token before.  A state of the deterministic one is the set of these readings: per
reading the bytes read since its last token and the tokens not yet emitted.  What all
readings agree on is emitted at once, so the lookahead is less than one token, the
longest of the file.  States and transitions are made when they are first needed.
What the transducer gave out for the short pieces met last is held (see ``_Known``).

Decoding.  Token ids are read one by one; an incremental UTF-8 machine gives out the
characters that are complete and keeps the bytes of one that is not.
"""

from __future__ import annotations

import base64
import marshal
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import ready, slices

_NEVER = 1 << 62
_unpacked = marshal.loads
REPLACEMENT = "�"


def _packed(readings: tuple) -> bytes:
    """Readings as one string of bytes, the same for equal ones (format 2 knows no references)."""
    return marshal.dumps(readings, 2)


class Merges:
    """Ranks of a ``.tiktoken`` file, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], most_listed: int = 8):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the file lacks some single byte")
        #: Beginning -> the longer tokens that begin so; None where there are more than ``most_listed``.
        self.longer: dict[bytes, list[int] | None] = {}
        for t, i in ranks.items():
            for n in range(1, len(t)):
                held = self.longer.setdefault(t[:n], [])
                if held is not None:
                    held.append(i)
                    if len(held) > most_listed:
                        self.longer[t[:n]] = None
        self._edges: dict[bytes, tuple] = {}
        self._risings: tuple[dict[int, tuple], dict[int, tuple]] = ({}, {})

    def merged(self, data: bytes) -> tuple[bytes, bytes] | None:
        """The last two parts whose merge makes ``data`` a token; None for a single byte."""
        parts = [data[i:i + 1] for i in range(len(data))]
        rank, before = self.ranks.get, -1
        while len(parts) > 2:
            joined = [rank(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            least = min(joined)
            if least == _NEVER or least < before:
                raise ValueError(f"{data!r} does not come about by merges in rank order")
            i, before = joined.index(least), least
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2 and self.ranks[data] < before:
            raise ValueError(f"{data!r} does not come about by merges in rank order")
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edges(self, token: bytes) -> tuple[list[bytes], list[bytes]]:
        """The tokens that stood at the left and at the right edge while ``token`` was merged, in order, itself last."""
        got = self._edges.get(token)
        if got is None:
            parts = self.merged(token)
            got = ([token], [token]) if parts is None else (self.edges(parts[0])[0] + [token], self.edges(parts[1])[1] + [token])
            self._edges[token] = got
        return got

    def _rising(self, token: int, side: int) -> tuple[list[bytes], list[int]]:
        """The tokens at one edge of a token, and the rank at which each goes into the next larger one."""
        edge = self.edges(self.bytes_of[token])[side]
        got = self._risings[side][token] = edge, [*map(self.ranks.__getitem__, edge[1:]), _NEVER]
        return got

    def fit(self, a: int | None, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``: no merge across the border comes first.  Any may come first of all."""
        if a is None:
            return True
        firsts, lasts = self._risings
        left, ups = lasts.get(a) or self._rising(a, 1)
        right, downs = firsts.get(b) or self._rising(b, 0)
        rank, i, j = self.ranks.get, 0, 0
        while True:
            x, y = ups[i], downs[j]
            across = rank(left[i] + right[j])
            if across is not None and across < x and across <= y:  # of equal ranks the leftmost merges first
                return False
            if x > y:
                j += 1
            elif x == _NEVER:  # and so is y
                return True
            else:
                i += 1


class _State:
    """A place in the transducer, to follow it byte by byte: ``state[byte]`` is (next state, tokens emitted)."""

    __slots__ = ("encoder", "readings")

    def __init__(self, encoder: Encoder, readings: bytes):
        self.encoder, self.readings = encoder, readings

    def __getitem__(self, byte: int) -> tuple[_State, tuple[int, ...]]:
        key, emitted = self.encoder.follow(self.readings, byte)
        return _State(self.encoder, key), emitted


class _Known(dict):
    """piece -> its ids as bytes, for the pieces of at most ``longest`` characters met last.

    ``most`` of them at least, twice as many at most: when ``most`` are held they
    become the older ones, which go when the next ``most`` are full unless they are
    met again.  A piece that is not held is read by the transducer.
    """

    __slots__ = ("encoder", "longest", "most", "older")

    def __init__(self, encoder: Encoder, most: int, longest: int = 48):
        super().__init__()
        self.encoder, self.most, self.longest = encoder, most, longest
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = self.encoder.read(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """``ids(text)`` encodes a text, each match of ``pattern`` separately.

    Holds at most ``most_states`` states and the ids of ``2 * most_pieces`` pieces.

    A reading is (bytes since its last token, tokens not yet emitted, tokens it may
    still become or None for all that fit).  The first of the tokens is the last one
    emitted, None if it makes no difference.  The last reading of a state has just
    ended a token.  States are numbers and their readings are packed, so that a state
    costs about half a KB of a worker and all of them go at once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_states: int = 150_000, most_pieces: int = 150_000):
        self.merges = Merges(ranks)
        self.pieces = Pieces(pattern)
        self.most_states = most_states
        self.known = _Known(self, most_pieces)
        self.states: dict[bytes, int] = {}  # packed readings -> number of the state
        self.readings: list[bytes] = []  # the way back
        self.moves: dict[int, int] = {}  # state << 8 | byte -> place in ``emissions`` << 32 | next state
        self.emissions: list[tuple[int, ...]] = []
        self._emission: dict[tuple[int, ...], int] = {}
        self._restart()
        self.start = _State(self, self.readings[0])

    def _restart(self) -> None:
        for held in (self.states, self.readings, self.moves, self.emissions, self._emission):
            held.clear()
        self._emission[()] = self._number(_packed(((b"", (None,), None),)))
        self.emissions.append(())

    def _number(self, key: bytes) -> int:
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = len(self.readings)
            self.readings.append(key)
        return got

    def _move(self, state: int, byte: int) -> int:
        """The entry of ``moves`` for a byte not yet read in this state."""
        key, emitted = self.follow(self.readings[state], byte)
        kept = key in self.states or len(self.states) < self.most_states
        if not kept:
            self._restart()  # the state left has no number any more
        place = self._emission.get(emitted)
        if place is None:
            place = self._emission[emitted] = len(self.emissions)
            self.emissions.append(emitted)
        got = place << 32 | self._number(key)
        if kept:
            self.moves[state << 8 | byte] = got
        return got

    def follow(self, key: bytes, byte: int) -> tuple[bytes, tuple[int, ...]]:
        """The packed readings after one more byte and the tokens that all of them agree on."""
        m, last = self.merges, bytes([byte])
        fit, ranks, longer = m.fit, m.ranks, m.longer
        grown, ended = [], None
        for w, out, may in _unpacked(key):
            w += last
            token = ranks.get(w)
            if token is not None and ended is None and (fit(out[-1], token) if may is None else token in may):
                ended = (b"", (*out, token), None)  # just one reading ends a token here
            if w in longer:
                rest = longer[w]
                if rest is not None:  # few enough: keep those that fit; none: the reading leads nowhere
                    rest = tuple([t for t in rest if (fit(out[-1], t) if may is None else t in may)])
                if rest is None or rest:
                    grown.append((w, out, rest))
        if ended is None:
            raise ValueError("no encoding: the merges of the file are not in rank order")
        grown.append(ended)
        agreed = 0
        for tokens in zip(*[out for _, out, _ in grown]):
            if tokens.count(tokens[0]) < len(tokens):
                break
            agreed += 1
        emitted = ended[1][1:agreed]
        # the last agreed token stays in front if what may follow depends on it
        front = ended[1][agreed - 1]
        if all([len(out) > agreed or may is not None for _, out, may in grown]):
            front = None
        return _packed(tuple([(w, (front, *out[agreed:]), may) for w, out, may in grown])), emitted

    def read(self, piece: str) -> bytes:
        """The ids of one piece, as the transducer emits them."""
        out, state = array("I"), 0
        put, moves, emissions = out.extend, self.moves.get, self.emissions
        for byte in piece.encode("utf-8", "surrogatepass"):
            move = moves(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move & 0xFFFFFFFF
            if move != state:
                put(emissions[move >> 32])
        put(_unpacked(self.readings[state])[-1][1][1:])
        return out.tobytes()

    def ids(self, text: str) -> array:
        out = array("I")
        for some in batched(self.pieces(text), 1 << 16):
            out.frombytes(b"".join(map(self.known.__getitem__, some)))
        return out


class Pieces:
    """The matches of a pre-tokenisation pattern, with the character classes of the installed library.

    Its ``\\s`` is White_Space, without the four ASCII separators, and its letters and
    numbers may be those of another Unicode version.  Below U+0530 all versions
    agree; the differences above are read off the library when first needed.
    """

    _AGREED = regex.compile("[\u0530-\U0010ffff]")

    def __init__(self, pattern: str):
        self.given = pattern
        self.plain = regex.compile(self._spaces(pattern))
        self._exact = None

    @staticmethod
    def _spaces(pattern: str) -> str:
        return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

    @property
    def exact(self) -> regex.Pattern:
        if self._exact is None:
            text = self._spaces(self.given)
            for name in (r"\p{L}", r"\p{N}"):
                less, more = map(_as_set, class_differences(name))
                wanted = f"[{name}--{less}]" if less else name
                text = text.replace(name, f"[{wanted}||{more}]" if more else wanted)
            self._exact = regex.compile(text, regex.V1)
        return self._exact

    def __call__(self, text: str) -> Iterable[str]:
        found = self.plain if text.isascii() or not self._AGREED.search(text) else self.exact
        return found.findall(text) if len(text) < 1_000_000 else (x[0] for x in found.finditer(text))


def _blocks() -> Iterator[str]:
    """Every character but the surrogates, in order, some thousands at a time."""
    for i in range(0, 0x110000, 4096):
        yield "".join([chr(c) for c in range(i, i + 4096) if not 0xD800 <= c < 0xE000])


def _as_set(chars: set[str]) -> str:
    """A set of characters in the pattern's syntax, as ranges; empty for none."""
    points = np.array(sorted(map(ord, chars)), np.int64)
    if not len(points):
        return ""
    cut = np.flatnonzero(np.diff(points) > 1)
    ends = zip(points[np.concatenate([[0], cut + 1])].tolist(), points[np.concatenate([cut, [len(points) - 1]])].tolist())
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends) + "]"


def class_differences(name: str) -> tuple[set[str], set[str]]:
    """The characters of a class such as ``\\p{L}`` that only ``regex`` finds, and those that only the tokenizer library finds."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    pattern, less, more = regex.compile(name), set(), set()
    for block in _blocks():
        ours, theirs = set(pattern.findall(block)), set(bytes(probe.encode_ordinary(block)).decode())
        less |= ours - theirs
        more |= theirs - ours
    return less, more


def _utf8_step(state: bytes, byte: int) -> tuple[str, bytes]:
    """(characters complete after ``byte``, bytes still open); a malformed run is one replacement character.

    ``state`` holds the open bytes, at most three.  The range of the second byte
    rules out overlong forms, surrogates and numbers above U+10FFFF.
    """
    if state:
        first = state[0]
        low, high = 0x80, 0xBF
        if len(state) == 1:
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, high)
        if not low <= byte <= high:
            text, state = _utf8_step(b"", byte)
            return REPLACEMENT + text, state
        whole = state + bytes([byte])
        size = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return (whole.decode(), b"") if len(whole) == size else ("", whole)
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else (REPLACEMENT, b"")


class _Open(dict):
    """id -> (characters, next machine state), for one set of open bytes; made when first needed."""

    __slots__ = ("decoder", "open")

    def __init__(self, decoder: Decoder, open_bytes: bytes):
        super().__init__()
        self.decoder, self.open = decoder, open_bytes

    def __missing__(self, token: int) -> tuple[str, _Open]:
        state, text = self.open, []
        for byte in self.decoder.bytes_of[token]:
            done, state = _utf8_step(state, byte)
            text.append(done)
        got = "".join(text), self.decoder.state(state)
        if len(self) < self.decoder.most:
            self[token] = got
        return got


class Decoder:
    """Characters of a stream of ids.  There are at most some 70,000 sets of open bytes; ``most`` ids are kept for each."""

    def __init__(self, bytes_of: dict[int, bytes], most: int = 60_000):
        self.bytes_of, self.most = bytes_of, most
        self.states: dict[bytes, _Open] = {}
        self.start = self.state(b"")

    def state(self, open_bytes: bytes) -> _Open:
        got = self.states.get(open_bytes)
        if got is None:
            got = self.states[open_bytes] = _Open(self, open_bytes)
        return got

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The characters that each id completes; bytes open at the end are one replacement character."""
        state = self.start
        for i in ids:
            text, state = state[i]
            yield text
        if state.open:
            yield REPLACEMENT

    def text(self, ids: Iterable[int]) -> str:
        """The characters of ``stream``, joined."""
        state, out = self.start, []
        put = out.append
        for i in ids:
            text, state = state[i]
            put(text)
        if state.open:
            put(REPLACEMENT)
        return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker, file and pattern."""
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder({i: t for t, i in read_ranks(path).items()})


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` per input row; ``ids`` holds little-endian unsigned 32-bit ids.

    ``path`` names the rank file on every executor.  Null text counts as empty: no
    ids.  Whole texts of any length are read once, byte by byte, in slices that
    bound a worker's memory.  Repeated rows and null ids are encoded one by one,
    other columns are ignored, an empty table gives no row.  Nothing is shuffled.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in slices(batches, "text"):
            ids = [np.asarray(e.ids(x or ""), "<u4") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                ["doc_id", "n_tokens", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` and ``text``, the characters of its ``ids`` (a column ``text`` it has is replaced).

    Null ids give a null text, no ids an empty one.  Bytes that are no UTF-8, such as
    a list of ids cut inside a character, become U+FFFD.  Row by row, so repeated
    rows, null doc_ids and an empty table pass through.
    """
    ready(encoded.sparkSession)
    kept = encoded.drop("text")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(path)
        for b in slices(batches, "ids", 8_000_000):
            ids = b.column("ids").to_pylist()
            text = [None if x is None else d.text(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*names, "text"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: lowercase hex digests of the ids and of the decoded text's bytes."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
