"""Token counts by a compiled finite-state transducer.

The pre-tokeniser of a byte-level BPE file is compiled into a deterministic
transducer over character classes.  Its transitions emit "a token group starts
here" (before this character, before the previous one, or both); finishing a
group emits the group's token count, from a table compiled on demand from the
file's merges.  A slice of texts is laid out as one class string and cut into
chunks of equal length.  For every chunk the map *entry state -> exit state* is
computed for all states at once, an associative prefix scan composes the maps,
and each chunk then replays from its true entry state, all chunks side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mercato.llm.bpe import Bpe, compiled
from mercato.llm.common import ready, slices

# character classes: plain letter, the letters of contractions ('s 't 'm 'd, 're 've, 'll), digit, blank, other space,
# apostrophe, anything else, end of a text
LETTER, STMD, RV, ELL, E, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, END = range(11)
_LETTERS = (LETTER, STMD, RV, ELL, E)
# states: a group must start next; inside letters, digits, other; apostrophe that began a group, then r/v, then l;
# one blank that began a group; one other space; a longer run of space ending in a blank, in other space
START, IN_L, IN_N, IN_O, AP, AP_RV, AP_L, ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE = range(11)
HERE, BACK = 1, 2  # emitted: a group starts at this character; at the previous one


def _fresh(c: int) -> int:
    """State after a character that starts a group."""
    if c in _LETTERS:
        return IN_L
    return {NUMBER: IN_N, BLANK: ONE_BLANK, SPACE: ONE_SPACE, APOSTROPHE: AP, OTHER: IN_O, END: START}[c]


def _after_blank(c: int) -> int:
    """State after a visible character that a blank is attached to; an apostrophe is then no contraction."""
    return IN_O if c == APOSTROPHE else _fresh(c)


def _move(s: int, c: int) -> tuple[int, int]:
    """Next state and emission for one character."""
    if c == END:  # an open run of space is one group; a pending apostrophe and its letters are two
        return START, BACK if s in (AP_RV, AP_L) else 0
    if s == IN_L and c in _LETTERS or s == IN_N and c == NUMBER or s == IN_O and c in (OTHER, APOSTROPHE):
        return s, 0
    if s == AP:
        if c in (OTHER, APOSTROPHE):
            return IN_O, 0
        if c in (STMD, RV, ELL):
            return {STMD: START, RV: AP_RV, ELL: AP_L}[c], 0
    if s == AP_RV and c == E or s == AP_L and c == ELL:
        return START, 0
    if s in (AP_RV, AP_L):  # no contraction: the letter after the apostrophe began a word
        return (IN_L, BACK) if c in _LETTERS else (_fresh(c), BACK | HERE)
    if s in (ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE):
        if c in (BLANK, SPACE):
            return (RUN_BLANK if c == BLANK else RUN_SPACE), 0
        if s == ONE_BLANK:
            return _after_blank(c), 0
        if s == RUN_BLANK:  # the last blank belongs to what follows
            return _after_blank(c), BACK
        return _fresh(c), HERE | (BACK if s == RUN_SPACE else 0)
    return _fresh(c), HERE


STEP = np.array([[_move(s, c)[0] for c in range(11)] for s in range(11)], np.uint8)
EMIT = np.array([[_move(s, c)[1] for c in range(11)] for s in range(11)], np.uint8)
# one lookup for both: index state * 16 + class
_STEP16 = np.zeros((11, 16), np.uint8)
_STEP16[:, :11] = STEP * 16
_EMIT16 = np.zeros((11, 16), np.uint8)
_EMIT16[:, :11] = EMIT
_STEP16, _EMIT16 = _STEP16.ravel(), _EMIT16.ravel()


class _Classes:
    """Class of every code point, filled in as code points appear."""

    def __init__(self):
        self.of = np.full(0x110000, 255, np.uint8)
        self.kinds = [(regex.compile(r"\p{L}"), LETTER), (regex.compile(r"\p{N}"), NUMBER), (regex.compile(r"\s"), SPACE)]
        for chars, c in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", E), (" ", BLANK), ("'", APOSTROPHE)):
            self.of[[ord(x) for x in chars]] = c

    def __call__(self, points: np.ndarray) -> np.ndarray:
        got = self.of[points]
        if (got == 255).any():
            for p in np.unique(points[got == 255]):
                self.of[p] = next((c for r, c in self.kinds if r.match(chr(p))), OTHER)
            got = self.of[points]
        return got


def scan(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Emissions of the transducer along ``classes``, computed chunk by chunk in parallel."""
    n = -(-len(classes) // chunk)
    grid = np.full(n * chunk, END, np.uint8)
    grid[: len(classes)] = classes
    grid = np.ascontiguousarray(grid.reshape(n, chunk).T)  # a row holds one position of every chunk
    # 1. state map of each chunk, for all entry states
    maps = np.repeat((np.arange(11, dtype=np.uint8) * 16)[:, None], n, axis=1)
    for row in grid:
        maps = _STEP16[maps + row]
    maps = (maps >> 4).T  # (chunk, entry state) -> exit state
    # 2. prefix scan: maps[i] becomes the composition of maps 0..i
    step = 1
    while step < n:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8) * 16
    # 3. replay with the true entry states
    out = np.empty_like(grid)
    for i, row in enumerate(grid):
        at = state + row
        out[i], state = _EMIT16[at], _STEP16[at]
    return np.ascontiguousarray(out.T).ravel()[: len(classes)]


class _Counts(dict):
    """Group -> token count, compiled when first met; bounded, the rest are counted anew."""

    def __init__(self, bpe: Bpe, most: int = 400_000):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, group: str) -> int:
        n = len(self.bpe.encoding._encode_single_piece(group)) if group else 0
        if len(self) < self.most:
            self[group] = n
        return n


class Transducer:
    """Counts tokens of texts as the file's library does, special strings included."""

    def __init__(self, path: str):
        self.bpe = compiled(path)
        self.classes, self.counts = _Classes(), _Counts(self.bpe)

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            # a special string is one token and cuts the text
            pieces = self.bpe.special_re.split(text) if self.bpe.special_re else [text]
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        whole = "\0".join(parts) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.classes(points).copy()
        classes[ends] = END
        emitted = scan(classes)
        begins = (emitted & HERE).astype(bool)
        begins[:-1] |= (emitted[1:] & BACK).astype(bool)
        first = np.concatenate([[0], ends[:-1] + 1])
        begins[first] = True
        begins[ends] = True
        at = np.flatnonzero(begins)
        groups = [whole[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(whole)])]
        ends_at = np.searchsorted(at, ends)
        n = np.fromiter(map(self.counts.__getitem__, groups), np.int64, len(groups))
        n[ends_at] = 0  # the end marks themselves
        total = np.concatenate([[0], np.cumsum(n)])
        per_part = total[ends_at] - total[np.searchsorted(at, first)]
        return extra + np.bincount(np.asarray(owner), weights=per_part, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per input row; ``path`` names the tokenizer file on every executor.

    Null text counts as empty: 0 bytes, 0 tokens.  Texts of any length are
    scanned whole, in slices that bound a worker's memory.  Repeated rows are
    counted one by one, other columns are ignored, an empty table gives no row.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in slices(batches, "text"):
            texts = [x or "" for x in b.column("text").to_pylist()]
            n = t.count(texts)
            size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
