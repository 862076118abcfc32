"""Repeated passages: paragraph MinHash banding, exact Jaccard checks, removal clusters by components; exact runs at any position.

A paragraph is a line.  Equal paragraphs (same lower-cased words) share a key and
count as one text from then on.  Bands of MinHash values bring similar texts
together.  Within a bucket every text is checked against the bucket's hub, the
text that collides most, so near copies of one passage cost one check each.  What
a hub does not link may still be linked to other members: such pairs share a
difference from the hub, and only texts that share one of the first few of their
differences are compared (see ``differences``).  No link among the members is lost.

Besides, runs of words that occur twice or more are found across lines and from any
word on (see ``runs``).  A document is a (doc_id, text) pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import SPACE, materialize, ready, settle, slices
from mercato.llm.components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIXED = np.uint64(0xBF58476D1CE4E5B9)


def tune(threshold: float, recall: float, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose recall at ``threshold`` is at least ``recall`` with up to 64 values."""
    fit = []
    for rows in range(1, most_rows + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
        if bands * rows <= 64:
            fit.append((rows, bands))
    rows, bands = max(fit)
    return bands, rows


def paragraph_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def key_of(ws: list[bytes]) -> int:
    """Signed 64-bit key of a paragraph's words."""
    h = xxhash.xxh64_intdigest(b" ".join(ws))
    return h - (1 << 64) if h >> 63 else h


def signatures(paragraphs: list[list[bytes]], k: int, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) keys; every paragraph has at least ``k`` words."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for ws in paragraphs for w in ws), np.uint64)
    sizes = np.array([len(ws) for ws in paragraphs])
    ends = np.cumsum(sizes)
    odd = np.random.default_rng(3).integers(1, 1 << 62, k, np.uint64) * np.uint64(2) + np.uint64(1)
    x = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        x = (x ^ h[i:len(h) - k + 1 + i]) * odd[i]
        x ^= x >> np.uint64(31)
    inside = np.ones(len(h), bool)  # windows that do not run into the next paragraph
    for i in range(1, k):
        inside[ends - i] = False
    x = x[inside[: len(x)]]
    first = np.concatenate([[0], np.cumsum(sizes - k + 1)[:-1]])
    mult = np.random.default_rng(5).integers(1, 1 << 62, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(paragraphs), bands), np.uint64)
    for band in range(bands):
        v = np.full(len(paragraphs), band + 1, np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat(x * mult[band * rows + r], first)
            v = (v ^ least) * _MIXED
            v ^= v >> np.uint64(29)
        out[:, band] = v
    return out.view(np.int64)


def _paragraphs(text: str | None, min_words: int) -> Iterator[tuple[int, int, int, int, list[bytes]]]:
    """(number, start, end, words before, words) of each line with enough words; offsets in code points."""
    at, before = 0, 0
    for i, line in enumerate((text or "").split("\n")):
        ws = paragraph_words(line)
        if len(ws) >= min_words:
            yield i, at, at + len(line), before, ws
        at += len(line) + 1
        before += len(ws)


def occurrences(docs: DataFrame, min_words: int, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, doc_key, paragraph, start, end, word, n_words, key, bands`` of every paragraph of at least ``min_words`` words."""
    names = ["doc_id", "doc_key", "paragraph", "start", "end", "word", "n_words", "key", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found, held, n = [], [], 0
            for row, text in enumerate(b.column("text").to_pylist()):
                for i, start, end, word, ws in _paragraphs(text, min_words):
                    found.append((row, i, start, end, word, len(ws), key_of(ws)))
                    held.append(ws)
            if not found:
                continue
            at, para, start, end, word, n, key = zip(*found)
            sig = signatures(held, k, bands, rows)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(at)), b.column("doc_key").take(pa.array(at)), pa.array(para, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                pa.array(word, pa.int32()), pa.array(n, pa.int32()), pa.array(key, pa.int64()),
                pa.ListArray.from_arrays(np.arange(0, sig.size + 1, bands, dtype=np.int32), sig.ravel())], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text").mapInArrow(
        run, f"doc_id {id_type}, doc_key long, paragraph int, start int, end int, word int, n_words int, key long, bands array<long>")


def _sieve(keys: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """Bit array (bytes, low bit first) of fixed size holding every key; other keys pass it now and then, which only costs a later join."""
    two = F.explode(F.array(F.pmod("key", F.lit(bits)), F.pmod(F.shiftrightunsigned("key", 32), F.lit(bits))))
    at = keys.select(two.alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, CAST(pmod(at, 64) AS INT)) AS bit")
    out = np.zeros(bits // 64, np.int64)
    for r in at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # bits / 64 rows at most
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def _sieve_of(keys: DataFrame) -> np.ndarray:
    """A sieve with 16 bits or more for each of ``keys``, 16 MB at most."""
    return _sieve(keys, 1 << min(27, max(20, (16 * keys.count()).bit_length())))


def _held(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the sieve lets each signed key pass."""
    n, u = np.uint64(len(sieve) * 8), key.view(np.uint64)
    # pmod of a signed key equals the low bits, as the size is a power of two
    a, b = u & (n - np.uint64(1)), (u >> np.uint64(32)) & (n - np.uint64(1))
    return ((sieve[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (sieve[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _texts(docs: DataFrame, keys: DataFrame, min_words: int) -> DataFrame:
    """``key, words`` of the paragraphs with one of ``keys``, read in a second scan that leaves out the rest before any shuffle."""
    sieve = _sieve(keys)  # a fixed megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ws = [w for t in b.column("text").to_pylist() for *_, w in _paragraphs(t, min_words)]
            if not ws:
                continue
            key = np.array([key_of(w) for w in ws], np.int64)
            at = np.flatnonzero(_held(sieve, key))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array([b" ".join(ws[i]) for i in at], pa.binary())], ["key", "words"])

    found = docs.select("text").mapInArrow(run, "key long, words binary")
    return found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))


def shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    ws = text.split()
    n = min(k, len(ws))
    return set(zip(*(ws[i:] for i in range(n)))) if n else set()


def jaccard(a: bytes, b: bytes, k: int) -> float:
    """Similarity of the sets of ``k``-word shingles; shorter texts are one shingle."""
    x, y = shingles(a, k), shingles(b, k)
    return len(x & y) / len(x | y) if x or y else 1.0


def differences(x: set, hub: set, hub_key: int, threshold: float) -> list[int]:
    """Keys that two texts x, y of similarity ``threshold`` share if x is less similar than that to their hub.

    With D(x) the symmetric difference of x and the hub, D(x) and D(y) differ by
    the symmetric difference of x and y, which has at most (1 - t) / t * |x|
    shingles.  If x is far from the hub, D(x) and D(y) cannot be disjoint, so by the
    prefix principle they share one of their first (1 - t) / t * |x| + 1 elements in
    any common order.  Shingles that the hub lacks come first: they are the rarest.
    """
    most = int((1 - threshold) / threshold * len(x) + 1e-9) + 1
    added, gone = x - hub, hub - x
    out = sorted(xxhash.xxh64_intdigest(b" ".join(s), hub_key) for s in added)[:most]
    if len(out) < most:
        out += sorted(xxhash.xxh64_intdigest(b" ".join(s), hub_key ^ 1) for s in gone)[:most - len(out)]
    return out


def _checked(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b, similar, marks, d, n`` of the pairs ``a, b``: the first of the ``d`` differences of ``a`` from the hub ``b``, and its ``n`` shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices([batch], "wa", 1_000_000):
                similar, marks, d, n = [], [], [], []
                for b, wa, wb in zip(*(rows.column(c).to_pylist() for c in ("b", "wa", "wb"))):
                    x, y = shingles(wa, k), shingles(wb, k)
                    similar.append(len(x & y) >= threshold * len(x | y))
                    d.append(len(x ^ y))
                    n.append(len(x))
                    marks.append(np.array(differences(x, y, b % (1 << 64), threshold), np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("a"), rows.column("b"), pa.array(similar, pa.bool_()), pa.array(marks, pa.list_(pa.int64())),
                     pa.array(d, pa.int32()), pa.array(n, pa.int32())], ["a", "b", "similar", "marks", "d", "n"])

    both = (pairs.join(texts.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b"))
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, similar boolean, marks array<long>, d int, n int")


def window_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of all windows of ``n`` words from the words' hashes, built from windows of doubling length."""
    out, done, power, size = None, 0, h, 1
    while True:
        if n & size:
            out = power if out is None else _joined(out, power, done)
            done += size
        if done == n:
            return out
        power, size = _joined(power, power, size), 2 * size


def _joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Keys of windows ``a`` continued by the window of ``b`` that starts ``gap`` words later."""
    n = max(min(len(a), len(b) - gap), 0)
    x = (a[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[:n] >> np.uint64(32))
    x = (x + b[gap:gap + n]) * _MIXED
    return x ^ (x >> np.uint64(29))


def _anchors(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """For every window of ``n`` words the least key of its ``k``-word windows: equal windows have equal anchors."""
    x, width, size = window_keys(h, k), n - k + 1, 1
    least = x
    while 2 * size <= width:  # least over the next ``size`` keys
        least, size = np.minimum(least[:max(len(least) - size, 0)], least[size:]), 2 * size
    rest = width - size
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest and len(least) > rest else least[:max(len(least) - rest, 0)]


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_BLOCK = 1 << 15
_BASE = 0xD1342543DE82EF95
_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)
_LOW = np.frombuffer(bytes(range(256)).translate(_LOWER), np.uint8)
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)[_LOW]
_IS_WORD = ~np.isin(np.arange(256), list(SPACE.encode()))


class _Words:
    """The words of all texts of an Arrow column, from its bytes.

    ``data``: the bytes of all texts one after the other, ``texts``: where each begins
    (and where the last ends), ``starts, ends`` of the words in ``data``, ``first``:
    the number of each text's first word (and that of all words).
    """

    def __init__(self, column: pa.Array):
        column = pa.compute.fill_null(column, "").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        self.texts = offsets - offsets[0]
        word = _IS_WORD[self.data]
        border = np.zeros(len(word) + 1, bool)
        border[self.texts] = True
        apart = ~np.concatenate([[False], word, [False]])
        self.starts = np.flatnonzero(word & (apart[:-2] | border[:-1]))
        self.ends = np.flatnonzero(word & (apart[2:] | border[1:])) + 1
        self.first = np.searchsorted(self.starts, self.texts)

    def quick(self) -> np.ndarray:
        """A 64-bit hash of every word, A-Z lower-cased: differences of a running sum of byte values times powers."""
        before, after, factor = (np.empty(len(self.starts), np.uint64) for _ in range(3))
        total, up, down = np.zeros(1, np.uint64), _UP[:1], _DOWN[:1]
        sums = np.zeros(_BLOCK + 1, np.uint64)
        for at in range(0, len(self.data), _BLOCK):
            value = _VALUE[self.data[at:at + _BLOCK]]
            n = len(value)
            np.cumsum(value * _UP[:n], out=sums[1:n + 1])
            a, b = np.searchsorted(self.starts, [at, at + n])
            place = self.starts[a:b] - at
            before[a:b], factor[a:b] = total + up * sums[place], down * _DOWN[place]
            a, b = np.searchsorted(self.ends, [at, at + n], side="right")
            after[a:b] = total + up * sums[self.ends[a:b] - at]
            total, up, down = total + up * sums[n], up * _UP[-1], down * _DOWN[-1]
        h = (after - before) * factor
        h = (h ^ (h >> np.uint64(32))) * _MIXED
        return h ^ (h >> np.uint64(29))

    def hashes(self, wanted: np.ndarray) -> np.ndarray:
        """XXH64 of the words ``wanted`` (a mask), A-Z lower-cased; zero for the others."""
        at = np.flatnonzero(wanted)
        low = self.data.tobytes().translate(_LOWER)
        out = np.zeros(len(self.starts), np.uint64)
        out[at] = np.fromiter((xxhash.xxh64_intdigest(low[s:e]) for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist())), np.uint64, len(at))
        return out

    def windows(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per window of ``n`` words its anchor (see ``_anchors``), whether it lies within one text, and the number of its text."""
        x = _anchors(self.quick(), n, k)
        sizes = np.diff(self.first)
        text = np.repeat(np.arange(len(sizes)), sizes)[:len(x)]
        return x, np.arange(n, len(x) + n) <= self.first[text + 1], text

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before the places ``at`` of ``data``."""
        return at - np.searchsorted(np.flatnonzero((self.data & 0xC0) == 0x80), at)

    def breaks(self, at: np.ndarray) -> np.ndarray:
        """Line ends before the places ``at`` of ``data``."""
        return np.searchsorted(np.flatnonzero(self.data == 10), at)


def _repeated_anchors(docs: DataFrame, n: int, k: int) -> DataFrame:
    """``key`` of the anchors found at two places or more.

    One place spans ``n - k + 1`` windows in a row at most; neighbouring windows
    mostly share their anchor, so about one row per ``(n - k) / 2`` words is counted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            x, inside, text = _Words(b.column("text")).windows(n, k)
            at = np.flatnonzero(inside)
            x = x[at]
            first = np.flatnonzero(_stretches(x, at, text[at]))
            long = np.diff(np.append(first, len(x))) > n - k + 1  # a text that repeats itself at once
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[first], x[first[long]]]).view(np.int64))], ["key"])

    return docs.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def _stretches(x: np.ndarray, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the windows ``at`` begin a maximal stretch of windows in a row of one text with one anchor ``x``."""
    return np.concatenate([np.ones(min(len(at), 1), bool), (np.diff(at) != 1) | (x[1:] != x[:-1]) | (text[1:] != text[:-1])])


def _pieces(x: np.ndarray, at: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """Where intervals begin in ``at``: stretches, cut after ``most`` windows."""
    first = np.flatnonzero(_stretches(x, at, text))
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return np.flatnonzero(inside % most == 0)


def _intervals(docs: DataFrame, gone: DataFrame, anchors: DataFrame, n: int, k: int, most: int = 64) -> DataFrame:
    """``doc_id, doc_key, at, off, key, start, end, paragraph``: windows with one of ``anchors`` (and now and then others), by intervals.

    A row holds windows in a row that share their anchor, up to ``most``: ``at`` is the first
    one's place, the arrays hold each window's distance from it, key and offsets.  Equal
    passages fall into equal intervals but for their ends.  Windows within the word
    ranges ``gone`` of a document are left out.

    Only texts of documents that may have such ranges are shuffled to meet them.
    """
    sieve = _sieve_of(anchors)
    in_gone = _sieve_of(gone.select(F.col("doc_key").alias("key")))

    def cut(b: pa.RecordBatch, gone: list) -> Iterator[pa.RecordBatch]:
        words = _Words(b.column("text"))
        x, keep, text = words.windows(n, k)
        keep &= _held(sieve, x.view(np.int64))
        for row, spans in enumerate(gone):
            for span in spans or ():
                keep[words.first[row] + span["from"]:words.first[row] + max(span["to"] - n + 1, 0)] = False
        at = np.flatnonzero(keep)
        if not len(at):
            return
        text = text[at]
        used = np.zeros(len(words.starts) + 1, np.int32)
        used[at] += 1
        used[at + n] -= 1
        key = window_keys(words.hashes(np.cumsum(used[:-1]) > 0), n)[at].view(np.int64)
        begin = words.texts[text]
        start, end = (words.chars(p) - words.chars(begin) for p in (words.starts[at], words.ends[at + n - 1]))
        paragraph = words.breaks(words.starts[at]) - words.breaks(begin)
        first = _pieces(x[at], at, text, most)
        size = np.diff(np.append(first, len(at)))
        ends = pa.array(np.append(first, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(c, pa.int64() if c is key else pa.int32()))
                 for c in (at - np.repeat(at[first], size), key, start, end, paragraph)]
        row = text[first]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c).take(pa.array(row)) for c in ("doc_id", "doc_key")), pa.array(at[first] - words.first[row], pa.int32()), *lists],
            ["doc_id", "doc_key", "at", "off", "key", "start", "end", "paragraph"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            without = batch.filter(pa.array(~_held(in_gone, batch.column("doc_key").to_numpy())))
            for b in slices([without], "text", 1_000_000):
                yield from cut(b, [])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            yield from cut(b, b.column("gone").to_pylist())

    @F.pandas_udf("boolean")
    def may_have(doc_key: pd.Series) -> pd.Series:
        return pd.Series(_held(in_gone, doc_key.to_numpy()))

    spans = gone.select(F.col("doc_id").alias("gone_id"), F.col("doc_key").alias("gone_key"), "gone")
    texts = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    met = texts.where(may_have("doc_key")).join(spans, (F.col("doc_key") == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {id_type}, doc_key long, at int, off array<int>, key array<long>, start array<int>, end array<int>, paragraph array<int>"
    return texts.mapInArrow(whole, columns).unionByName(met.select("doc_id", "doc_key", "text", "gone").mapInArrow(joined, columns))


def _run_spans(docs: DataFrame, gone: DataFrame, run_words: int, anchor_words: int) -> DataFrame:
    """The occurrences of ``runs``, and spans whose cluster has no other, without ``n_occurrences``.

    A window of ``run_words`` words stays where it occurs first by (doc_id, doc_key, word);
    its later occurrences are removed, save those that overlap the first one.
    Firsts in a row are one cluster, and so are the windows equal to them.  Only
    windows whose anchor (least key of a shorter window) occurs twice are looked at.
    Windows of nothing but words of the lines ``gone`` (removed before) do not count.

    Windows travel by intervals (see ``_intervals``).  Equal intervals are looked up
    once: their windows alone are joined by key, and every occurrence takes the result over.
    """
    doc = ["doc_id", "doc_key"]
    anchors = materialize(_repeated_anchors(docs, run_words, anchor_words))
    in_row = Window.partitionBy(*doc).orderBy("word")  # lines of one document
    new = F.when(F.col("word") == F.lag(F.col("word") + F.col("n_words")).over(in_row), None).otherwise(F.col("word"))
    blocks = gone.select(*doc, "word", "n_words", new.alias("new")).withColumn("from", F.last("new", True).over(in_row))
    blocks = blocks.groupBy(*doc, "from").agg(F.max(F.col("word") + F.col("n_words")).alias("to"))
    spans = materialize(blocks.groupBy(*doc).agg(F.collect_list(F.struct("from", "to")).alias("gone")))
    found = _intervals(docs, spans, anchors, run_words, anchor_words)
    same = ["content", "lead"]  # intervals of equal windows
    found = materialize(found.withColumns({"content": F.xxhash64("key", "off"), "lead": F.get("key", F.lit(0))}))
    # a row repeated under its doc_id is one document
    place = F.struct(*doc, "at")
    kinds = materialize(found.groupBy(*same).agg(F.min(place).alias("f"), F.max(place).alias("l"), F.first("key").alias("key"), F.first("off").alias("off")))
    windows = kinds.select(*same, "f", "l", F.posexplode(F.arrays_zip("key", "off")).alias("i", "w"))
    f, l = (F.struct(*[F.col(f"{p}.{c}").alias(c) for c in doc], (F.col(f"{p}.at") + F.col("w.off")).alias("at")) for p in "fl")
    firsts = (windows.select(F.col("w.key").alias("key"), f.alias("f"), l.alias("l"))
              .groupBy("key").agg(F.min("f").alias("f"), F.max("l").alias("l")).where("NOT f <=> l")
              .select("key", *[F.col(f"f.{c}").alias(f"first_{c}") for c in (*doc, "at")]))
    by_first = Window.partitionBy("first_doc_id", "first_doc_key").orderBy("first_at")
    new = F.when(F.col("first_at") - F.lag("first_at").over(by_first) == 1, None).otherwise(F.col("key"))
    firsts = materialize(firsts.withColumn("new", new).withColumn("cluster_id", F.last("new", True).over(by_first)).drop("new"))
    at_first = F.struct("i", "cluster_id", "first_doc_id", "first_doc_key", "first_at")
    known = windows.select(*same, "i", F.col("w.key").alias("key")).join(firsts, "key").groupBy(*same).agg(F.array_sort(F.collect_list(at_first)).alias("known"))
    hits = found.drop("key").join(materialize(known), same).select("*", F.posexplode("known").alias("j", "k"))
    hits = hits.select(
        *doc, F.col("at").alias("interval"), "j", "k.*", F.get("off", F.col("k.i")).alias("off"),
        *[F.get(c, F.col("k.i")).alias(c) for c in ("start", "end", "paragraph")])
    own = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("doc_key") == F.col("first_doc_key"))
    hits = hits.withColumn("at", F.col("interval") + F.col("off")).withColumn("ahead", F.col("at") - F.col("first_at"))
    hits = hits.where(~(own & (F.col("ahead") > 0) & (F.col("ahead") < run_words)))
    # windows in a row of one interval that keep their distance from their firsts, then such stretches in a row
    parts = hits.groupBy(*doc, "cluster_id", "interval", "ahead", (F.col("off") - F.col("j")).alias("gap")).agg(
        F.min("at").alias("at"), F.max("at").alias("last"), F.min("paragraph").alias("paragraph"), F.min("start").alias("start"),
        F.max("end").alias("end"), F.first("first_doc_id").alias("first_doc_id"), F.first(~(own & (F.col("ahead") == 0))).alias("removed"))
    in_doc = Window.partitionBy(*doc, "cluster_id").orderBy("at")
    step = (F.col("at") - F.lag("last").over(in_doc) == 1) & (F.col("ahead") == F.lag("ahead").over(in_doc))
    parts = parts.withColumn("new", F.when(step, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_doc))
    return parts.groupBy(*doc, "cluster_id", "island").agg(
        F.min("paragraph").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("last") - F.min("at") + run_words).cast("int").alias("n_words"), F.first("first_doc_id").alias("first_doc_id"), F.first("removed").alias("removed"))


def runs(docs: DataFrame, gone: DataFrame, run_words: int = 50, anchor_words: int = 20) -> DataFrame:
    """Every occurrence of an exact run of ``run_words`` words or more that is found twice or more (see ``_run_spans``).

    Columns as in ``repeated_passages``, with ``doc_key``.
    """
    doc = ["doc_id", "doc_key"]
    out = settle(lambda: _run_spans(docs, gone, run_words, anchor_words))
    counts = out.groupBy("cluster_id").agg(F.count("*").alias("n_occurrences")).where("n_occurrences > 1")
    # a cluster may hold a large share of all rows: sixteen keys each
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("salt", F.col("salt").cast("long"))
    salted = out.withColumn("salt", F.pmod(F.xxhash64("doc_key", "start"), F.lit(16)))
    return salted.join(counts, ["cluster_id", "salt"]).select(
        *doc, "paragraph", "start", "end", "n_words", "cluster_id", "n_occurrences", "first_doc_id", "removed")


def repeated_lines(docs: DataFrame, threshold: float, shingle_words: int, min_words: int, recall: float) -> DataFrame:
    """The occurrences of ``repeated_passages`` that are whole lines, with ``doc_key`` and ``word`` (words before the line)."""
    min_words = max(min_words, shingle_words)
    bands, rows = tune(threshold, recall)
    seen = materialize(occurrences(docs, min_words, shingle_words, bands, rows))
    texts = seen.groupBy("key").agg(F.first("bands").alias("bands"))
    rows_ = materialize(texts.select("key", F.explode("bands").alias("bucket")))
    sizes = rows_.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialize(rows_.join(sizes, "bucket"))
    degree = crowded.groupBy("key").agg(F.sum("n").alias("degree"))
    ranked = crowded.join(degree, "key")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "key")).alias("hub")).select("bucket", F.col("hub.key").alias("hub"))
    members = materialize(crowded.join(hubs, "bucket").select("bucket", "key", "hub"))
    words = materialize(_texts(docs, members.select("key").distinct(), min_words))
    star = members.where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    checked = materialize(_checked(star, words, shingle_words, threshold))
    links = checked.where("similar").select("a", "b")
    groups = components(links)
    # what the hubs left apart: members of one hub that share a difference from it
    families = checked.groupBy("b").agg(F.count("*").alias("n"), F.min("similar").alias("all")).where("n > 1 AND NOT all").select("b")
    named = checked.join(families, "b").join(groups, F.col("a") == F.col("id"), "left").select(
        "a", "similar", F.coalesce("component", "a").alias("component"), "d", checked["n"], F.posexplode("marks").alias("at", "mark"))
    named = materialize(named)
    x, y = (named.select("mark", *[F.col(c).alias(f"{c}_{side}") for c in ("a", "component", "similar", "d", "n", "at")]) for side in "xy")
    # the first difference that x and y share leaves room for the overlap that their similarity needs
    most = F.floor(F.lit((1 - threshold) / threshold) * F.least("n_x", "n_y") + 1e-9)
    room = 2 * F.least(F.col("d_x") - F.col("at_x"), F.col("d_y") - F.col("at_y")) >= F.col("d_x") + F.col("d_y") - most
    rest = (x.where("NOT similar_x").join(y, "mark").where(room & F.expr("component_x <> component_y AND (similar_y OR a_x < a_y)"))
            .select(F.col("a_x").alias("a"), F.col("a_y").alias("b")).distinct())
    more = materialize(_checked(rest, words, shingle_words, threshold).where("similar").select("a", "b"))
    groups = components(links.unionByName(more))
    placed = seen.select("doc_id", "doc_key", "paragraph", "start", "end", "word", "n_words", "key").distinct()
    cluster = placed.join(groups, placed["key"] == groups["id"], "left").select(
        "doc_id", "doc_key", "paragraph", "start", "end", "word", "n_words", F.coalesce("component", "key").alias("cluster_id"))
    cluster = materialize(cluster)
    firsts = (cluster.groupBy("cluster_id").agg(F.count("*").alias("n_occurrences"), F.min(F.struct("doc_id", "doc_key", "start")).alias("f"))
              .where("n_occurrences > 1"))
    stays = (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("doc_key") == F.col("f.doc_key")) & (F.col("start") == F.col("f.start")))
    return cluster.join(firsts, "cluster_id").select(
        "doc_id", "doc_key", "paragraph", "start", "end", "word", "n_words", "cluster_id", "n_occurrences", F.col("f.doc_id").alias("first_doc_id"),
        (~stays).alias("removed"))


def passages(docs: DataFrame, threshold: float = 0.8, shingle_words: int = 5, min_words: int = 20, recall: float = 0.998, run_words: int = 50) -> DataFrame:
    """``repeated_passages`` with ``doc_key``, the hash of the text that sets apart different texts of one doc_id or without one."""
    ready(docs.sparkSession)
    lines = settle(lambda: repeated_lines(docs, threshold, shingle_words, min_words, recall))
    return lines.drop("word").unionByName(runs(docs, lines.where("removed"), run_words))


def repeated_passages(docs: DataFrame, **parameters) -> DataFrame:
    """Every occurrence of a passage that occurs twice or more: lines, exactly or nearly, and exact runs of words anywhere.

    ``doc_id, paragraph`` (number of the first line, from 0) ``, start, end`` (code
    points) ``, n_words, cluster_id, n_occurrences, first_doc_id, removed``: the first
    occurrence by (doc_id, start) stays, the others are removed.

    Lines count from ``min_words`` words on (at least ``shingle_words``), as similar
    from ``threshold`` on.  Runs count from ``run_words`` words on, wherever they begin
    and however many lines they cross; those within
    removed lines are not listed again.  Spans of different clusters may overlap.  Null and empty texts have no passages.  A
    repeated row of one doc_id and text is the same document: it adds no occurrence.
    A null doc_id comes first in order; different texts under one doc_id, or without
    one, are different documents.  Extra columns are ignored; an empty table gives no row.
    """
    return passages(docs, **parameters).drop("doc_key")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans (code points); lines of which only white space is left go, other lines stay as they are."""
    out, at, spans, first = [], 0, sorted(spans), 0
    for line in text.split("\n"):
        end, left, pos, touched = at + len(line), [], at, False
        while first < len(spans) and spans[first][1] <= at:
            first += 1
        for s, e in spans[first:]:
            if s >= end:
                break
            if e > pos:
                left.append(text[pos:max(s, pos)])
                pos, touched = min(e, end), True
        left.append(text[pos:end])
        if touched:
            line = " ".join(x for x in (x.strip(SPACE) for x in left) if x)
        if line or not touched:
            out.append(line)
        at = end + 1
    return "\n".join(out)


def cut_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without removed passages; what stays keeps its order.

    ``n_chars`` (if present) follows the text.  Documents of which nothing but
    white space is left go; documents that had no passage removed are untouched.
    """
    found = settle(lambda: passages(docs, **parameters).where("removed").select("doc_id", "doc_key", "start", "end"))
    gone = found.groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("start", "end")).alias("gone"))  # spans of one document
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "doc_key": "gone_key"})
    same = F.col("d.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("d.text") == F.col("gone_key"))
    rows = docs.select(F.struct("*").alias("d")).join(gone, same, "left")  # no name can clash
    cut = F.udf(lambda t, g: None if t is None else without(t, [(x["start"], x["end"]) for x in g]), "string")
    rows = rows.select("d", "gone", cut(F.when(F.col("gone").isNotNull(), F.col("d.text")), "gone").alias("cut"))
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(F.col("cut"))
    out = rows.select("d", "gone", text.alias("text")).where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("gone").isNull(), F.col("d.n_chars")).otherwise(F.length("text")).cast("long") if "n_chars" in docs.columns else None
    own = {"text": F.col("text"), "n_chars": n_chars}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"d.`{c}`") for c in docs.columns])
