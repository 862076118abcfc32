"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import ready, slices

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Fingerprinter:
    """Fingerprints of word-shingle sets.

    Every shingle is hashed once; the top bits choose one of ``bins`` bins, the
    least hash of a bin is its value.  An empty bin copies the value of the first
    filled bin in its own fixed pseudo-random order.  The low ``bits`` bits of each
    value are packed.
    """

    def __init__(self, bins: int = 256, bits: int = 4, shingle_words: int = 5):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.k = bins, bits, shingle_words
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.odd = np.random.default_rng(42).integers(1, 1 << 62, shingle_words, np.uint64) * np.uint64(2) + np.uint64(1)
        rng = np.random.default_rng(7)
        self.probes = np.stack([rng.integers(0, bins, bins) for _ in range(bins)])  # attempt, bin

    def hashes(self, text: str) -> np.ndarray:
        ws = text.encode("utf-8", "surrogatepass").lower().split()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter(map(digest, ws), np.uint64, len(ws))
        k = min(self.k, len(h))
        if not k:
            return h
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i:i + n]) * self.odd[i]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def sketch(self, text: str) -> np.ndarray | None:
        """Low-order bits of each bin; None for a text without words."""
        h = self.hashes(text)
        if not len(h):
            return None
        values = np.full(self.bins, _EMPTY)
        np.minimum.at(values, (h >> self.shift).astype(np.int64), h)
        empty = np.flatnonzero(values == _EMPTY)
        filled = values != _EMPTY
        for probe in self.probes:
            if not len(empty):
                break
            source = probe[empty]
            ok = filled[source]
            values[empty[ok]] = values[source[ok]]
            empty = empty[~ok]
        if len(empty):  # no probe met a filled bin: take the first filled one
            values[empty] = values[np.flatnonzero(filled)[0]]
        # mix before cutting, so that the kept bits do not repeat the order that chose the minimum
        v = values * np.uint64(0x94D049BB133111EB)
        return ((v ^ (v >> np.uint64(31))) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def pack(self, sketch: np.ndarray | None) -> str:
        """Packed bits as hexadecimal digits; empty for a text without words."""
        if sketch is None:
            return ""
        bits = np.unpackbits(sketch[:, None], axis=1)[:, 8 - self.bits:]
        return np.packbits(bits).tobytes().hex()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """Estimated Jaccard similarity; chance agreement of the kept bits is corrected.  Two texts without words are alike."""
        if a is None or b is None:
            return float(a is b)
        chance = 2.0 ** -self.bits
        return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, fingerprint`` per input row; null text is empty, equal texts have equal fingerprints."""
    ready(docs.sparkSession)
    maker = Fingerprinter(**parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            prints = [maker.pack(maker.sketch(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fingerprint string")


def with_next(docs: DataFrame, buckets_per_partition: int = 4) -> DataFrame:
    """``doc_id, text, guest`` in sorted runs: own rows by (doc_id, text), then copies of the row that follows the run.

    Texts move once.  doc_id is cut into ranges (approximate quantiles; null comes
    first); the smallest doc_id of each range is also sent, as a guest, to the
    range before it, and the smallest of all to the last range.
    """
    spark = docs.sparkSession
    n = buckets_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = np.unique(np.array(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) or [], float)).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        # cuts come from doubles; any value serves as a cut
        return pd.Series(np.where(known, np.searchsorted(cuts, doc_id.fillna(0).astype("int64"), side="right"), 0).astype("int32"))

    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket_of(F.col("doc_id").cast("long")).alias("bucket"))
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("first")).orderBy("bucket").collect()  # one row per range
    before = {r["first"]["doc_id"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    known = {k: v for k, v in before.items() if k is not None}
    keys, hosts = np.array(sorted(known), np.int64), np.array([known[k] for k in sorted(known)], np.int32)
    null_host = before.get(None, -1)

    @F.pandas_udf("int")
    def host_of(doc_id: pd.Series) -> pd.Series:
        got = np.full(len(doc_id), -1, np.int32)
        null = doc_id.isna().to_numpy()
        if len(keys):
            x = doc_id.fillna(0).astype("int64").to_numpy()
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            got = np.where(keys[at] == x, hosts[at], -1)
        return pd.Series(np.where(null, null_host, got).astype("int32"))

    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(host_of(F.col("doc_id").cast("long")).alias("bucket"), F.lit(True).alias("guest"))
    sent = placed.select("doc_id", "text", F.explode(F.array(own, guest)).alias("s")).where("s.bucket >= 0")
    flat = sent.select("doc_id", "text", "s.bucket", "s.guest")
    return flat.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")


def compare_with_next(docs: DataFrame, **parameters) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text keeps the first half of the code points (the larger half of
    an odd number) and continues with as many as are missing from the start of the
    next document by (doc_id, text), the first after the last; if that document
    is shorter, all of it.  Null text is empty and a null doc_id comes first;
    repeated rows follow each other.  A table of one document is its own next.
    """
    ready(docs.sparkSession)
    maker = Fingerprinter(**parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, sketch of the last own row
        done = False  # its successor was met
        for b in slices(batches, "text"):
            rows = []
            for doc_id, text, bucket, guest in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is not None and held[0] != bucket:
                    held = None
                if guest and (held is None or done):
                    continue
                sketch = maker.sketch(text)
                if held is not None and not done:
                    _, this_id, this, own = held
                    half = len(this) // 2
                    edited = this[:len(this) - half] + text[:half]
                    changed = maker.sketch(edited)
                    rows.append((this_id, len(this), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                 maker.pack(own), maker.pack(changed), maker.likeness(own, changed), maker.likeness(own, sketch)))
                done = guest
                if not guest:
                    held = (bucket, doc_id, text, sketch)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
