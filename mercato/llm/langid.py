"""Language identification with error-correcting output codes.

Each language has a codeword; each code position is a binary classifier over
hashed character n-grams (which of two groups of languages a text belongs to).
A text's language is the codeword with the least weighted loss over all
positions; a text whose two best codewords are nearly as close is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import ready, slices

#: Prediction for texts without a letter.
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_N = (1, 2, 3)  # n-gram lengths
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # odd multipliers


def grams(text: str, dims: int) -> np.ndarray:
    """Hashed 1- to 3-grams of the lower-cased letters of a text, words set apart by one blank."""
    plain = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    if len(plain) < 3:
        return np.empty(0, np.int64)
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in _N:
        h = np.full(len(c) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ c[i:len(c) - n + 1 + i]) * _MIX[i]
            h ^= h >> np.uint32(15)
        out.append(h)
    return (np.concatenate(out) & np.uint32(dims - 1)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """(languages, positions) of +1 and -1: all splits of up to 6 languages, else the best of 64 fixed random codes."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        rows = np.array([[1 if (c >> i) & 1 else -1 for c in range(1, 2 ** (n - 1))] for i in range(n - 1)])
        return np.vstack([-np.ones(rows.shape[1]), rows])
    rng, length = np.random.default_rng(n), 8 * int(np.ceil(np.log2(n))) + 7
    codes = []
    for _ in range(64):
        m = np.where(rng.random((n, length)) < 0.5, -1, 1)
        apart = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        split = bool(((m == 1).any(0) & (m == -1).any(0)).all())
        codes.append((apart, split, len(codes), m))
    return max(codes, key=lambda x: x[:3])[3].astype(float)


@dataclass(frozen=True)
class Model:
    """``weights``: log-odds of each n-gram at each code position; ``trust``: weight of the position in decoding."""

    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    dims: int

    def predict(self, text: str | None, sharp: float = 6.0, ambiguous_below: float = 0.6) -> tuple[str, float, bool]:
        """Language, score (0 to 1, share of the best codeword) and whether it is ambiguous."""
        found = grams(text or "", self.dims)
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        h = np.bincount(found, minlength=self.dims).astype(np.float32)
        margin = np.clip(self.weights @ h / len(found) * sharp, -8, 8)
        loss = (np.logaddexp(0, -self.codes * margin) * self.trust).sum(axis=1)
        near = np.exp(-(loss - loss.min()))
        best = int(loss.argmin())
        score = float(near[best] / near.sum())
        return self.langs[best], score, score < ambiguous_below


def train(labelled: DataFrame, per_language: int = 4000, dims: int = 1 << 13, smoothing: float = 0.5) -> Model:
    """Fit on ``doc_id, text, lang`` (null languages are left out).

    Only a bounded sample is read for it: about ``per_language`` documents of each
    language, those with the smallest hash of doc_id.  The counts of hashed n-grams
    by language (``dims`` rows a language) are summed in Spark.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.ones((0, 0)), np.ones((0, dims), np.float32), np.ones(0), dims)
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(place < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                h = np.bincount(grams(text, dims), minlength=dims)
                # square roots keep one long text from outweighing many others
                sums[lang] = sums.get(lang, 0) + np.sqrt(h)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(s[at])], ["lang", "gram", "n"])

    counts = np.zeros((len(langs), dims))
    index = {k: i for i, k in enumerate(langs)}
    for r in sample.mapInArrow(run, "lang string, gram long, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[index[r["lang"]], r["gram"]] = r["n"]
    shares = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    codes = codewords(len(langs))
    weights, trust = [], []
    for code in codes.T:
        one, zero = shares[code > 0].mean(axis=0), shares[code < 0].mean(axis=0)
        weights.append(np.log(one / zero))
        trust.append(float(((one - zero) * weights[-1]).sum()))  # how far apart the two groups are
    trust = np.array(trust)
    return Model(langs, codes, np.array(weights, np.float32).reshape(-1, dims), trust / trust.mean() if len(trust) else trust, dims)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` per input row, from the whole text alone.

    Null text and texts without a letter are ``und`` with score 0.  Equal texts
    get equal predictions; ties go to the first language in order.  Repeated rows
    are predicted one by one, extra columns are ignored, an empty table gives no row.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [model.predict(t) for t in b.column("text").to_pylist()]
            lang, score, unsure = zip(*got)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, ambiguous boolean")


def held_out():
    """Whether crc32 of doc_id as text leaves remainder 1 by 3; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
