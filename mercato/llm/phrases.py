"""Phrase collocation mining by Toivonen's method.

A sample proposes the phrases that seem frequent; its threshold is lowered so that it
misses few.  One pass over all documents then counts, exactly, every proposed phrase
and the negative border: every other phrase whose first and last words (all but one)
were proposed.  A border phrase that turns out to be frequent may have frequent
extensions that nobody counted.  Then the proposals grow by all such phrases, and an
expansion pass counts what has newly come within the border.  There a phrase that
has newly come in counts as proposed for the longer ones, so this pass closes the
border at every length: the two shorter parts of a frequent phrase are frequent, so
by induction they were proposed, failed the border or came in with this pass.

The proposals travel as a sieve of fixed size.  A phrase that passes it by chance is
counted too and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import materialize, ready, released, slices
from mercato.llm.sieve import held, mark

#: Fixed value: the characters that end a piece.
CUTS = ".,;:!?\n\x0b\x0c\r"
LONGEST = 5
_BREAK = b"\xff"  # occurs in no UTF-8 text
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 0xFF if b < 0x80 and chr(b) in CUTS else b for b in range(256))
_AT_CUT = re.compile(f"[{re.escape(CUTS)}]")
_ODD, _MIXED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Numbers(dict):
    """word -> number in order of first sight; the break is 0."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def tokens(texts: list[str]) -> list[bytes]:
    """The words of all texts in order, with a break wherever a piece or a text ends."""
    joined = (" " + _BREAK.decode("latin-1") + " ").encode("latin-1").join(t.encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts)
    return joined.replace(_BREAK, b" \xff ").split()


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of phrases continued by one more word each."""
    x = (key * _ODD) ^ (key >> np.uint64(29))
    x = (x + word) * _MIXED
    return x ^ (x >> np.uint64(32))


def word_key(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _parts(text: str, most: int) -> Iterator[str]:
    """``text`` cut at ends of pieces into parts of about ``most`` characters."""
    at = 0
    while len(text) - at > most and (m := _AT_CUT.search(text, at + most)):
        yield text[at:m.end()]
        at = m.end()
    yield text[at:]


def phrases_of(lang: str, texts: list[str], longest: int, known: int, sieve: np.ndarray | None, before: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of the words and of the phrases within the border of ``sieve``, by length.

    The sieve knows the proposals of up to ``known`` words; of longer phrases all
    within reach count as proposed.  With ``before``, an earlier sieve, only phrases
    outside its border come out, and they count as proposed.
    """
    number = _Numbers({_BREAK: 0})
    words = tokens(texts)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    vocabulary = list(number)
    if before is None:
        found = np.bincount(ids, minlength=len(vocabulary))[1:]
        if len(found):
            yield pa.array(vocabulary[1:], pa.binary()), found
    if longest == 1 or len(ids) < 2:
        return
    names = pa.array(vocabulary, pa.binary())
    of_word = word_key(lang, vocabulary)[ids]
    key, group = of_word, ids
    reach = [ids != 0] * (1 if before is None else 2)  # phrases within the border, by start; for ``before`` too
    for n in range(2, min(longest, len(ids)) + 1):
        proposed = [r & held(s, key) if n - 1 <= known else r for r, s in zip(reach, (sieve, before))]
        if before is not None and n > 2:
            proposed[0] |= reach[0] & ~reach[1]
        reach = [p[:-1] & p[1:] for p in proposed]
        at = np.flatnonzero(reach[0])
        if not len(at):
            return
        pairs = group[at] * np.int64(len(vocabulary)) + ids[at + n - 1]
        _, first, group_of, count = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
        group = np.full(len(ids) - n + 1, -1, np.int64)
        group[at] = group_of
        first = at[first]
        if before is not None:
            new = ~reach[1][first]
            first, count = first[new], count[new]
        if len(first):
            yield pc.binary_join_element_wise(*[names.take(pa.array(ids[first + j])) for j in range(n)], pa.scalar(b" ", pa.binary())), count
        key = _longer(key[:-1], of_word[n - 1:])


def count(docs: DataFrame, longest: int, known: int = 0, sieve: np.ndarray | None = None, before: np.ndarray | None = None, part_chars: int = 2_500_000) -> DataFrame:
    """``lang, words, phrase, f``: exact counts over ``docs`` (lang, text) of what ``phrases_of`` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", part_chars):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, held_texts in texts.items():
                groups = [held_texts] if len(held_texts) > 1 else ([p] for p in _parts(held_texts[0], part_chars))
                for group in groups:
                    end = pa.scalar(lang.encode("utf-8", "surrogatepass"), pa.binary())
                    for phrase, f in phrases_of(lang, group, longest, known, sieve, before):
                        key = pc.binary_join_element_wise(phrase, end, pa.scalar(b"\n", pa.binary())).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([key, pa.array(f, pa.int64())], ["key", "f"])

    # one string per group keeps the shuffled rows short; no phrase holds a line end
    found = docs.mapInArrow(run, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", 1)
    return found.select(F.expr("substring(key, instr(key, '\n') + 1)").alias("lang"), (F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1).alias("words"),
                        phrase.alias("phrase"), "f")


def _keys(phrases: DataFrame, sieve: np.ndarray | None = None) -> DataFrame:
    """``key`` of the phrases; with a sieve only of those that do not pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist()):
                first, *rest = word_key(lang, phrase.encode("utf-8", "surrogatepass").split(b" "))
                key = np.array([first], np.uint64)
                for word in rest:
                    key = _longer(key, np.array([word], np.uint64))
                out.append(key[0])
            keys = np.array(out, np.uint64)
            if sieve is not None and len(keys):
                keys = keys[~held(sieve, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return phrases.select("lang", "phrase").mapInArrow(run, "key long")


def frequent_phrases(docs: DataFrame, least: int, share: float = 0.25, slack: float = 0.0, sieve_bits: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """(``lang, words, phrase, f`` of all phrases of up to five words found ``least`` times or more, ``lang, n`` words in all).

    ``share`` of the documents form the sample, told by a hash.  Its threshold is
    ``slack`` standard deviations below the expected count of a phrase that just
    qualifies.  Neither changes the result, only what the border holds.
    """
    ready(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    sieve = released(lambda: _proposals(docs, least, share, slack, sieve_bits))
    counted = materialize(_with_totals(count(texts, LONGEST, LONGEST, sieve), least))
    frequent, total = counted.where("phrase IS NOT NULL"), counted.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    # border failures: frequent although not proposed, so that what they extend to is not counted yet
    failed = materialize(_keys(frequent.where(F.col("words") < LONGEST), sieve))
    if not failed.isEmpty():
        wider = sieve | mark(failed, sieve_bits)
        frequent = frequent.unionByName(materialize(count(texts, LONGEST, LONGEST, wider, sieve).where(F.col("f") >= least)))
    return frequent, total


def _proposals(docs: DataFrame, least: int, share: float, slack: float, sieve_bits: int) -> np.ndarray:
    """The sieve of the phrases that seem frequent in the sample."""
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = materialize(docs.where(drawn).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL"))
    lowered = max(1, int(least * share - slack * (least * share * (1 - share)) ** 0.5))
    # the sample: words, then pairs of proposed words, then longer phrases whose pairs are all proposed
    proposed, sieve = None, None
    for longest, known in ((1, 0), (2, 1), (LONGEST, 2)):
        found = count(sample, longest, known, sieve).where((F.col("f") >= lowered) & (F.col("words") >= longest if longest < LONGEST else F.col("words") > 2))
        found = materialize(found.select("lang", "phrase"))
        proposed = found if proposed is None else proposed.unionByName(found)
        sieve = mark(_keys(proposed), sieve_bits)
    return sieve


def _with_totals(counts: DataFrame, least: int) -> DataFrame:
    """The frequent phrases, and one row per language without a phrase whose ``f`` is its number of words."""
    both = counts.select("lang", "words", "phrase", "f", F.explode(F.expr(f"CASE WHEN words = 1 AND f >= {least} THEN array(true, false) "
                                                                         f"WHEN words = 1 THEN array(true) WHEN f >= {least} THEN array(false) END")).alias("total"))
    one = both.select("lang", F.when(F.col("total"), 0).otherwise(F.col("words")).alias("words"), F.when(~F.col("total"), F.col("phrase")).alias("phrase"), "f")
    return one.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, **passes) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``most`` best phrases of two to five words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words
    of the language.  A phrase that always stands inside one longer frequent phrase
    is left out.  ``passes`` goes to ``frequent_phrases``.

    Null text counts as empty, null lang as ``und``.  Every row counts, repeated rows
    and null ids included; other columns are ignored; an empty table gives no row.
    Texts are read in parts cut at ends of pieces, so only a single piece is held whole.
    """
    frequent, total = frequent_phrases(docs, least, **passes)
    w = F.split("phrase", " ", -1)
    part = [F.struct(F.lit(k).alias("k"), F.concat_ws(" ", F.slice(w, 1, k)).alias("first"), F.concat_ws(" ", F.slice(w, k + 1, LONGEST)).alias("rest"))
            for k in range(1, LONGEST)]
    candidates = frequent.where("words > 1")
    cut = candidates.select("lang", "words", "phrase", F.col("f").alias("a"), F.inline(F.slice(F.array(*part), F.lit(1), F.col("words") - 1)))
    cut = (cut.join(frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
           .join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
           .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
           .join(total.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("salt")), ["lang", "salt"]))  # a language may hold most phrases
    # decimals of 38 digits hold the products exactly; the quotient is at most 10 n
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    weakest = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c")).select("lang", "phrase", "c.*")
    inner = [F.when(F.col("words") > size, F.concat_ws(" ", F.slice(w, at, size)))
             for size in range(2, LONGEST) for at in range(1, LONGEST - size + 2)]
    inside = candidates.where("words > 2").select("lang", "words", "f", F.posexplode(F.array(*inner)).alias("i", "phrase"))
    starts = F.array(*[F.lit(at + size - 1) for size in range(2, LONGEST) for at in range(1, LONGEST - size + 2)])
    inside = inside.where(F.col("phrase").isNotNull() & (F.get(starts, F.col("i")) <= F.col("words")))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where("inside IS NULL OR inside < a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
