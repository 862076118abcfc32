"""Quality rules (native): base counts, and Jensen-Shannon distance of character-class and common-word histograms.

Only DataFrame functions are used: one scan computes all counts of a document in
its own row (no text is shuffled), a small aggregate over every document gives the
language references, and a second pass over the counts alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import SPACE, materialize, ready, words

#: Frequent function words of each language, the bins of its common-word histogram.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "ein"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "are", "with", "by", "this", "on"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
#: Bins of the character-class histogram.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
SYMBOLS = "#*$%&|<>"
_STOPS = ".,;:!?'()\"-"


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules.

    A document fails the base rules with fewer than ``min_words`` words or more
    than ``max_repeat_percent`` percent of its words in repeated 3-word windows.
    Histograms are compared only from ``min_class_chars`` characters and
    ``min_common_words`` words on; shorter documents pass that comparison.
    ``max_class``, ``max_common``: largest distance (0 to 1) to the nearest reference.
    ``min_reference_docs``: a language with fewer documents gives no reference.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    min_class_chars: int = 200
    min_common_words: int = 100
    max_class: float = 0.29
    max_common: float = 0.26
    min_reference_docs: int = 10
    common_words: dict[str, tuple[str, ...]] = field(default_factory=lambda: COMMON_WORDS)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(ws: Column, n: Column) -> Column:
    """Words in 3-word windows found twice or more; windows are compared by 64-bit hash."""
    m = F.greatest(n - 2, F.lit(0))
    hashes = _let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.arrays_zip(F.slice(h, 1, m).alias("a"), F.slice(h, 2, m).alias("b"), F.slice(h, 3, m).alias("c")), lambda z: F.xxhash64(z)))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def found(s: Column) -> Column:
            at = F.array_remove(F.transform(s, lambda e, j: F.when(
                (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"]).otherwise(-1)), -1)
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return _let(by_hash, found)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measure(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts of every document: the base columns, ``lang``, ``n_chars``, ``classes`` and ``common`` (arrays by bin).

    The counts are written once as one struct per document; its fields are read
    back as columns, so that no expression over a text is evaluated twice.
    """
    listed = _listed(limits)
    t = F.coalesce(F.col("text"), F.lit(""))

    def counts(ws: Column) -> Column:
        n = F.size(ws)
        # only listed words are counted one by one
        hits = _let(F.filter(ws, lambda w: w.isin(*listed)), lambda m: F.array(*[
            (F.size(m) - F.size(F.array_remove(m, w))).cast("long") for w in listed]))
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
        word_chars = F.length(F.array_join(ws, ""))

        def classes(rest: Column) -> Column:
            # rest: the text without lower-case letters and blanks, a few percent of it
            upper, digit = (F.length(rest) - F.length(F.regexp_replace(rest, p, "")) for p in (r"\p{Lu}+", "[0-9]+"))
            stop, symbol, other_space = (_without(rest, c) for c in (_STOPS, SYMBOLS, SPACE))
            space = F.length(t) - word_chars
            lower = F.length(t) - F.length(rest) - (space - other_space)
            other = F.length(rest) - upper - digit - stop - symbol - other_space
            return F.array(*[c.cast("long") for c in (lower, upper, digit, space, stop, symbol, other)])

        return F.struct(
            n.cast("long").alias("n_words"), F.length(t).cast("long").alias("n_chars"), word_chars.cast("long").alias("word_chars"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(ws, n).cast("long").alias("n_repeat_words"),
            _let(F.regexp_replace(t, r"[\p{Ll} ]+", ""), classes).alias("classes"), hits.alias("hits"))

    counted = materialize(docs.select("doc_id", "lang", _let(words(F.col("text")), counts).alias("m")))
    m = counted.select("doc_id", "lang", "m.*")
    place = {w: i for i, w in enumerate(listed)}
    common = F.create_map(*[x for lang, ws in sorted(limits.common_words.items()) for x in (
        F.lit(lang), _with_rest([F.get("hits", F.lit(place[w])) for w in ws], F.col("n_words")))])
    return m.select("doc_id", "lang", "n_words", "n_chars", "word_chars", F.get("classes", F.lit(CLASSES.index("symbol"))).alias("n_symbols"),
                    "n_dup_lines", "n_repeat_words", "classes", common.alias("common"))


def _listed(limits: Limits) -> list[str]:
    return sorted({w for v in limits.common_words.values() for w in v})


def _with_rest(counts: list[Column], total: Column) -> Column:
    return F.array(*counts, total - reduce(lambda a, b: a + b, counts))


def base_failed(limits: Limits) -> Column:
    return ((F.col("n_words") < limits.min_words)
            | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")))


def references(measured: DataFrame, limits: Limits) -> dict[str, tuple[list[int], list[int]]]:
    """Class and common-word totals by language over all documents that pass the base rules.

    One row per language of ``limits.common_words`` comes to the driver; a
    language is bounded by that parameter, not by the data.
    """
    langs = sorted(limits.common_words)
    by_lang = F.element_at("common", F.col("lang"))
    fit = measured.where(F.col("lang").isin(*langs) & ~base_failed(limits))
    n_class, n_common = len(CLASSES), {k: len(v) + 1 for k, v in limits.common_words.items()}
    most = max(n_common.values(), default=0)
    rows = fit.groupBy("lang").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.get("classes", F.lit(i))) for i in range(n_class)]).alias("classes"),
        F.array(*[F.sum(F.get(by_lang, F.lit(i))) for i in range(most)]).alias("common")).collect()
    return {r["lang"]: (list(r["classes"]), list(r["common"])[:n_common[r["lang"]]])
            for r in sorted(rows, key=lambda r: r["lang"]) if r["n"] >= limits.min_reference_docs}


def distance(counts: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 0 if either is empty."""
    total = float(sum(reference))
    if total <= 0:
        return F.lit(0.0)
    own = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.array(*[F.lit(x / total) for x in reference])

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def divergence(n: Column) -> Column:
        terms = F.zip_with(counts, shares, lambda c, q: _let(c / n, lambda p: term(p, (p + q) / 2) + term(q, (p + q) / 2)))
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))

    return F.when(own > 0, divergence(own.cast("double"))).otherwise(0.0)


def judge(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``base_failed``, ``class_distance``, ``common_distance`` (to the nearest reference) and ``kept``."""
    refs = references(measured, limits)
    nearest = [F.lit(0.0), F.lit(0.0)]
    if refs:
        by_class = [distance(F.col("classes"), c) for c, _ in refs.values()]
        by_word = [distance(F.element_at("common", F.lit(k)), w) for k, (_, w) in refs.items()]
        nearest = [d[0] if len(d) == 1 else F.least(*d) for d in (by_class, by_word)]
    far = measured.select("*", base_failed(limits).alias("base_failed"), nearest[0].alias("class_distance"), nearest[1].alias("common_distance"))
    passed = (((F.col("n_chars") < limits.min_class_chars) | (F.col("class_distance") <= limits.max_class))
              & ((F.col("n_words") < limits.min_common_words) | (F.col("common_distance") <= limits.max_common)))
    return far.select("*", (~F.col("base_failed") & passed).alias("kept"))


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Verdict on every document, one row per input row.

    Input ``doc_id, text, lang``; other columns are ignored.  Null or empty
    text has zero counts and fails the base rules.  A null or unlisted ``lang``
    adds nothing to the references; the document is compared like any other,
    with whichever reference is nearest.  Repeated rows are judged one by one.
    With no reference at all (empty table) only the base rules decide.
    """
    ready(docs.sparkSession)
    return judge(measure(docs, limits), limits)


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each by its own text: different texts under one doc_id, or without one, are told apart."""
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc_id"), "text", "lang")
    kept = quality(own, limits).where("kept").select(F.col("doc_id.doc_id").alias("kept_id"), F.col("doc_id.text_key").alias("kept_key")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["kept_key"])
    return docs.join(kept, same, "left_semi")
