"""Phrase mining against plain counting of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm import phrases
from mercato.llm.sieve import held, mark

rnd = random.Random(13)
VOCAB = [f"w{i}" for i in range(60)]
DOCS = "doc_id long, text string, lang string, words int, f string"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute_counts(docs):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        for ws in pieces(text):
            n["und" if lang is None else lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f["und" if lang is None else lang][tuple(ws[i:i + k])] += 1
    return f, n


def brute(docs, least, most):
    f, n = brute_counts(docs)
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        rows = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 100 * a:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def prose(n):
    out = []
    while len(out) < n:
        out += rnd.choice([["new", "york", "city"], ["of", "the"], ["a", "b", "a", "b", "a"], rnd.choices(VOCAB, k=3)])
        if rnd.random() < 0.2:
            out[-1] += rnd.choice([".", ",", "!", "\n", ";;"])
    return " ".join(out)


def check(spark, docs, least=5, most=2000, **passes):
    d = spark.createDataFrame([(i, t, l, 1, "x") for i, t, l in docs], DOCS)
    got = sorted(tuple(r) for r in phrases.collocations(d, least, most, **passes).collect())
    assert got == brute(docs, least, most)
    return got


@pytest.fixture(scope="module")
def corpus():
    return [(i, prose(rnd.randint(1, 200)), rnd.choice(["en", "en", "fr", None])) for i in range(60)]


def test_equals_brute_force(spark, corpus):
    assert len(check(spark, corpus, slack=1.0)) > 50


def test_limit_and_ties(spark, corpus):
    check(spark, corpus, least=4, most=7)


def test_border_failures_are_mended(spark, corpus, monkeypatch):
    """A sample that proposes nothing: every frequent word fails the border, one expansion pass brings all phrases in."""
    passes, count = [], phrases.count

    def counted(docs, longest, known=0, sieve=None, before=None, **rest):
        passes.append(before is not None)
        return count(docs, longest, known, sieve, before, **rest)

    monkeypatch.setattr(phrases, "count", counted)
    check(spark, corpus, share=0.0)
    assert sum(passes) == 1


def test_rare_words_repeated_in_one_text(spark, corpus):
    """Long phrases that only one document holds, which the sample mostly misses, beside others that it finds."""
    for i in range(6):
        check(spark, corpus + [(1000 + i, f"r{i} s{i} t{i} of the u{i} v{i}. " * 9, "en")], share=0.3, slack=0.0)


def test_full_sieve_gives_the_same(spark, corpus):
    check(spark, corpus, sieve_bits=64)


def test_long_texts_in_parts(spark, corpus, monkeypatch):
    count = phrases.count
    monkeypatch.setattr(phrases, "count", lambda *a, **k: count(*a, **{**k, "part_chars": 300}))
    check(spark, corpus + [(900, prose(20_000), "en"), (901, "w1 w2 " * 3000, "en")])


def test_odd_rows(spark):
    same = "The Same words again. the same words again"
    check(spark, [(1, None, "en"), (2, "", "en"), (3, " \t\n.,", "en"), (4, same, "en"), (4, same, "en"), (None, same, None), (None, same, None), (5, same, "und"),
                  (6, "a\x00b \xff\x1c ÀÉ é ÿ " * 4, "xx"), (7, "x" * 100_000, "en"), (8, 'he "said" it ' * 5, "")], least=2, share=1.0)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    n, a, left, right = 3 * 10**13, 2 * 10**12, 10**13 + 7, 10**13 + 9
    frequent = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", left), ("en", 1, "y", right)], "lang string, words int, phrase string, f long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs, least, **_: (frequent, spark.createDataFrame([("en", n)], "lang string, n long")))
    (row,) = phrases.collocations(None).collect()
    assert row["score"] == 1000 * a * n // (left * right) and 1000 * a * n > 1 << 64


def test_sieve(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 64, 500, np.uint64)
    sieve = mark(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"), 1 << 14)
    assert held(sieve, keys).all()
    assert held(sieve, np.random.default_rng(2).integers(0, 1 << 64, 5000, np.uint64)).mean() < 0.02
    assert not mark(spark.range(0).select(F.col("id").alias("key")), 1 << 10).any()
