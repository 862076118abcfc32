"""Pipelined ranked search against a plain computation of every score."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mercato.llm import search

rnd = random.Random(12)
VOCAB = ["".join(rnd.choice("abcdeé9") for _ in range(rnd.randint(1, 4))) for _ in range(150)]
DOCS, ITEMS = "doc_id long, text string, score long, block string", "item_id long, text string, rank string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    found = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, n_terms = len(found), sum(len(w) for _, w in found)
    out = []
    for item_id, text in dict.fromkeys(items):
        ranked = []
        for doc_id, ws in found:
            m, score = 25 + 75 * len(ws) * n_docs // n_terms, 0
            for t in words(text):
                tf = ws.count(t)
                df = sum(t in w for _, w in found) if tf else 0
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if no_id else doc_id, -score) for r, (score, no_id, doc_id) in enumerate(sorted(ranked)[:k], 1)]
    return out


def prose(n):
    return " ".join(rnd.choice(VOCAB[:20] if rnd.random() < 0.6 else VOCAB) for _ in range(n))


def check(spark, docs, items, monkeypatch=None, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = [tuple(r) for r in search.search(d, q, **how).collect()]
    order = lambda r: tuple((x is None, 0 if x is None else x) for x in r)
    assert sorted(got, key=order) == sorted(brute(docs, items, how.get("k", 10)), key=order)


def test_equals_brute_force(spark):
    docs = [(i, prose(rnd.randint(1, 80))) for i in range(300)]
    copy = prose(30)
    docs += [(i, copy) for i in range(1000, 1150)]  # ties, more than k of them
    items = [(i, prose(rnd.randint(1, 15))) for i in range(20)] + [(50, copy)]
    check(spark, docs, items)


def test_many_small_blocks_and_batches(spark, monkeypatch):
    """Blocks of a few documents and batches of a few items give the same; every term is asked for by several batches."""
    build = search.build_index
    monkeypatch.setattr(search, "build_index", lambda d, w: build(d, w, block_chars=300, block_rows=7, sieve_bits=64))
    docs = [(i, prose(rnd.randint(1, 40))) for i in range(120)]
    check(spark, docs, [(i, prose(8)) for i in range(15)], k=3, shares=(0.02, 0.1, 0.3), batch_items=4)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "...!?"), (4, "One one ONE two"), (4, "One one ONE two"), (None, "two three"), (None, "two four"), (5, "a\x00b é É"),
            (6, "two " * 100_000 + "three"), (7, "x" * 200_000)]
    items = [(1, "one two"), (1, "one two"), (1, "three"), (None, "two"), (2, None), (3, ""), (4, "absent"), (5, "é É b"), (6, "two two two")]
    check(spark, docs, items)


def test_words_in_every_document_score_nothing_more(spark):
    check(spark, [(i, "all " + VOCAB[i % 5]) for i in range(50)], [(1, "all"), (2, f"all {VOCAB[0]}")])


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, "...")], [(1, "a")]), ([], [])])
def test_empty_tables(spark, docs, items):
    check(spark, docs, items)


def test_sieve_only_lets_more_through(spark):
    asked = spark.createDataFrame([(w,) for w in VOCAB[:40]], "term string")
    hits = search._Wanted(search._sieve(asked, 1 << 12))
    assert all(hits[w.encode()] for w in VOCAB[:40])
    assert sum(hits[f"other{i}".encode()] for i in range(2000)) < 200


def test_terms_agree_with_the_pattern(spark):
    odd = ["aB9z", "a-b_c`d@e[f{g~h", "naïve ÀB 中文。x", "\x7f\x80 \u0085a\xa0b", "１2"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "item_id long, text string")
    rows = search.item_terms(got).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("t")).collect()
    assert {r["item_id"]: r["t"] for r in rows} == {i: sorted({t.decode() for t in search.terms(x)}) for i, x in enumerate(odd)}
    assert all([t.decode() for t in search.terms(x)] == words(x) for x in odd)
