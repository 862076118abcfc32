"""Admission under several unique keys equals a row-by-row replay, on chains and on hot keys too."""

import datetime as dt
import random

from mercato.operators import admission

SCHEMA = "n bigint, at timestamp, a string, b string, c int, _row string"
KEYS = [("a_key", ["a"]), ("bc_key", ["b", "c"])]


def replay(rows, stored=()):
    held = {("a", r[0]) for r in stored if r[0] is not None} | {("bc", r[1], r[2]) for r in stored if None not in r[1:]}
    out = {}
    for n, at, a, b, c, *_ in sorted(rows, key=lambda r: (r[1] or dt.datetime.min, r[0])):
        own = ([("a", a)] if a is not None else []) + ([("bc", b, c)] if b is not None and c is not None else [])
        hit = [k for k in own if k in held]
        out[n] = None if not hit else "a_key" if hit[0][0] == "a" else "bc_key"
        if not hit:
            held.update(own)
    return out


def run(spark, rows, stored=None, **kw):
    target = None if stored is None else spark.createDataFrame(stored, "a string, b string, c int")
    got = admission.admit(spark.createDataFrame(rows, SCHEMA), KEYS, "at", "n", target, **kw).collect()
    assert all(r.accepted == (r.reason is None) for r in got) and len(got) == len(rows)
    return {r.n: r.reason for r in got}


def test_random_batches_with_a_hot_key_and_stored_rows(spark):
    rnd = random.Random(3)
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(200)) for _ in range(400)]
    rows = [(n, None if n % 97 == 0 else t[n], rnd.choice([None, "hot", f"a{rnd.randrange(120)}", f"a{rnd.randrange(120)}"]),
             rnd.choice([None, "b", f"b{rnd.randrange(60)}"]), rnd.choice([None, 1, 2]), "x") for n in range(400)]
    stored = [("a1", "b", 9), (None, "b2", 1), ("a5", None, 2)]
    assert run(spark, rows, stored, at_once=7) == replay(rows, stored)


def test_a_chain_takes_length_by_at_once_rounds(spark, monkeypatch):
    # row i asks for what row i - 1 asks for under the other key: every second one is accepted
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at, f"k{i // 2}", f"m{(i + 1) // 2}", 1, "x") for i in range(120)]
    rounds, settle = [], admission._settle
    monkeypatch.setattr(admission, "_settle", lambda *a: rounds.append(1) or settle(*a))
    got = run(spark, rows, at_once=60)
    assert got == replay(rows)
    assert sum(r is None for r in got.values()) == 60
    assert len(rounds) <= 1 + 2


def test_many_short_chains_need_no_components(spark, monkeypatch):
    at = dt.datetime(2024, 1, 1)
    rows = [r for g in range(60) for r in ((3 * g, at, f"a{g}", None, None, "x"), (3 * g + 1, at, f"a{g}", f"b{g}", 1, "x"), (3 * g + 2, at, None, f"b{g}", 1, "x"))]
    monkeypatch.setattr(admission, "components", lambda edges: 1 / 0)
    assert run(spark, rows, at_once=7) == replay(rows)


def test_a_refused_row_blocks_nobody(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, "p", "q", 1, "x"), (2, at, "p", "r", 1, "x"), (3, at, "s", "r", 1, "x"), (4, at, "s", "q", 1, "x")]
    assert run(spark, rows) == {1: None, 2: "a_key", 3: None, 4: "a_key"}


def test_ties_nulls_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [], []) == {}
    twins = [(7, None, "p", None, None, "x")] * 3 + [(8, None, None, None, 1, None)] * 2
    got = admission.admit(spark.createDataFrame(twins, SCHEMA), KEYS, "at", "n").collect()
    assert sorted((r.n, r.accepted) for r in got) == [(7, False), (7, False), (7, True), (8, True), (8, True)]
    assert tuple(got[0].__fields__) == ("n", "at", "a", "b", "c", "_row", "accepted", "reason")
