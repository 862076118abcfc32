"""Passages at any position, rows without an id of their own, and the stages of the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from mercato.llm import quality, simhash, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = ["".join(random.Random(i).choice("abcdefghij") for _ in range(2 + i % 7)) + str(i) for i in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


# -- repeated passages --------------------------------------------------------

def wrapped(text: str, n: int) -> str:
    ws = text.split()
    return "\n".join(" ".join(ws[i:i + n]) for i in range(0, len(ws), n))


def removed_by_brute_force(texts: list[tuple[int, str]], n: int) -> dict[int, set[int]]:
    """Word numbers by document that lie in a window of ``n`` words found before."""
    first, out = {}, {}
    for i, t in sorted(texts):
        ws = t.lower().split()
        for at in range(len(ws) - n + 1):
            j, b = first.setdefault(tuple(ws[at:at + n]), (i, at))
            if j != i or at >= b + n:
                out.setdefault(i, set()).update(range(at, at + n))
    return out


def test_passages_at_any_position(spark):
    p, q, r = prose(55, 1), prose(59, 2), prose(51, 3)
    texts = [(1, f"{prose(40, 10)} {p} {prose(40, 11)}"),  # in mid-line
             (2, f"{prose(30, 12)} {p.upper()} {prose(60, 13)}"),
             (3, f"{prose(90, 14)}\n{wrapped(q, 7)}\n{prose(30, 15)}"),  # over short lines
             (4, f"{prose(25, 16)} {q} {prose(70, 17)}"),
             (5, f"{prose(80, 18)} {r} {prose(80, 19)} {r}"),  # twice in one line
             (6, wrapped(f"{prose(9, 20)} {r} {prose(12, 21)}", 5)),
             (7, "la " * 300)]
    df = table(spark, texts)
    want = removed_by_brute_force(texts, 50)
    got = {}
    for x in substring.repeated_passages(df).where("removed").collect():
        text = dict(texts)[x.doc_id]
        begin = len(text[:x.start].split())
        got.setdefault(x.doc_id, set()).update(range(begin, begin + x.n_words))
        assert len(text[x.start:x.end].split()) == x.n_words and text[:x.start].count("\n") == x.paragraph
    assert got == want and set(want) == {2, 4, 5, 6, 7}
    cut = {x.doc_id: x.text for x in substring.cut_repeats(df).collect()}
    assert cut[1] == texts[0][1] and cut[3] == texts[2][1]
    assert cut[2] == f"{prose(30, 12)} {prose(60, 13)}" and cut[4] == f"{prose(25, 16)} {prose(70, 17)}"
    assert cut[5] == f"{prose(80, 18)} {r} {prose(80, 19)}" and cut[6].split() == f"{prose(9, 20)} {prose(12, 21)}".split()
    assert cut[7].split() == ["la"] * 50


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    passages, texts = [prose(r.randint(40, 70), 1000 + 10 * seed + i).split() for i in range(8)], []
    for i in range(30):
        ws = []
        for _ in range(r.randint(1, 3)):
            ws += prose(r.randint(0, 30), 5000 + 100 * seed + 3 * i + len(ws)).split()
            one = r.choice(passages)
            ws += one[r.randint(0, 4):len(one) - r.randint(0, 4)]
        texts.append((i, "".join(w + r.choice(["  ", " ", "\n", "\t"]) for w in ws)))
    want = removed_by_brute_force(texts, 50)
    got = {}
    for x in substring.repeated_passages(table(spark, texts), min_words=10_000).where("removed").collect():
        begin = len(dict(texts)[x.doc_id][:x.start].split())
        got.setdefault(x.doc_id, set()).update(range(begin, begin + x.n_words))
    assert got == want and want


def test_window_keys():
    import numpy as np

    for n in (1, 2, 3, 20, 50):
        h = np.random.default_rng(n).integers(0, 4, 400, np.uint64)
        by = {}
        keys = substring.window_keys(h, n)
        assert len(keys) == 401 - n and len(substring.window_keys(h[:n - 1], n)) == 0
        for i, k in enumerate(keys):
            by.setdefault(int(k), set()).add(tuple(h[i:i + n]))
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({tuple(h[i:i + n]) for i in range(401 - n)})


def test_runs_reach_beyond_a_removed_line(spark):
    a, line, b = prose(15, 1).split(), prose(22, 2), prose(18, 3).split()
    texts = [(i, f"{prose(60, 30 + i)} {' '.join(a)}\n{line}\n{' '.join(b)} {prose(60, 40 + i)}") for i in (1, 2)]
    cut = {x.doc_id: x.text for x in substring.cut_repeats(table(spark, texts)).collect()}
    assert cut[1] == texts[0][1] and cut[2] == f"{prose(60, 32)}\n{prose(60, 42)}"


# -- rows without an id of their own ------------------------------------------

def test_rows_without_an_id_of_their_own(spark):
    p, one = prose(60, 90), [prose(70, 100 + i) for i in range(4)]
    texts = [(None, f"{one[0]}\n{p}"), (None, f"{p}\n{one[1]}\n{one[2]}"), (None, one[3]), (None, one[3]), (None, "junk"),
             (5, prose(80, 110)), (5, prose(80, 111)), (5, "junk"), (6, prose(80, 110)), (None, prose(80, 111))]
    df = table(spark, texts)
    kept = sorted((str(x.doc_id), x.text) for x in quality.keep(df).collect())
    assert kept == sorted((str(i), t) for i, t in texts if t != "junk")
    left = sorted((str(x.doc_id), x.text) for x in simhash.first_of_each(df).collect())
    assert left == sorted([("None", texts[0][1]), ("None", texts[1][1]), ("None", one[3]), ("5", prose(80, 110)), ("5", prose(80, 111)), ("5", "junk")])
    cut = sorted(x.text for x in substring.cut_repeats(df.where("doc_id IS NULL")).collect())
    first = min(0, 1, key=lambda i: _key(spark, texts[i][1]))
    assert cut == sorted([texts[0][1] if first == 0 else one[0], texts[1][1] if first == 1 else f"{one[1]}\n{one[2]}",
                          one[3], one[3], "junk", prose(80, 111)])


def _key(spark, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t) AS k").first().k


# -- the pipeline's mix -------------------------------------------------------

def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    r = random.Random(5)
    clean = [(i, prose(r.randint(40, 90), 2000 + i)) for i in range(400)]
    toxic = [(i, f"{prose(60, 3000 + i)} awful {prose(9, i)}") for i in range(1000, 1050)]  # every second is labelled
    toxic += [(2000, prose(60, 4000)), (None, f"{prose(60, 4001)} awful")]  # a label without a marker word, a marker word without an id
    rows = [(i, int(i % 5 != 0), 0) for i, _ in clean[:300]] + [(i, 0, 1) for i, _ in toxic[:50:2]] + [(2000, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, clean + toxic + [(None, prose(60, 4002))])
    kept = sorted(x.text for x in corpus_pipeline.mix_to_targets(spark, docs, str(tmp_path)).collect())
    assert kept == sorted([t for _, t in clean] + [prose(60, 4002)])


def test_words_of_a_column_equal_those_of_each_text():
    texts = [None, "", "one", "one Two", " é中 \U0001f600 b\n\nc\x0bD", "x" * 70_000 + " y", "ab " * 40_000, "two"]
    w = substring._Words(pa.array(["left out", *texts]).slice(1))
    lists = [substring.paragraph_words(t or "") for t in texts]
    flat = [x for ws in lists for x in ws]
    assert np.diff(w.first).tolist() == [len(ws) for ws in lists]
    assert w.hashes(np.ones(len(flat), bool)).tolist() == [xxhash.xxh64_intdigest(x) for x in flat]
    quick = w.quick().tolist()
    assert len(set(quick)) == len(set(flat)) == len(set(zip(quick, flat)))
    for i, t in enumerate(texts):
        own = slice(w.first[i], w.first[i + 1])
        starts, ends = (w.chars(p[own]) - w.chars(w.texts[i:i + 1]) for p in (w.starts, w.ends))
        assert [(t or "")[a:b].lower().encode() for a, b in zip(starts, ends)] == [x.decode().lower().encode() for x in lists[i]]
        assert (w.breaks(w.starts[own]) - w.breaks(w.texts[i:i + 1])).tolist() == [t[:a].count("\n") for a in starts]


def test_only_texts_with_removed_lines_are_shuffled(spark):
    ws = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*ws, f"own{i}", *ws[::-1]])) for i in range(30)] + [(None, " ".join(ws))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("doc_key"))
    gone = keyed.where("doc_id = 3 OR doc_id IS NULL").withColumn("gone", F.expr("array(named_struct('from', 0, 'to', 12))"))
    anchors = substring._repeated_anchors(docs, 6, 3)
    found = substring._intervals(docs, gone, anchors, 6, 3).select("doc_id", F.explode(F.transform("off", lambda x: F.col("at") + x)).alias("at"))
    got = {(r.doc_id, r.at) for r in found.collect()}
    wanted = {(i, at) for i in range(30) for at in [*range(7), *range(13, 20)] if not (i == 3 and at < 7)}
    assert wanted <= got and not {(3, at) for at in range(7)} & got and None not in {i for i, _ in got}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = substring._intervals(docs, gone, anchors, 6, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the texts are sifted below the exchange of the join
    assert "Union" in plan and plan.index("Exchange") < plan.index("may_have")
