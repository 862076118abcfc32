"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

Only distinct fingerprints enter the trie.  Its bits are reordered so that the
most balanced come first (Hamming distance does not depend on the order).  The
top levels are traversed in Spark: a fingerprint joins every pair of top nodes
its own node forms within the error budget.  Each pair of nodes is then one task
group, where pairs of sub-nodes are traversed together level by level, carrying
the differing bits so far and dropping a pair once they exceed the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import materialize, ready, slices
from mercato.llm.components import components, forest

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = 64


def fingerprint(text: str | None, shingle_words: int, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split: the six ASCII spaces
    if not ws:
        return 0
    k = shingle_words
    shingles = [b" ".join(ws)] if len(ws) < k else [b" ".join(s) for s in zip(*(ws[i:] for i in range(k)))]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``doc_id, fp`` per input row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle_words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp long")


def _reordered(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Bit ``order[0]`` of each fingerprint becomes the top bit, and so on."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="big")).view(">u8").ravel().astype(np.uint64)


def join_nodes(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int, at_once: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into sorted ``a`` and ``b``) at most ``budget`` bits apart.

    ``a`` and ``b`` each hold the fingerprints below one node of depth ``depth``;
    ``b`` None joins ``a`` with itself, each pair once.  At most ``at_once`` node
    pairs are expanded together, the others wait on a stack.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    d0 = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(_BITS - depth))) if depth else 0
    if d0 > budget:
        return
    one = np.uint64(1)
    stack = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(b))), np.array([d0]))]
    while stack:
        level, la, ha, lb, hb, d = stack.pop()
        if len(la) > at_once:
            stack += [(level, *(x[i:i + at_once] for x in (la, ha, lb, hb, d))) for i in range(0, len(la), at_once)]
            continue
        # below two small nodes the remaining bits of every pair are accumulated at once
        na, nb = ha - la, hb - lb
        small = (na * nb <= 8) | (level == _BITS)
        if small.any():
            for i in range(int(na[small].max())):
                for j in range(int(nb[small].max())):
                    ok = small & (na > i) & (nb > j)
                    x, y = la[ok] + i, lb[ok] + j
                    near = np.bitwise_count(a[x] ^ b[y]) <= budget
                    if own:
                        near &= x < y
                    if near.any():
                        yield x[near], y[near]
            la, ha, lb, hb, d = (v[~small] for v in (la, ha, lb, hb, d))
        if not len(la):
            continue
        bit = one << np.uint64(_BITS - 1 - level)
        high = ~((bit << one) - one) if level else np.uint64(0)
        ma = np.searchsorted(a, (a[la] & high) | bit)
        mb = np.searchsorted(b, (b[lb] & high) | bit)
        twin = (la == lb) & (ha == hb) if own else np.zeros(len(la), bool)
        kids = [(la, ma, lb, mb, d, None), (ma, ha, mb, hb, d, None), (la, ma, mb, hb, d + 1, None), (ma, ha, lb, mb, d + 1, ~twin)]
        nxt = []
        for l1, h1, l2, h2, dd, keep in kids:
            ok = (l1 < h1) & (l2 < h2) & (dd <= budget)
            ok = ok if keep is None else ok & keep
            nxt.append([v[ok] for v in (l1, h1, l2, h2, dd)])
        stack.append((level + 1, *(np.concatenate(v) for v in zip(*nxt))))


def _links(budget: int, depth: int, order: list[int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = int(pdf["u"].iloc[0]), int(pdf["v"].iloc[0])
        fps = pdf["fp"].to_numpy(np.int64)
        key = _reordered(fps.view(np.uint64), order)
        by = np.argsort(key)
        fps, key = fps[by], key[by]
        node = (key >> np.uint64(_BITS - depth)).astype(np.int64) if depth else np.zeros(len(key), np.int64)
        sa, sb = np.flatnonzero(node == u), np.flatnonzero(node == v)
        pairs = join_nodes(key[sa], None if u == v else key[sb], depth, budget)
        src, dst = forest(((sa[x], sa[y] if u == v else sb[y]) for x, y in pairs), len(fps))
        return pd.DataFrame({"a": fps[src], "b": fps[dst]})

    return run


def links(distinct: DataFrame, budget: int, node_size: int = 16384) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that connect just what pairs within ``budget`` bits connect.

    ``node_size``: fingerprints below a top node on average; it sets the depth
    that is traversed in Spark, and so the size of a task group, at any input size.
    """
    stats = distinct.agg(F.count("*").alias("n"), *[F.avg(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(_BITS)]).first()
    order = sorted(range(_BITS), key=lambda i: (abs((stats[f"b{i}"] or 0) - 0.5), i))
    depth = max(0, min(_BITS, int(np.ceil(np.log2(max(stats["n"], 1) / node_size))))) if stats["n"] else 0
    masks = [sum(1 << i for i in c) for k in range(min(budget, depth) + 1) for c in combinations(range(depth), k)]
    node = F.lit(0).cast("long")
    for place, i in enumerate(order[:depth]):
        node = node.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1)), depth - 1 - place))
    near = distinct.select("fp", node.alias("node")).select("fp", "node", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    pairs = near.select("fp", F.least("node", other).alias("u"), F.greatest("node", other).alias("v"))
    return pairs.groupBy("u", "v").applyInPandas(_links(budget, depth, order), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` (smallest doc_id reachable by links) per input row.

    Null text and text without words have fingerprint zero and are linked like
    any other.  A text shorter than a shingle is one shingle.  Repeated rows and
    equal texts share a fingerprint and so a component.  A null doc_id takes part
    in linking but never names a component, unless all of it is null.  Extra
    columns are ignored; an empty table gives no row.
    """
    ready(docs.sparkSession)
    fps = materialize(fingerprints(docs, shingle_words))
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(distinct.select("fp"), max_bits))  # id, component: fingerprints
    named = distinct.join(joined, distinct["fp"] == joined["id"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    named = materialize(named)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each component: smallest doc_id, and of different texts under it the smallest hash; of repeated rows one stays.

    A document is a (doc_id, text) pair, so rows without a doc_id are told apart
    by their texts; they stand for a component only if all of it is without one.
    """
    key = F.xxhash64("text")
    own = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), key.alias("text_key")).alias("doc_id"), "text")
    found = near_duplicates(own, shingle_words, max_bits).where("doc_id <=> component_id").select(
        F.col("doc_id.id").alias("kept_id"), F.col("doc_id.text_key").alias("kept_key")).distinct()
    kept = docs.join(found, docs["doc_id"].eqNullSafe(found["kept_id"]) & (F.xxhash64(docs["text"]) == found["kept_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
