"""Ranked lexical search by pipelined term partitioning.

The index cuts the documents into blocks and holds, per block and term, the places
and counts of the term's documents.  Terms belong to owners by their share of all
documents, rare terms first.  A bundle is one item in one block with a sparse list
of documents and scores; it passes the owners one after the other.  Each owner adds
the integer contributions of its terms (a cogroup of bundles and postings by block)
and passes on what can still be among the best ``k``: a document whose score plus all
that later owners could add stays below ``k`` others of its block is left out, which
changes no result.  The last owner selects the best of each block, a window over
those the best of all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import materialize, ready, slices

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the characters of a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A contribution without its weight is below this, whatever the counts.
MOST = 1_000_000
# bytes that are not part of a term become blanks, A-Z lower case; bytes of other characters stay
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term, times`` of the distinct items (item_id, text); items without a term have no row."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOW), F.lit(TERM), F.lit(0))
    one = materialize(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    return one.select("item", "item_id", F.explode(found).alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def _sieve(wanted: DataFrame, bits: int) -> bytes:
    """``bits`` bits in which the terms of ``wanted`` are marked; whatever their number, no more goes to the driver."""
    at = wanted.select(F.pmod(F.xxhash64(F.col("term").cast("binary")), F.lit(bits)).alias("at"))
    marks = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for r in marks.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.tobytes()


class _Wanted(dict):
    """term -> whether the sieve lets it pass; remembers a bounded number of terms."""

    def __init__(self, sieve: bytes, most: int = 300_000):
        super().__init__()
        self.sieve, self.bits, self.most = sieve, 8 * len(sieve), most

    def __missing__(self, term: bytes) -> bool:
        at = xxhash.xxh64_intdigest(term, 42) % self.bits  # the size is a power of two: the sign makes no difference
        got = bool(self.sieve[at >> 3] >> (at & 7) & 1)
        if len(self) < self.most:
            self[term] = got
        return got


def build_index(docs: DataFrame, wanted: DataFrame, block_chars: int = 4_000_000, block_rows: int = 50_000, sieve_bits: int = 1 << 23) -> DataFrame:
    """``block, term, at, tf, n, ids`` over all documents, written once.

    A row with a term holds the places ``at`` of its documents in the block, its
    counts ``tf`` there and their lengths ``n`` in terms.  The row without a term
    holds the ``ids`` and ``n`` of all documents of the block that have a term, by
    ascending id, null last; a place is an index into it.  Terms outside ``wanted`` (``term``)
    mostly have no row: a sieve of fixed size leaves them out before anything is written.
    """
    sieve = _sieve(wanted.select("term").distinct(), sieve_bits)
    schema = docs.schema["doc_id"].dataType
    names = ["block", "term", "at", "tf", "n", "ids"]

    def block_of(block: int, held: list, id_type: pa.DataType, hits: _Wanted) -> pa.RecordBatch:
        held.sort(key=lambda d: (d[0] is None, 0 if d[0] is None else d[0]))
        post: dict[bytes, list] = {}
        for at, (_, n, counts) in enumerate(held):
            for term, tf in counts.items():
                post.setdefault(term, []).append((at, tf, n))
        rows = [np.array(p, np.int64).T for p in post.values()]
        ends = np.cumsum([0] + [r.shape[1] for r in rows] + [0]).astype(np.int32)
        flat = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), np.int64)
        every = np.array([d[1] for d in held], np.int64)
        n_ends = ends.copy()
        n_ends[-1] += len(every)
        lists = [pa.ListArray.from_arrays(ends, pa.array(flat[i], pa.int32() if i < 2 else pa.int64())) for i in (0, 1)]
        lists.append(pa.ListArray.from_arrays(n_ends, pa.array(np.concatenate([flat[2], every]), pa.int64())))
        ids = pa.array([None] * len(rows) + [[d[0] for d in held]], pa.list_(id_type))
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * (len(rows) + 1), pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for t in post] + [None], pa.string()), *lists, ids], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Wanted(sieve)
        block = TaskContext.get().partitionId() << 32
        held, chars, id_type = [], 0, pa.null()
        for b in slices(batches, "text"):
            id_type = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = Counter(terms(text))
                if not found:
                    continue
                held.append((doc_id, sum(found.values()), {t: c for t, c in found.items() if hits[t]}))
                chars += len(text)
                if chars >= block_chars or len(held) >= block_rows:
                    yield block_of(block, held, id_type, hits)
                    held, chars, block = [], 0, block + 1
        if held:
            yield block_of(block, held, id_type, hits)

    out = f"block long, term string, at array<int>, tf array<int>, n array<long>, ids array<{schema.simpleString()}>"
    return materialize(docs.select("doc_id", "text").mapInArrow(run, out))


def weigh(asked: DataFrame, index: DataFrame, n_docs: int, shares: tuple[float, ...]) -> DataFrame:
    """``asked`` with the weight ``w`` and owner of each term; terms of no document or without weight go."""
    df = index.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("at")).alias("df"))
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    owner = sum(((F.col("df") > s * n_docs).cast("int") for s in shares), F.lit(0))
    return asked.join(df, "term").withColumns({"w": w, "owner": owner}).where("w > 0")


def _add(k: int, final: bool, n_docs: int, n_terms: int):
    """The work of one owner on one block: bundles + postings -> bundles."""
    names = ["block", "batch", "item", "at", "score"]

    def lists(t: pa.Table, name: str) -> list[np.ndarray]:
        c = t.column(name).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        ends, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def run(key: tuple, bundles: pa.Table, postings: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}  # item -> (places, contributions) and what later owners may add
        rest: dict[int, int] = {}
        if bundles.num_rows:
            for item, at, score in zip(bundles.column("item").to_pylist(), lists(bundles, "at"), lists(bundles, "score")):
                parts.setdefault(item, []).append((at, score))
        if postings.num_rows:
            for w, items, at, tf, n in zip(postings.column("w").to_pylist(), postings.column("items").to_pylist(), lists(postings, "at"),
                                           lists(postings, "tf"), lists(postings, "n")):
                tf = tf.astype(np.int64)
                m = 25 + (75 * n * n_docs) // n_terms
                x = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                for i in items:
                    parts.setdefault(i["item"], []).append((at, i["times"] * x))
                    rest[i["item"]] = i["rest"]
        size = 1 + max((int(at[-1]) for p in parts.values() for at, _ in p if len(at)), default=-1)
        items, places, scores = [], [], []
        for item, found in parts.items():
            total = np.zeros(size, np.int64)
            for at, x in found:
                total[at] += x
            at = np.flatnonzero(total > 0)
            score = total[at]
            if len(at) > k:
                least = np.partition(score, len(at) - k)[len(at) - k]
                if final:  # equal scores by place, which is by id
                    best = np.sort(np.lexsort((at, -score))[:k])
                    at, score = at[best], score[best]
                elif item in rest:
                    may = score + rest[item] >= least
                    at, score = at[may], score[may]
            if len(at):
                items.append(item)
                places.append(at)
                scores.append(score)
        ends = pa.array(np.cumsum([0] + [len(a) for a in places]), pa.int32())
        flat = [pa.array(np.concatenate(v) if v else [], t) for v, t in ((places, pa.int32()), (scores, pa.int64()))]
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()] * len(items), pa.int64()), pa.array([key[1].as_py()] * len(items), pa.int32()), pa.array(items, pa.int64()),
             *[pa.ListArray.from_arrays(ends, f) for f in flat]], names)

    return run


_BUNDLE = "block long, batch int, item long, at array<int>, score array<long>"


def search(docs: DataFrame, items: DataFrame, k: int = 10, shares: tuple[float, ...] = (0.01, 0.1), batch_items: int = 256) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0, equal scores by ascending doc_id.

    Every row of ``docs`` is a document of its own, repeated rows and null ids
    included (null ids come last among equals).  Rows of ``items`` that agree in id
    and text are one item; different texts under one id, null included, are ranked
    apart.  Null and empty texts have no terms.  Texts of any length are read whole,
    other columns are ignored, an empty table on either side gives no row.

    A block holds some 4 MB of text and a batch some 256 items, so one task group is
    bounded whatever a term's share of the documents.  Only ``k`` rows per item and
    block reach the last selection.
    """
    spark = ready(docs.sparkSession)
    asked = materialize(item_terms(items))
    index = build_index(docs, asked)
    per_block = index.where("term IS NULL").select(F.size("n").cast("long").alias("docs"), F.expr("aggregate(n, 0L, (a, x) -> a + x)").alias("terms"))
    n_docs, n_terms = per_block.agg(F.sum("docs"), F.sum("terms")).first()
    id_type = index.schema["ids"].dataType.elementType
    if not n_docs:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(id_type).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    weighed = materialize(weigh(asked, index, n_docs, shares))
    batches = max(1, -(-weighed.select("item").distinct().count() // batch_items))
    bundles = spark.createDataFrame([], _BUNDLE)
    for owner in range(len(shares) + 1):
        later = weighed.where(F.col("owner") > owner).groupBy("item").agg((F.sum(F.col("w") * F.col("times")) * MOST).alias("rest"))
        own = weighed.where(F.col("owner") == owner).join(later, "item", "left").withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int"))
        own = own.groupBy("term", "w", "batch").agg(F.collect_list(F.struct("item", "times", F.coalesce("rest", F.lit(0)).alias("rest"))).alias("items"))
        postings = index.where("term IS NOT NULL").select("block", "term", "at", "tf", "n").join(own, "term")
        postings = postings.select("block", "batch", "w", "items", "at", "tf", "n")
        work = _add(k, owner == len(shares), n_docs, n_terms)
        bundles = bundles.groupBy("block", "batch").cogroup(postings.groupBy("block", "batch")).applyInArrow(work, _BUNDLE)
    ids = index.where("term IS NULL").select("block", "ids")
    named = F.transform("at", lambda at: F.get("ids", at)).alias("doc_id")
    best = bundles.join(ids, "block").select("item", named, "score").select("item", F.inline(F.arrays_zip("doc_id", "score")))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(weighed.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
