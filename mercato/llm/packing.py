"""Best-fit packing of documents into sequences by bin completion over the histogram of piece lengths.

Texts are encoded once, in the scan; only piece lengths and checksums go on.
Pieces of one length are interchangeable, so the search works on the counts of
the at most ``capacity`` lengths, a state of fixed size, and finds patterns
(fillings of one sequence) with multiplicities.  Pieces then get their places by
rank within their length: ranks are taken per (length, bucket), and a frequent
length has as many buckets as its count needs, so no length is one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.bpe import encoder
from mercato.llm.common import materialize, ready, slices

Filling = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


@dataclass
class Pattern:
    filling: Filling
    times: int


def bound(counts: dict[int, int], capacity: int) -> int:
    """Least number of sequences that any packing needs (the larger of the volume bound and Martello and Toth's)."""
    total = sum(n * k for n, k in counts.items())
    best = -(-total // capacity)
    for cut in {n for n in counts if 2 * n <= capacity} | {0}:
        large = sum(k for n, k in counts.items() if n > capacity - cut)
        middle = sum(k for n, k in counts.items() if capacity - cut >= n > capacity / 2)
        free = middle * capacity - sum(n * k for n, k in counts.items() if capacity - cut >= n > capacity / 2)
        rest = sum(n * k for n, k in counts.items() if capacity / 2 >= n >= max(cut, 1))
        best = max(best, large + middle + max(0, -(-(rest - free) // capacity)))
    return best


def _fill(lengths: list[int], counts: dict[int, int], room: int, skip: int = 0) -> list[tuple[int, int]]:
    """The undominated filling of ``room`` with the least waste (the ``skip``-th further waste level for ``skip`` > 0).

    Reachable sums of all lengths up to each one are bit sets; among the fillings
    of one sum the lexicographically largest is taken, whose documents cannot be
    exchanged for longer ones of the same total, so no other filling dominates it.
    """
    usable = [n for n in lengths if n <= room]  # ascending
    mask = (1 << (room + 1)) - 1
    reach, by = 1, []
    for n in usable:
        by.append(reach)
        left, step = min(counts[n], room // n), 1
        while left:
            k = min(step, left)
            reach |= (reach << (n * k)) & mask
            left -= k
            step *= 2
    for _ in range(skip):
        reach &= ~(1 << (reach.bit_length() - 1))
    if not reach:
        return [(-1, 0)]
    target, out = reach.bit_length() - 1, []
    for n, below in zip(reversed(usable), reversed(by)):
        for k in range(min(counts[n], target // n), -1, -1):
            if below >> (target - n * k) & 1:
                if k:
                    out.append((n, k))
                target -= n * k
                break
    return out


def _best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """First incumbent: around the largest length, the largest that still fits, again and again."""
    left, out = dict(counts), []
    order = sorted(left, reverse=True)
    while any(left.values()):
        first = next(n for n in order if left[n])
        room, filling = capacity - first, {first: 1}
        for n in order:
            k = min(left[n] - filling.get(n, 0), room // n)
            if k:
                filling[n] = filling.get(n, 0) + k
                room -= n * k
        out.append(_apply(tuple(filling.items()), left))
    return out


def _apply(filling: Filling, left: dict[int, int]) -> Pattern:
    times = min(left[n] // k for n, k in filling)
    for n, k in filling:
        left[n] -= k * times
    return Pattern(filling, times)


def search(counts: dict[int, int], capacity: int, nodes: int = 6000) -> list[Pattern]:
    """Patterns that use every piece once, in as few sequences as the search finds.

    Branch and bound: a node fills the sequence of the largest piece left, as
    often as the counts allow; children are the undominated fillings by rising
    waste; a branch is cut when its waste rules out fewer sequences than the
    incumbent.  Ends at the lower bound or after ``nodes`` nodes beyond the first
    dive (the effort spent on improving, never on leaving pieces out).
    """
    counts = {n: k for n, k in counts.items() if k}
    if not counts:
        return []
    total, least = sum(n * k for n, k in counts.items()), bound(counts, capacity)
    best = _best_fit(counts, capacity)
    best_n = sum(p.times for p in best)
    stack = [(dict(counts), [], 0, 0)]  # counts left, patterns, waste, which filling is next
    seen, dived = 0, False
    while stack and best_n > least and (seen < nodes or not dived):
        left, made, waste, skip = stack.pop()
        seen += dived
        if not left:
            dived = True
            n = sum(p.times for p in made)
            if n < best_n:
                best, best_n = made, n
            continue
        if dived and waste > (best_n - 1) * capacity - total:
            continue
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        lengths = sorted(n for n, k in rest.items() if k)
        filled = _fill(lengths, rest, capacity - first, skip)
        if filled == [(-1, 0)]:
            continue
        if skip < 2:
            stack.append((left, made, waste, skip + 1))
        merged = {first: 1}
        for n, k in filled:
            merged[n] = merged.get(n, 0) + k
        after = dict(left)
        pattern = _apply(tuple(merged.items()), after)
        lost = (capacity - sum(n * k for n, k in pattern.filling)) * pattern.times
        stack.append(({n: k for n, k in after.items() if k}, [*made, pattern], waste + lost, 0))
    return best


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Ranges of ranks: pieces of ``length`` ranked ``start`` on fill ``each`` places per sequence from ``sequence``, ``offset`` on."""
    rows, used, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for n, k in p.filling:
            rows.append((n, used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * p.times
            offset += n * k
        sequence += p.times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "start", "each", "sequence", "offset"), cols))


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids plus ``end_id``.

    A document longer than ``capacity`` is cut into pieces of ``capacity`` ids of
    which the first may be shorter; others are one piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(path), int(end_id).to_bytes(4, "little")
        for b in slices(batches, "text"):
            ids, out = b.column("doc_id"), []
            for i, text in enumerate(b.column("text").to_pylist()):
                data = enc.ids(text or "") + last
                n = len(data) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(i, j, lo, hi - lo, zlib.crc32(data[4 * lo:4 * hi])) for j, (lo, hi) in enumerate(zip(edges, edges[1:]))]
            row, piece, start, length, crc = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, bucket_rows: int = 100_000) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences are gapless from offset 0.

    Null text is an empty document of one id.  Repeated rows are documents of
    their own, each packed once.  Pieces of equal length are ranked by (bucket,
    doc_id, piece), which fixes ties.  Extra columns are ignored; an empty table
    gives no row.  ``bucket_rows``: pieces of one length that one bucket ranks, on average.
    """
    ready(docs.sparkSession)
    made = materialize(pieces(docs, path, capacity, end_id))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    place = places(search(counts, capacity))
    n_buckets = F.element_at(F.array(*[F.lit(-(-counts.get(n, 0) // bucket_rows) or 1) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), n_buckets.cast("long")))
    before = (dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = int(place["start"].max(initial=0)) + 1
        key = place["length"] * wide + place["start"]
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, n * wide + np.minimum(rank, wide - 1), side="right") - 1
            j, each = rank - place["start"][at], place["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(place["sequence"][at] + j // each), pa.array(place["offset"][at] + j % each * n)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
