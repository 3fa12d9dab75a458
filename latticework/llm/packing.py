"""Packing documents into as few fixed-size sequences as possible: dominance reduction, then best fit.

Texts are encoded where they are read; what is written is a row of numbers for each piece (a document, or a part of one
that is longer than a sequence). Pieces of equal length are alike, so an instance is a histogram: a count for each length up to the
capacity, whatever the number of documents. On it

* the dominance criterion of Martello and Toth fixes sets of one to three pieces. A set F with piece j dominates a set G with j if
  the other pieces of G can be dealt out to pieces of F that are no shorter than what they get; then some best packing has F.
  Removing pieces takes alternatives away and adds none, so a set is fixed as many times at once as its pieces last;
* best fit, by falling length, packs the rest: a piece goes to the fullest sequence with room. Sequences of equal contents go together.

A plan has as many kinds of sequences as lengths, within a small factor: its table is bounded by the capacity, not by the data. A piece's
number among those of its length (its number in its task, and how many the tasks before have of that length) finds its
sequence and its place there. No length's pieces meet in one task.

Defined cases: a null text counts as empty (the end id only); null and repeated ids and repeated rows are documents of their own;
an empty table gives an empty result; a text of any length is encoded whole; other columns are not read. Which of equally long pieces goes where may differ between runs; the number of sequences does not.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.llm.bpe import loaded
from latticework.llm.common import release, text_or_empty, written

TEXTS_AT_ONCE = 1024

_PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, k long"


def _set_for(n: np.ndarray, j: int) -> tuple[int, ...] | None:
    """Lengths (j first) of a set that dominates all others with a piece of length j, or None where none is found. n: counts by length."""
    room = len(n) - 1 - j
    left = n.copy()
    left[j] -= 1
    fits = np.flatnonzero(left[: room + 1])  # lengths that fit beside it, ascending; index 0 has no pieces
    if not len(fits):
        return (j,)
    a = int(fits[-1])
    least = np.repeat(fits[:3], np.minimum(left[fits[:3]], 3))[:3]  # the three shortest pieces
    if a == room or len(least) < 2 or least[:2].sum() > room:
        return j, a  # one more fits at most, or the best one fills the sequence
    if len(least) > 2 and least.sum() <= room:
        return None  # three more fit
    upto = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))  # the longest piece up to each length
    partner = upto[np.minimum(room - fits, fits)]  # the shorter of a pair
    same = (partner == fits) & (left[fits] < 2)
    partner = np.where(same, upto[np.maximum(fits - 1, 0)], partner)
    if (fits + partner)[partner > 0].max(initial=0) <= a:
        return j, a
    left[a] -= 1
    b = np.flatnonzero(left[: room - a + 1])
    left[a] += 1
    if not len(b):
        return None
    b = int(b[-1])
    longer = fits[fits > b]
    two = np.repeat(longer[:2], np.minimum(left[longer[:2]], 2))[:2]
    # every pair has a piece of b at most (the other is a at most), unless two pieces over b fit
    return (j, a, b) if len(two) < 2 or two.sum() > room else None


def dominance(counts: np.ndarray) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], np.ndarray]:
    """Sets to fix, as (((length, how many), ...), times), and the counts that are left. ``counts[l]``: pieces of length l."""
    n, fixed, changed = counts.astype(np.int64).copy(), [], True
    while changed:
        changed = False
        for j in np.flatnonzero(n)[::-1].tolist():
            while n[j] and (found := _set_for(n, j)) is not None:
                many = {x: found.count(x) for x in found}
                times = min(int(n[x]) // k for x, k in many.items())
                if len(found) == 1 and j <= len(n) - 1 - j:
                    times = 1  # the last of a length that would fit beside another
                for x, k in many.items():
                    n[x] -= k * times
                fixed.append((tuple(many.items()), times))
                changed = True
    return fixed, n


def best_fit(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Sequences as (contents, how many), by best fit in falling order of length."""
    capacity = len(counts) - 1
    by_room: list[dict] = [{} for _ in range(capacity + 1)]

    def put(contents, many: int, room: int) -> None:
        if many:
            by_room[room][contents] = by_room[room].get(contents, 0) + many

    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        for room in range(size, capacity + 1):
            if not n:
                break
            each = room // size
            for contents, many in list(by_room[room].items()):
                full = min(many, n // each)
                rest = n - full * each if full < many else 0
                rest = min(rest, each)
                left = many - full - (rest > 0)
                if left:
                    by_room[room][contents] = left
                else:
                    del by_room[room][contents]
                put((*contents, (size, each)), full, room - each * size)
                if rest:
                    put((*contents, (size, rest)), 1, room - rest * size)
                n -= full * each + rest
                if not n:
                    break
        each = capacity // size
        put(((size, each),), n // each, capacity - each * size)
        if n % each:
            put(((size, n % each),), 1, capacity - (n % each) * size)
    return [(contents, many) for groups in by_room for contents, many in groups.items()]


@dataclass
class Plan:
    """Where the k-th piece of each length goes: runs (key, first, base, each, offset), a bounded table."""

    capacity: int
    sequences: int
    fixed: int
    runs: np.ndarray

    def find(self, length: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        key, first, base, each, offset = self.runs[np.searchsorted(self.runs[:, 0], length << 44 | k, side="right") - 1].T
        nth = k - first
        return base + nth // each, offset + nth % each * length


def plan(counts: np.ndarray) -> Plan:
    """The packing of ``counts[l]`` pieces of each length l into sequences of ``len(counts) - 1``."""
    fixed, rest = dominance(counts)
    used, base, runs = np.zeros(len(counts), np.int64), 0, []
    for contents, many in fixed + best_fit(rest):
        offset = 0
        for size, each in contents:
            runs.append((size << 44 | int(used[size]), int(used[size]), base, each, offset))
            used[size] += each * many
            offset += size * each
        base += many
    if (used != counts).any():
        raise RuntimeError("the plan does not hold every piece once")
    return Plan(len(counts) - 1, base, sum(t for _, t in fixed), np.array(sorted(runs), np.int64).reshape(-1, 5))


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """A written table of pieces (part, doc_id, piece, start, length, ids_crc32, k) and its path: k is a piece's number among those of
    its length in its task, ``part``."""

    def run(batches):
        from pyspark import TaskContext

        bpe = loaded(path, pattern)
        part, tail, seen = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), bpe.encode(some.column(1).to_pylist())):
                    ids += tail
                    n, a, piece = len(ids) // 4, 0, 0
                    while a < n:
                        size = (n - a - 1) % capacity + 1
                        rows.append((part, doc, piece, a, size, zlib.crc32(memoryview(ids)[4 * a : 4 * (a + size)]), seen[size]))
                        seen[size] += 1
                        a, piece = a + size, piece + 1
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _PIECES.split(", ")])
        release()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return written(given.mapInArrow(run, _PIECES), "pieces")


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Plan]:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset; and the plan (``sequences``: how many there are, ``fixed``:
    how many of them by dominance). The histogram of ``capacity`` counts is all that comes to the driver."""
    pieces, _ = token_pieces(docs, path, pattern, capacity, end_id, id_col, text_col)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("length").count().collect():
        counts[size] = n
    packing = plan(counts)
    in_task = pieces.groupBy("length", "part").agg((F.max("k") + 1).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = in_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("base") + F.col("k")).alias("k"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            where = packing.find(*(batch.column(c).to_numpy() for c in ("length", "k")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(w, pa.int64()) for w in where)], names=[c.split()[0] for c in schema.split(", ")])

    return numbered.mapInArrow(place, schema).withColumnRenamed("doc_id", id_col), packing
