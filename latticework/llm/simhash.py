"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Two fingerprints at distance 3 or less differ by at most one bit in
one of them, so they share a one-wildcard variant of that segment: the segment without bit i, i being the bit
that differs (any i where none does). Variants are equality-joined and the distance verified.

Only distinct fingerprints are indexed, so exact copies cost one member row each. A pair is kept at one variant
only: that of its differing bit, bit 0 where the segments are equal, the first segment where both fit. Variants
that hold many fingerprints (close copies by the thousand share a segment) are joined on a second signature as
well: the other segment is cut in two halves, one of which differs by at most one bit for the same reason, and its
one-wildcard variants are part of the key. Such a bucket's members agree in 46 bits. Nothing is capped: every
pair of a heavy variant meets at a second signature.

Linked pairs are folded to spanning forests batch by batch before they are shuffled.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero, which links like any other; a
text of one or two words is one shingle; equal ids are separate rows with the same id; null ids are kept, form no
component and get a null component_id unless a document with an id shares the component; very long texts are read whole, in pieces of shingles; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from latticework.llm.common import components, kept, n_partitions, row_key, shrink_edges, text_or_empty, written

HEAVY = 48  # members of a variant from which the second signature is used
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text: bit b is set if over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at ASCII white space only
    n, k = len(words), words_per_shingle
    if not n:
        return 0
    if n <= k:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        flat = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        hashes = [xxh64_intdigest(flat[a:b], seed) for a, b in zip((end - size)[: n - k + 1].tolist(), end[k - 1 :].tolist())]
    m, ones = len(hashes), np.zeros(64, np.int64)
    bits = np.array(hashes, "<u8").view(np.uint8).reshape(m, 8)
    for at in range(0, m, 1 << 14):
        ones += np.unpackbits(bits[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Rows (id, fp) and, with ``key_col``, its string as key: fp is the fingerprint as a signed long."""
    keys = [] if key_col is None else [F.col(key_col).cast("string").alias("key")]

    def run(batches):
        kept("simhash", list)  # frees what another operator has kept
        for batch in batches:
            parts = (batch.column(1).slice(at, 256).to_pylist() for at in range(0, batch.num_rows, 256))
            fps = np.array([fingerprint(t) for texts in parts for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["id", "fp", *batch.schema.names[2:]])

    given = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *keys)
    return given.mapInArrow(run, "id long, fp long" + (", key string" if keys else ""))


def _bit_removed(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, variant): 64 rows a fingerprint. A variant is (32 seg + bit) in the high and the segment without the bit in the
    low 32 bits of one number; seg 0 are the low and 1 the high 32 bits of the fingerprint."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    wide = fps.select("fp", F.posexplode(F.array(low, high)).alias("seg", "value"))
    bits = wide.select("fp", "seg", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    place = (F.col("seg") * 32 + F.col("bit")).cast("long")
    return bits.select("fp", F.shiftleft(place, 32).bitwiseOR(_bit_removed(F.col("value"), F.col("bit"))).alias("variant"))


_SEG, _BIT = "shiftright(a.variant, 37)", "(shiftright(a.variant, 32) & 31)"
_DIFF = "(a.fp ^ b.fp)"
# A pair is kept at one variant: the one of its differing bit in the segment, or bit 0 where there is none; and in
# the second segment only if the first one doesn't fit.
_IN = f"(case when {_SEG} = 0 then {_DIFF} & 4294967295L else shiftrightunsigned({_DIFF}, 32) end)"
_OWN = f"(({_IN} = 0 and {_BIT} = 0) or {_IN} = shiftleft(1L, cast({_BIT} as int))) and ({_SEG} = 0 or bit_count({_DIFF} & 4294967295L) > 1)"
_LINKED = f"a.fp < b.fp and bit_count({_DIFF}) <= 3"


def links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (column fp, no repeats) at distance 3 or less, each once or twice."""
    # one shuffle of all variants; only those with company go on
    alone = F.count(F.lit(1)).over(W.partitionBy("variant"))
    held, _ = written(_variants(fps).withColumn("n", alone).where("n > 1"), "variants")
    small = held.where(F.col("n") <= heavy).select("variant", "fp")
    one = small.alias("a").join(small.alias("b"), F.expr(f"a.variant = b.variant and {_LINKED} and {_OWN}"))
    large = held.where(F.col("n") > heavy)
    other = F.when(F.shiftright("variant", 37) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    halves = large.select("variant", "fp", F.posexplode(F.array(other.bitwiseAND(F.lit(0xFFFF)), F.shiftright(other, 16))).alias("half", "value"))
    second = halves.select("variant", "fp", "half", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("bit2"), "value").withColumn("key2", _bit_removed(F.col("value"), F.col("bit2"))).drop("value")
    out = f"(case when {_SEG} = 0 then shiftrightunsigned({_DIFF}, 32) else {_DIFF} & 4294967295L end)"
    d2 = f"(case when a.half = 0 then {out} & 65535L else shiftright({out}, 16) end)"
    own2 = f"(({d2} = 0 and a.bit2 = 0) or {d2} = shiftleft(1L, a.bit2))"
    keys = " and ".join(f"a.{c} = b.{c}" for c in ("variant", "half", "bit2", "key2"))
    two = second.alias("a").join(second.alias("b"), F.expr(f"{keys} and {_LINKED} and {_OWN} and {own2}"))
    pairs = [x.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")) for x in (one, two)]
    return pairs[0].unionByName(pairs[1])


def _with_components(first: DataFrame) -> DataFrame:
    """``first`` (distinct fingerprints, fp and first) with the smallest fingerprint of its component as component."""
    # few bytes a row before it becomes 64 rows: without a count of its own it would be packed into too few tasks
    comps = components(shrink_edges(links(first.select("fp").repartition(n_partitions(first.sparkSession), F.xxhash64("fp")))))
    return first.join(comps, first.fp == comps.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint (16 lowercase hex digits) and component_id, the smallest id of its component."""
    rows, _ = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("id").alias("first"))
    # the component of a fingerprint is named by its smallest fingerprint first, by its smallest document at last
    joined = _with_components(first)
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named, _ = written(joined.join(least, "component").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of ``docs`` from each component: that of its smallest id, rows without an id coming last. Rows count, not
    ids: each has two hashes of all its columns for a key, so only rows that agree in everything share one, and one of those stays. The
    texts are shuffled once, to the chosen keys; columns may have any names and types, maps among them. An empty table stays empty."""
    # the caller's columns travel in one, so none of their names can clash
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(docs).alias("key"))
    rows, _ = written(fingerprints(given, "id", "text", "key"), "fingerprints")
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("free"), "id", "key")).alias("first"))
    chosen = _with_components(first).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.key").alias("chosen")).distinct()
    joined = given.select("doc", "key").join(chosen, F.col("key") == F.col("chosen"))
    alike = joined.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.lit(0))))
    return alike.where("n = 1").select("doc.*")
