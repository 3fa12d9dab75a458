"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame operations only.

Targets: sources by code point, null last, get the weights in turn; together they share ``share`` of all words. A target
stops at ``max_repeats`` times its source's words and the rest is shared again by weight until none is above: the capped
sources are those with the least cap a weight, so the fixed point is read off two running sums.

Schedule: the targets, one after the other, make an axis of words, which N slots of ``block_words`` words share out (the last
slot may have fewer). The slots come in the order of a van der Corput sequence: slot i has the point v(i), the m bits of i
reversed (2^m >= N; points at or above N are unused), and the words from v(i) block_words on. The running
sums of the targets say whose words these are: the source whose range holds them gets the slot, and a slot on the border of two gets some
of each. A slot's rank in its source is its point's, so a source has as many slots as points fall to it.
Every stretch of the schedule holds the sources in nearly their proportions.

Blocks: a source's documents in order of a keyed hash are a stream of words, repeated where the schedule asks for
more, and cut where its slots are. Blocks join slots on (source, rank); a document takes the words that its blocks have in
the slots that they met.

Positions in a stream are prefix sums in three steps (ranges of buckets of the hash, buckets, documents within a bucket), so a source
with a third of all rows is spread over many tasks. Slots find their source by an equality join on cells of the slot axis.

Defined cases: null texts have size 0; documents of size 0 take 0 words and have no slot; a null source is a source of its own and comes
last; null and repeated ids are rows of their own (null ids are ordered by their texts); with no words at all every target is 0; an empty table gives
an empty result; very long texts are counted whole and may cover many slots; other columns are not read by ``mix`` and pass
through ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from latticework.llm.common import row_key, written

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
ROWS_A_BUCKET = 512
BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit("~null"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """Per source of ``sizes(source, size)``: key, source, weight, source_size, target, take (the target in whole words)."""
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # as many rows as sources
    ranked = total.withColumn("k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    every = W.partitionBy()
    limits = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_repeats)).withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
    before = W.orderBy((F.col("cap") / F.col("weight")).asc(), "k").rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = limits.withColumn("level", level)
    free = F.col("cap") / F.col("weight") > F.col("level")  # not capped at this level
    # the level at the first source in this order that isn't capped; sources with equal caps a weight go by their number
    first = F.min(F.when(free, F.struct((F.col("cap") / F.col("weight")).alias("limit"), F.col("k"), F.col("level")))).over(every)
    found = levels.withColumn("level", F.coalesce(first["level"], F.lit(float("inf"))))
    target = F.least(F.col("cap").cast("double"), F.round(F.col("level") * F.col("weight"), 6))
    return found.select(_source_key(F.col("source")).alias("key"), "source", "weight", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("take"))


def _reversed_bits(x: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long")


def schedule(goals: DataFrame, block_words: int) -> DataFrame:
    """Slots (key, rank, slot, begin, end): slot is the place in the mix, rank the block of the source that stands there, begin and end
    that block's words in the source's stream."""
    spark = goals.sparkSession
    running = W.orderBy("key").rowsBetween(W.unboundedPreceding, -1)  # as many rows as sources
    ranges = goals.where("take > 0").select("key", "take", F.coalesce(F.sum("take").over(running), F.lit(0)).cast("long").alias("offset"))
    words = ranges.agg(F.sum("take")).first()[0] or 0
    total = -(-words // block_words)
    bits = max(1, (total - 1).bit_length()) if total else 1
    cell = max(1, -(-total // CELLS))
    first, last = F.floor(F.col("offset") / block_words), F.floor((F.col("offset") + F.col("take") - 1) / block_words)
    ranges = ranges.select("key", "take", "offset", first.alias("first"), last.alias("last"))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor(F.col("last") / cell))))
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), _reversed_bits(F.col("id"), bits).alias("point")).where(F.col("point") < total)
    held = points.withColumn("cell", F.floor(F.col("point") / cell)).join(cells, "cell").where("point between first and last")
    begin = F.greatest(F.col("point") * block_words - F.col("offset"), F.lit(0))
    end = F.least((F.col("point") + 1) * block_words - F.col("offset"), "take")
    return held.select("key", (F.col("point") - F.col("first")).alias("rank"), "slot", begin.alias("begin"), end.alias("end"))


def _buckets_before(hashed: DataFrame, bits: int) -> DataFrame:
    """(key, bucket, bucket_start): the words of a source's buckets before each, by running sums within and over ranges of buckets."""
    sums = hashed.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("range", F.shiftright("bucket", max(0, bits - 12)))
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    within = sums.withColumn("inner", F.coalesce(F.sum("bucket_size").over(before("key", "range", "bucket")), F.lit(0)))
    ranges = sums.groupBy("key", "range").agg(F.sum("bucket_size").alias("range_size"))  # 4096 a source at most
    starts = ranges.select("key", "range", F.coalesce(F.sum("range_size").over(before("key", "range")), F.lit(0)).alias("outer"))
    return within.join(starts, ["key", "range"]).select("key", "bucket", (F.col("inner") + F.col("outer")).alias("bucket_start"))


_ROW = ["key", "bucket", "row", "id", "size", "source_size", "target", "text_hash", "whole", "occurrence"]


def _pieces(docs: DataFrame, whole: Column, weights: tuple[int, ...], share: float, max_repeats: int, block_words: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row a piece of a document's copy that met a slot (copy, slot, words), and at least one row a document. ``whole`` tells rows apart
    that agree in id, source and text."""
    sizes = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), whole.alias("whole"))
    sizes, _ = written(sizes, "sizes")  # texts are read once
    rows = sizes.count()
    bits = max(0, (rows // ROWS_A_BUCKET).bit_length())
    goals, _ = written(targets(sizes, weights, share, max_repeats), "targets")
    slots, _ = written(schedule(goals, block_words), "slots")
    firsts = slots.where("rank = 0").select("key", F.col("end").alias("first_end"))  # one a source with a target
    named = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.col("text_hash")), F.lit(""))
    hashed = sizes.withColumn("key", _source_key(F.col("source"))).withColumn("hash", F.md5(F.concat(named, F.lit(":" + seed))))
    hashed = hashed.withColumn("bucket", F.shiftright(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), 32 - bits))
    in_bucket = W.partitionBy("key", "bucket").orderBy("hash", "id", "size", "text_hash", "whole")
    placed = hashed.withColumn("row", F.row_number().over(in_bucket)).withColumn("before", F.sum("size").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("occurrence", F.row_number().over(W.partitionBy("key", "bucket", "hash", "id", "size", "text_hash").orderBy("row")))
    of_source = goals.drop("source", "weight").join(firsts, "key", "left")
    if goals.count() <= BROADCAST_SOURCES:  # a few numbers a source
        of_source = F.broadcast(of_source)
    placed = placed.join(_buckets_before(hashed, bits), ["key", "bucket"]).join(of_source, "key")
    placed = placed.withColumn("at", F.col("before") + F.col("bucket_start")).drop("before", "bucket_start", "hash", "source")
    # copies that begin before the target ends, then the blocks that a copy touches; one row without a block for each document
    copies = F.when((F.col("size") > 0) & (F.col("at") < F.col("take")), F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - 1 - F.col("at")) / F.greatest("source_size", F.lit(1)))))
    spans = placed.withColumn("copy", F.explode_outer(copies)).withColumn("a", F.col("at") + F.col("copy") * F.col("source_size")).withColumn("e", F.least(F.col("a") + F.col("size"), F.col("take")))
    # the block of a word: the source's first block may be short, as its slot begins in another source's words
    block = lambda word: F.when(word < F.col("first_end"), F.lit(0)).otherwise(1 + F.floor((word - F.col("first_end")) / block_words)).cast("long")
    blocks = F.when(F.col("copy").isNotNull(), F.sequence(block(F.col("a")), block(F.col("e") - 1)))
    ranked = spans.withColumn("rank", F.explode_outer(blocks))
    joined = ranked.join(slots, ["key", "rank"], "left")
    words = F.when(F.col("slot").isNotNull(), F.least("e", "end") - F.greatest("a", "begin"))
    return joined.select(*_ROW, "copy", "slot", words.alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3, block_words: int = 1024, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target (its source's), taken, first_slot (null if not taken), and two columns
    that tell rows of one id apart: text_hash and occurrence (1, 2, ... among equal id, source and text)."""
    pieces = _pieces(docs, F.lit(0).cast("long"), weights, share, max_repeats, block_words, seed, id_col, text_col, source_col)
    done = pieces.groupBy(*_ROW).agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_slot", "key", "text_hash", "occurrence")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_repeats: int = 3, block_words: int = 1024, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ordered: bool = False, cut: bool = True) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each copy of a document, whole or (one document of a source
    at most) its first words; without ``cut`` that one is whole if half its words were asked for, else it is left out. Rows stand by the slot in which their copy begins, then by id: in each partition, or over all of them with
    ``ordered``, which costs a shuffle of the texts."""
    whole = row_key(docs)
    pieces = _pieces(docs, whole, weights, share, max_repeats, block_words, seed, id_col, text_col, source_col).where("words > 0")
    copies = pieces.groupBy(*_ROW, "copy").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")).select("id", "text_hash", "whole", "size", "copy", "words", "slot")
    # rows that agree in all columns are one row here: the plan has a copy for each time that any of them is taken. The texts are shuffled
    # once, as the join's keys are the window's
    if not cut:
        copies = copies.where(2 * F.col("words") >= F.col("size")).withColumn("words", F.col("size"))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), whole.alias("whole"))
    keys = ["whole", "text_hash"]
    given = given.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))).where("n = 1").drop("n")
    each = given.join(copies, keys)
    text = F.col("doc").getField(text_col)
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("words").cast("int")), "")
    order = ["slot", "id", "text_hash", "whole", "copy"]
    each = each.repartitionByRange(*order).sortWithinPartitions(*order) if ordered else each.sortWithinPartitions(*order)
    return each.select(*[(F.when(F.col("words") < F.col("size"), first).otherwise(text) if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), total AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM total
), limits AS (
  SELECT *, ([5.0, 2.0, 1.0])[(k % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE AS budget FROM ranked
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM limits WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size,
         least(cap, round(coalesce((SELECT level FROM levels WHERE cap / weight > level ORDER BY cap / weight, k LIMIT 1), 'inf'::DOUBLE) * weight, 6)) AS target
  FROM levels
), axis AS (
  SELECT source, source_size, target, floor(target + 0.5)::BIGINT AS take,
         coalesce(sum(floor(target + 0.5)::BIGINT) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM goals
), slots_of AS (
  SELECT ((sum(take) + 1023) // 1024)::BIGINT AS n, greatest(1, length(ltrim(bin(greatest(0, (sum(take) + 1023) // 1024 - 1)::BIGINT), '0')))::BIGINT AS bits FROM axis
), points AS (
  SELECT slot, n, list_sum([((slot >> k) & 1) << (bits - 1 - k) for k in range(bits)])::BIGINT AS point
  FROM (SELECT n, bits, unnest(range(1::BIGINT << bits)) AS slot FROM slots_of)
), slots AS (
  SELECT source, slot, greatest(point * 1024 - off, 0) AS b, least((point + 1) * 1024 - off, take) AS e
  FROM points JOIN axis ON point * 1024 < off + take AND (point + 1) * 1024 > off WHERE point < n
), placed AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, g.take,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '') || ':mix'), s.doc_id, s.size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS pos
  FROM sizes s JOIN axis g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT *, pos + c * source_size AS b, least(pos + (c * source_size) + size, take) AS e
  FROM placed, (VALUES (0), (1), (2)) AS t(c)
), met AS (
  SELECT c.doc_id, sum(least(c.e, s.e) - greatest(c.b, s.b))::BIGINT AS taken, min(s.slot) AS first_slot
  FROM copies c JOIN slots s ON c.source IS NOT DISTINCT FROM s.source AND c.b < s.e AND s.b < c.e
  WHERE c.b < c.e GROUP BY c.doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(m.taken, 0)::BIGINT AS taken, m.first_slot
FROM placed p LEFT JOIN met m ON p.doc_id = m.doc_id
"""
