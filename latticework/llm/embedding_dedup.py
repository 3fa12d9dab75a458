"""Embedding near-duplicates: one navigable small-world graph a shard, every shard queried, beams audited, components.

Vectors are compared when their labels (and lengths) are equal. Equal vectors of a label are one representative with a
count, so exact copies never meet pair by pair. A label's representatives are dealt by hash into shards of about
``shard_rows``, and shards into blocks of ``BLOCK_SHARDS``. A task has the vectors of two blocks (or one, against itself): it builds
their shards' graphs and queries each shard of one with all vectors of the other, in both directions, so every vector is
searched in every shard of its label and a link has two chances. A search is a walk with a beam, and from what that finds on over
all neighbours that are near enough, so dense groups need no wide beam. An audit compares ``audit`` queries of each
two shards with all of the shard, and the beam doubles until the audit finds every link; a beam that would be as wide as
the shard is, at last, a scan of it. Cosines of what was found are taken anew in double precision. A task returns sums a vector, a
spanning forest of its links, so dense groups cost no row a pair, and what its audits found.

Blocks of a label meet two by two, so the work and the shuffle grow with the square of a label's vectors over the block's; a label
of one block is shuffled once. A label with a third of all rows is many pairs of blocks, each a task's share of its own.

Defined cases: a null label, a null or empty vector, one with a null or non-finite component or of zero length links
with nothing and is its own component; repeated ids are vectors of their own in n_links and share the smallest id
as any others; null ids are kept, count as linked vectors and get the component of what they link to, null if nothing
has an id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import components, local_forest, n_partitions, written
from latticework.llm.hnsw import Hnsw

SHARD_ROWS = 2048
BLOCK_SHARDS = 4
SLACK = 1e-5  # of single-precision cosines below the bound
LOG = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def audited(graph: Hnsw, exact: np.ndarray, queries: np.ndarray, least: float, beam: int, audit: int, tally: np.ndarray | None = None, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (query, node) of cosine >= least; ``exact`` are the shard's unit vectors in double precision. ``tally`` counts
    queries by the graph, queries by a scan, audited links, and those of them that the first beam found. Where the queries are the shard's
    ``own`` vectors, a vector's match with itself is no link and isn't audited."""
    q = queries.astype(np.float32)
    picked = np.arange(0, len(q), max(1, len(q) // max(1, audit)))
    true = queries[picked] @ exact.T >= least
    if own:
        true[np.arange(len(picked)), picked] = False
    tally = np.zeros(4, np.int64) if tally is None else tally
    tally[2] += true.sum()
    first = True
    while beam < len(exact) or first:
        found = np.zeros(true.shape, bool)
        found[graph.linked(q[picked], least - SLACK, beam)] = True
        tally[3] += (true & found).sum() if first else 0
        first = False
        if not (true & ~found).any():
            r, c = graph.linked(q, least - SLACK, beam)
            tally[0] += len(q)
            break
        beam *= 2
    else:
        r, c = graph.scanned(q, least - SLACK)
        tally[1] += len(q)
    keep = [np.einsum("id,id->i", queries[r[at : at + 65536]], exact[c[at : at + 65536]]) >= least for at in range(0, len(r), 65536)]
    keep = np.concatenate([np.zeros(0, bool), *keep])
    return r[keep], c[keep]


def mirrored(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places below n in both directions, each once: what one end has found counts for both."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return np.divmod(np.unique(np.concatenate([a * n + b, b * n + a])), n)


class Pair:
    """Two blocks of vectors (or one) and the search of each one's shards with the other's vectors."""

    def __init__(self, same: bool, columns: dict[str, np.ndarray], min_cosine: float, beam: int, audit: int):
        self.same, self.least, self.beam, self.audit = same, min_cosine, beam, audit
        self.shards = []
        for place in np.unique(columns["shard"]):
            at = np.flatnonzero(columns["shard"] == place)
            x = unit(columns["v"][at].astype(np.float64))
            self.shards.append((columns["rep"][at], columns["copies"][at], x, Hnsw(x), columns["block"][at[0]]))

    def rows(self):
        """Batches (u, v, n): links of a spanning forest; with v = -1 the number of vectors linked to u; with v = -2 - k the k-th tally."""
        tally = np.zeros(4, np.int64)
        for k, (ids, counts, x, graph, block) in enumerate(self.shards):
            for ids2, counts2, x2, graph2, block2 in self.shards[k:]:
                own = ids is ids2
                if not self.same and block == block2:
                    continue  # searched where the block meets itself
                a, b = audited(graph2, x2, x, self.least, self.beam, self.audit, tally, own)
                if own:
                    a, b = mirrored(a, b, len(ids))
                    a, b = a[a != b], b[a != b]
                else:
                    c, d = audited(graph, x, x2, self.least, self.beam, self.audit, tally)
                    a, b = np.divmod(np.unique(np.concatenate([a.astype(np.int64) * len(ids2) + b, d.astype(np.int64) * len(ids2) + c])), len(ids2))
                u, w = local_forest(ids[a], ids2[b])
                sums = [(ids, np.bincount(a, counts2[b], len(ids)))]
                if not own:
                    sums.append((ids2, np.bincount(b, counts[a], len(ids2))))
                yield u, w, np.zeros(len(u), np.int64)
                for which, n in sums:
                    some = n > 0
                    yield which[some], np.full(some.sum(), -1), n[some].astype(np.int64)
        yield np.zeros(4, np.int64), -2 - np.arange(4), tally


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.98, shard_rows: int = SHARD_ROWS, beam: int = 32, audit: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", report: dict | None = None) -> DataFrame:
    """Per vector: id, n_links, component_id, kept (id = component_id). ``report`` is given what the audits found (it is logged, too):
    graph_queries, scan_queries, audited links (without a vector's own match), found (by the first beam) and recall (None where no audited vector
    has a link)."""
    spark = vectors.sparkSession
    n = n_partitions(spark, vectors.select(vector_col))
    v = F.col("v")
    given = vectors.schema[vector_col].dataType
    single = given.elementType.typeName() == "float"  # exact in half the bytes
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 is 0.0 to grouping, so it must be to hashing
    plus = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast("float" if single else "double")).otherwise(x))
    rows = plain.withColumn("usable", usable).withColumn("v", F.when(F.col("usable"), plus))
    # 128 bits name a vector of a label in joins, so that rows meet their representative without the vector
    rows = rows.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(1), "v", "label"))
    reps = rows.where("usable").groupBy("label", "h1", "h2", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    reps = reps.withColumn("dim", F.size("v"))
    reps, _ = written(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / shard_rows)).cast("int").alias("shards"))
    dealt = reps.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, ["label", "dim"])
    dealt = dealt.withColumn("shard", F.pmod(F.col("h1"), F.col("shards").cast("long")).cast("int"))
    dealt = dealt.withColumn("block", F.floor(F.col("shard") / BLOCK_SHARDS).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("shards") - 1) / BLOCK_SHARDS).cast("int")))
    met = dealt.select("label", "dim", "shard", "block", "rep", "copies", "v", other.alias("other"))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    names = ["label", "dim", "i", "j"]

    def search(batches):
        key, held = None, {}

        def found():
            pair = Pair(key[2] == key[3], {c: np.concatenate(x) for c, x in held.items()}, min_cosine, beam, audit)
            for u, w, m in pair.rows():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, w, m)], names=["u", "v", "n"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if key != tuple(keys[a]):
                    if held:
                        yield from found()
                    key, held = tuple(keys[a]), {c: [] for c in ("shard", "block", "rep", "copies", "v")}
                part = batch.slice(a, b - a)
                for c in ("shard", "block", "rep", "copies"):
                    held[c].append(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
                held["v"].append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(key[1])).copy())
        if held:
            yield from found()

    near = met.repartition(n, *names).sortWithinPartitions(*names, "block", "shard", "rep").mapInArrow(search, "u long, v long, n long")
    found, _ = written(near, "links")
    said = {r["v"]: r["n"] for r in found.where("v < -1").groupBy("v").agg(F.sum("n").alias("n")).collect()}  # four rows
    told = dict(zip(("graph_queries", "scan_queries", "audited", "found"), (said.get(-2 - k, 0) for k in range(4))))
    told["recall"] = told["found"] / told["audited"] if told["audited"] else None
    LOG.info("audits of embedding near-duplicates: %s", told)
    if report is not None:
        report.update(told)
    linked = found.where("v = -1").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(found.where("v >= 0").select("u", "v"))
    joined = reps.select("rep", "h1", "h2", "copies", "least").join(linked, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    joined = joined.withColumn("component", F.coalesce("component", "rep"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    done = rows.where("usable").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = done.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(u, w) AS (
  SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id)::BIGINT AS n_links,
       least(e.vec_id, coalesce((SELECT min(w) FROM reach r WHERE r.u = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id <= coalesce((SELECT min(w) FROM reach r WHERE r.u = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""
