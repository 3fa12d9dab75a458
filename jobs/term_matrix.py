"""A sparse document x term matrix of the text table for each language, ready for products and solvers.

    python -m jobs.term_matrix --documents DIR/documents.parquet --out DIR [--config FILE]

Below ``out``, each partitioned by ``lang``:

* ``terms``: term, j (from 0 in code-point order), documents (that have it), total (occurrences);
* ``entries``: the coordinate matrix i, j, v (occurrences) and ``block``, an equal run of a language's and its neighbours' entries in
  row order, by which products are shared out however long a row is;
* ``rows``: doc_id, i (from 0 by doc_id), n (entries), row_end (inclusive prefix sum: a compressed row's end), words, first_j, last_j
  and y, the product A x with x_j the number of documents that have term j.

Words are runs of ``[^\\x20\\x09-\\x0D]``, with A-Z in lower case. Documents of one id and language are one row; a document without words is a
row without entries; documents without an id have no row and are counted in the log; a null or empty language is "unknown". ``languages``
in the config restricts a run to some. A run replaces the partitions of the languages that it read and leaves the others, so that a
run that was cut off is simply repeated.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobs.common import main
from latticework.operators import blas, sparse
from latticework.tables import drop_path, n_partitions, scratch, written

log = logging.getLogger("term_matrix")
DEFAULTS = {"languages": None, "blocks": 64}
ROWS = "doc_id long, i long, n long, row_end long, words long, first_j long, last_j long, y long, lang string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART_BYTES = 8 << 20  # of the text table's files


def _numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``all_``out (from 0 in the order of language and key) and ``out`` (from 0 within the language)."""
    ranked = blas.running_total(df.withColumn("one", F.lit(1)), ["lang", key], "one", "rank").withColumn(f"all_{out}", F.col("rank") - 1)
    starts = ranked.groupBy(F.col("lang").alias("of")).agg(F.min(f"all_{out}").alias("start"))
    return ranked.join(starts, F.col("lang") == F.col("of")).withColumn(out, F.col(f"all_{out}") - F.col("start")).drop("one", "rank", "of", "start")


def _save(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(f"{out}/{name}")
    log.info("wrote %s/%s", out, name)


def run(spark: SparkSession, documents: str, out: str, config: dict | None = None) -> DataFrame:
    """Builds the matrices and returns the table of rows, read back."""
    config = DEFAULTS | (config or {})
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.nullif(F.col("lang").cast("string"), F.lit("")), F.lit("unknown")).alias("lang"), "text")
    if config["languages"] is not None:
        docs = docs.where(F.col("lang").isin(list(config["languages"])))
    named = docs.where("doc_id is not null")
    parts = n_partitions(spark, docs, PART_BYTES)
    steps: list[tuple[str, str | None]] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, f"term-matrix-{name}")
        steps.append((path, None))
        return table

    def by_part(df: DataFrame, name: str) -> DataFrame:
        """A step's table in buckets: what joins or groups by ``part`` and more reads a part's rows where they are."""
        table, path = f"term_matrix_{name}_{uuid.uuid4().hex}", scratch(spark, f"term-matrix-{name}")
        steps.append((path, table))
        df.write.format("parquet").bucketBy(parts, "part").option("path", path).saveAsTable(table)
        return spark.table(table)

    keys = "spark.sql.requireAllClusterKeysForCoPartition"
    asked = spark.conf.get(keys)
    spark.conf.set(keys, "false")  # joins by ``part`` and more leave the entries where they are
    try:
        # a part is a range of documents: its words are counted, met with their numbers and written in one task, and only the words that
        # differ in it are sent on
        dealt = named.repartitionByRange(parts, "lang", "doc_id").sortWithinPartitions("lang", "doc_id").withColumn("part", F.spark_partition_id())
        word = F.explode(F.split(F.translate("text", UPPER, LOWER), "[ \t-\r]+")).alias("term")
        counts = by_part(dealt.select("part", "lang", "doc_id", word).where("term <> ''").groupBy("part", "lang", "doc_id", "term").agg(F.count(F.lit(1)).alias("v")), "counts")
        own = by_part(counts.groupBy("part", "lang", "term").agg(F.count(F.lit(1)).alias("documents"), F.sum("v").alias("total")), "own")
        terms = own.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("total").alias("total"))
        terms = step(_numbered(terms, "term", "j"), "terms")
        numbers = own.select("part", "lang", "term").join(terms.select("lang", "term", "j", "documents"), ["lang", "term"])
        numbers = by_part(numbers.repartition(parts, "part"), "numbers").hint("shuffle_hash")
        sizes = counts.groupBy("part", "lang", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("words"))
        every = named.select("lang", "doc_id").distinct().join(sizes, ["lang", "doc_id"], "left").fillna(0, ["n", "words"])
        ended = blas.running_total(_numbered(every, "doc_id", "i"), ["all_i"], "n", "end")
        size = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        block = lambda at: sparse.block_of(at, size, config["blocks"])
        rows = step(ended.withColumn("first", block(F.col("end") - F.col("n"))).withColumn("last", block(F.col("end") - 1)), "rows")
        # y = A x is summed where a part's entries are; the few rows that lie in several blocks are put in order for their entries' blocks
        met = counts.join(numbers, ["part", "lang", "term"])
        sums = met.groupBy("part", "lang", "doc_id").agg(F.min("j").alias("first_j"), F.max("j").alias("last_j"), F.sum(F.col("v") * F.col("documents")).alias("y")).drop("part")
        starts = rows.groupBy("lang").agg(F.min(F.col("end") - F.col("n")).alias("end0"))
        table = rows.join(starts, "lang").join(sums, ["lang", "doc_id"], "left").withColumn("row_end", F.col("end") - F.col("end0")).withColumn("y", F.coalesce("y", F.lit(0)).cast("long"))
        filled = rows.where("n > 0").select("part", "lang", "doc_id", "i", "end", "n", "first", "last")
        whole = met.join(filled.where("first = last").repartition(parts, "part").hint("shuffle_hash"), ["part", "lang", "doc_id"]).withColumnRenamed("first", "block")
        cut_up = counts.join(F.broadcast(filled.where("first < last")), ["part", "lang", "doc_id"]).join(numbers, ["part", "lang", "term"])
        at = F.col("end") - F.col("n") + F.row_number().over(W.partitionBy("lang", "doc_id").orderBy("j")) - 1
        placed = whole.select("i", "j", "v", "block", "lang").unionByName(cut_up.withColumn("block", block(at)).select("i", "j", "v", "block", "lang"))
        _save(terms.select("term", "j", "documents", "total", "lang"), out, "terms")
        _save(placed.sortWithinPartitions("lang", "i", "j"), out, "entries")
        _save(table.select("doc_id", "i", "n", "row_end", "words", "first_j", "last_j", "y", "lang"), out, "rows")
        read, left_out = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
        log.info("read %d documents of %s, %d of them without an id; wrote %d rows, %d terms, %d entries", read, documents, left_out, rows.count(), terms.count(), size)
    finally:
        spark.conf.set(keys, asked)
        for path, name in steps:
            if name is not None:
                spark.sql(f"drop table if exists {name}")
            drop_path(spark, path)
    return spark.read.schema(ROWS).parquet(f"{out}/rows")


#: The same rows, for DuckDB.
ORACLE = f"""
with docs as (select doc_id, coalesce(nullif(lang, ''), 'unknown') as lang, text from documents where doc_id is not null),
words as (select lang, doc_id, unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+')) as term from docs),
counts as (select lang, doc_id, term, count(*) as v from words where term <> '' group by all),
terms as (select lang, term, row_number() over (partition by lang order by term) - 1 as j, count(*) as documents from counts group by lang, term),
sums as (select lang, doc_id, count(*) as n, sum(v) as words, min(j) as first_j, max(j) as last_j, sum(v * documents) as y from counts join terms using (lang, term) group by all),
every as (select distinct lang, doc_id from docs)
select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 as i, coalesce(n, 0) as n,
  (sum(coalesce(n, 0)) over (partition by lang order by doc_id))::bigint as row_end, coalesce(words, 0)::bigint as words, first_j, last_j, coalesce(y, 0)::bigint as y
from every left join sums using (lang, doc_id)
"""

if __name__ == "__main__":
    main(run, "term_matrix", {"documents": "the text table", "out": "where the matrices go"}, DEFAULTS)
