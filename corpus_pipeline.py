"""A corpus pipeline of five stages: toxicity, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's ``docs``. The first four return the columns of ``documents``, and any others that ``docs`` has, whatever their names.

Defined cases, for all stages: an empty table gives an empty result; null texts count as empty but stay null until the mix, which
leaves out documents without words; maps are columns like others; very long texts are read whole; null and repeated ids are rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import bpe, mixing, pii, simhash, toxicity
from latticework.llm.queries import PII_KEY, table
from latticework.tables import drop_path, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that aren't predicted toxic; the classifier learns from the labelled ones among them. Without labels of both
    kinds the share of toxic ones decides for all."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")
    scored = toxicity.toxicity(whole, table(spark, sf_dir, "labels"), keep=True)
    return scored.where("predicted = 0").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each component, that of its smallest id; ids may be repeated or null."""
    return simhash.one_of_each(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in the place of personal data; n_chars stays, as no length changes."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")
    done = pii.pseudonyms(whole, PII_KEY, keep=True)
    return done.select(*[(F.col("text") if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents, repeated or left out as the schedule asks, in its order in each partition. A source's words come to its
    target within half a document."""
    mixed = mixing.mixed_documents(docs, cut=False)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: No SQL engine has the classifier, XXH64 fingerprints or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_path(spark, before)  # what it was made from isn't read again
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
