"""Token counts without ids: pieces are counted once per distinct pre-token and summed over documents.

Plan. (1) Each bounded block of documents becomes one row of a written table: its document ids, its distinct
pre-tokens sorted by the hash bucket they belong to, and its per-document pre-token frequencies (the
postings), packed. (2) The blocks' pre-tokens go to their buckets, where every distinct one is encoded once (again, if a worker has met more than ``CACHE_WORDS`` others since).
(3) The counts return to their blocks, joined to the postings by position, and each document's sum is the
dot product of frequencies and counts. A frequent pre-token is one entry a block, so it makes no hot key. A pre-token's ids are
made where it is counted, and only their number is kept; no document's ids are ever made.

Pre-tokens of a sentencepiece BPE model: a run of spaces with the word after it, or a line break with the word
after it. No piece has a space after another character or holds a line break (checked when the model is
loaded), so no merge crosses a cut.

Defined cases: a null text counts as empty; empty texts have 0 tokens and 0 bytes; repeated rows give repeated
rows; null ids are kept; very long texts are counted whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import kept, n_partitions, text_or_empty, written

BLOCK_BYTES = 8 << 20  # text of a block
CACHE_WORDS = 400_000
LEVEL = 6

_CUT = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


def pre_tokens(text: str) -> list[str]:
    """The cuts of one text, as keys: a word alone stands for one space and the word, as most are."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text:
        return text.replace("\n", " \n").split(" ")  # the first word gets the model's leading space
    return [w[1:] if w[0] == " " else w for w in _CUT.findall(" " + text)]


class Pieces:
    """Counts the pieces of pre-tokens with a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for k in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(k)
            if not (self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_byte(k)) and ("▁" in p.lstrip("▁") or "\n" in p):
                raise ValueError(f"piece {p!r} crosses a pre-token's end: this cut doesn't fit the model")
        self.known: dict[str, int] = {}

    def count(self, words: list[str]) -> list[int]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            # the model puts a space before every input; in front of a line break it is a piece of its own
            for w, ids in zip(part, self.model.encode(part, num_threads=1)):
                self.known[w] = len(ids) - 1 if w[:1] == "\n" else len(ids) if w else 1
        return list(map(self.known.__getitem__, words))


def loaded(path: str) -> Pieces:
    return kept(("pieces", path), lambda: Pieces(path))


def _pack(a: np.ndarray) -> bytes:
    """Small non-negative numbers: 16 low bits of each and, apart, those that need more."""
    big = np.flatnonzero(a > 0xFFFF)
    low = a.astype("<u2").view(np.uint8).reshape(-1, 2)
    raw = b"".join((np.array([len(a), len(big)], "<u4").tobytes(), low[:, 0].tobytes(), low[:, 1].tobytes(), big.astype("<u4").tobytes(), (a[big] >> 16).astype("<u4").tobytes()))
    return zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    low = np.frombuffer(raw, np.uint8, 2 * n, 8).reshape(2, n).astype(np.int64)
    out = low[0] | low[1] << 8
    big, high = (np.frombuffer(raw, "<u4", m, 8 + 2 * n + k * 4 * m).astype(np.int64) for k in (0, 1))
    out[big] |= high << 16
    return out


def _block_row(ids: list, n_bytes: list[int], texts: list[str], buckets: int) -> dict:
    """Words stand by falling number of documents, then by name, so that gaps between a document's words are small."""
    order: dict[str, int] = {}
    found = []
    for text in texts:
        words = pre_tokens(text)
        found.append(np.unique(np.fromiter((order.setdefault(w, len(order)) for w in words), np.int64, len(words)), return_counts=True))
    words = list(order)
    df = np.bincount(np.concatenate([f[0] for f in found]), minlength=len(words)) if words else np.zeros(0, np.int64)
    rank = sorted(range(len(words)), key=lambda k: (-df[k], words[k]))
    place = np.empty(len(words), np.int64)
    place[rank] = np.arange(len(words))
    words = [words[k] for k in rank]
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
    gaps, freq = [], []
    for w, n in found:
        at = np.argsort(place[w])
        gaps.append(np.diff(place[w][at], prepend=0))
        freq.append(n[at])
    by = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[by], append=-1)) + 1
    none = [np.zeros(0, np.int64)]
    return {
        "ids": ids,
        "n_bytes": n_bytes,
        "sizes": [len(f[0]) for f in found],
        "gaps": _pack(np.concatenate(gaps or none)),
        "freq": _pack(np.concatenate(freq or none)),
        "buckets": _pack(bucket),
        "words": [{"bucket": int(bucket[by[lo]]), "blob": _words([words[k] for k in by[lo:hi]])} for lo, hi in zip([0, *ends[:-1]], ends)],
    }


def _words(words: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps(words, ensure_ascii=False).encode())


_BLOCK = "block string, ids array<long>, n_bytes array<long>, sizes array<int>, gaps binary, freq binary, buckets binary, words array<struct<bucket: int, blob: binary>>"
_COUNTS = "block string, bucket int, counts array<int>"


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    n = n_partitions(spark, docs.select(text_col))
    arrow = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("gaps", pa.binary()), ("freq", pa.binary()), ("buckets", pa.binary()), ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("blob", pa.binary())])))])

    def blocks(batches):
        import uuid

        ids, sizes, texts, held = [], [], [], 0

        def flush():
            row = {"block": uuid.uuid4().hex} | _block_row(ids, sizes, texts, n)
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for k, b, t in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    ids.append(k)
                    sizes.append(b)
                    texts.append(t)
                    held += b
                    if held >= BLOCK_BYTES:
                        yield flush()
                        ids, sizes, texts, held = [], [], [], 0
        if ids:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("b"), text_or_empty(text_col).alias("t"))
    table, _ = written(source.mapInArrow(blocks, _BLOCK), "blocks")

    def count(batches):
        pieces = loaded(path)
        for batch in batches:
            for row in batch.to_pylist():
                words = json.loads(zstandard.ZstdDecompressor().decompress(row["blob"]))
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "bucket": row["bucket"], "counts": pieces.count(words)}], schema=pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("counts", pa.list_(pa.int32()))]))

    asked = table.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.blob")
    counted = asked.repartition(n, "bucket").mapInArrow(count, _COUNTS)

    def total(batches):
        """Rows of one block stand together, its counts by bucket first and then its postings."""
        got: list = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if (counts := row.column("counts")[0]).is_valid:
                    got.append(counts.values.to_numpy())
                    continue
                per_word = np.zeros(sum(map(len, got)), np.int64)
                per_word[np.argsort(_unpack(row.column("buckets")[0].as_py()), kind="stable")] = np.concatenate([np.zeros(0, np.int64), *got])
                got = []
                sizes = row.column("sizes")[0].values.to_numpy().astype(np.int64)
                m = int(sizes.sum())
                gaps, freq = _unpack(row.column("gaps")[0].as_py()), _unpack(row.column("freq")[0].as_py())
                sums = np.cumsum(gaps)
                first = np.cumsum(sizes) - sizes
                base = np.repeat(np.where(first > 0, np.concatenate([[0], sums])[first], 0), sizes)
                tokens = np.concatenate([[0], np.cumsum(freq * per_word[sums - base])]) if m else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [row.column("ids")[0].values, row.column("n_bytes")[0].values, pa.array(tokens[first + sizes] - tokens[first], pa.int64())], names=["id", "n_bytes", "n_tokens"]
                )

    none = lambda t: F.lit(None).cast(t)
    left = counted.select("block", "bucket", "counts", none("array<long>").alias("ids"), none("array<long>").alias("n_bytes"), none("array<int>").alias("sizes"), *[none("binary").alias(c) for c in ("gaps", "freq", "buckets")])
    right = table.select("block", F.lit(1 << 30).alias("bucket"), none("array<int>").alias("counts"), "ids", "n_bytes", "sizes", "gaps", "freq", "buckets")
    joined = left.unionByName(right).repartition(n, "block").sortWithinPartitions("block", "bucket").mapInArrow(total, "id long, n_bytes long, n_tokens long")
    return joined.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
