"""Token ids in a fixed-width, bit-packed file format with random access.

A file table is a Parquet folder (any store that Spark writes) of segments, one row each, at most
``SEGMENT_TOKENS`` ids or one document. A segment's payload is

    magic "LWT1" | bits u8 | pad u8 x 3 | n_docs u32 | n_tokens u64 | document offsets u64 x (n_docs + 1) | packed ids

in little-endian order; id k of the segment takes bits [k * bits, (k + 1) * bits) of the packed part, so any range is
found without reading what comes before. ``unpack`` does it with numpy. ``bits`` is the least width that holds the
vocabulary and the end id. Segments are numbered within buckets, which are ranges of document ids: (bucket, segment)
ascends with the document id. A document's start in the whole stream is its bucket's start plus its segment's
plus its offset; the buckets' starts are a prefix sum over as many rows as there are buckets. Each segment's row has its
least and greatest document id, so that a read of a few documents skips the other segments' payloads.

Defined cases: a null text counts as empty (end id only); null document ids come first; equal ids follow each
other, ordered by length and then by their ids; an empty table writes no segment; a text of any length is encoded whole, in pieces
that end at white space; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from latticework.llm.common import kept, n_partitions, release, text_or_empty, written

SEGMENT_TOKENS = 1 << 20
BROADCAST_SEGMENTS = 100_000
CACHE_WORDS = 1_200_000  # some 200 bytes each
TEXTS_AT_ONCE = 128
PIECE_CHARS = 1 << 20
HEAD = struct.Struct("<4sB3xIQ")
MAGIC = b"LWT1"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """Ids first .. first + n of a packed part."""
    if n == 0:
        return np.zeros(0, "<u4")
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", n, first * (bits // 8)).astype("<u4")
    lo, hi = first * bits // 8, -(-(first + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(packed, np.uint8, hi - lo, lo), bitorder="little")
    flat = flat[first * bits - lo * 8 :][: n * bits].reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = flat
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def segment(docs: list[np.ndarray], bits: int) -> bytes:
    offsets = np.zeros(len(docs) + 1, "<u8")
    offsets[1:] = np.cumsum([len(d) for d in docs])
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    return HEAD.pack(MAGIC, bits, len(docs), len(ids)) + offsets.tobytes() + pack(ids, bits)


class Segment:
    """A read segment; ``doc(k)`` unpacks one document, ``ids(a, b)`` any range."""

    def __init__(self, payload: bytes):
        magic, self.bits, self.n_docs, self.n_tokens = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.offsets = np.frombuffer(payload, "<u8", self.n_docs + 1, HEAD.size).astype(np.int64)
        self.packed = memoryview(payload)[HEAD.size + 8 * (self.n_docs + 1) :]

    def ids(self, a: int, b: int) -> np.ndarray:
        return unpack(self.packed, self.bits, a, b - a)

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


class Encoder:
    """A tokenizers file of the kind that lower-cases, drops white space and cuts at it, by table of its chunks.

    A chunk is what stands between white space; no pre-token spans two. Chunks of letters that aren't known are encoded
    together, each as one pre-token. They are letters to Python and to the library, as texts with characters that the two class or
    lower-case differently go to the library whole. ``dtype`` is the integer that ids are kept in.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole, self.chunk, self.word = (Tokenizer.from_file(path) for _ in range(3))
        normalize = self.whole.normalizer.normalize_str
        self.chunk.normalizer = Sequence([])  # chunks are normalized already
        self.word.normalizer, self.word.pre_tokenizer = Sequence([]), ByteLevel(add_prefix_space=False, use_regex=False)
        self.word.model = self.chunk.model = self.whole.model
        self.chunk.encode_special_tokens = self.word.encode_special_tokens = True
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(dtype)
        self.ends = np.zeros(self.size, bool)
        for piece, k in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends[k] = piece.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.marks = {m: self._own(self.chunk, m) for m in ".,;:!?"}
        # the basic plane's characters that Python's tables don't know or lower-case otherwise; the other planes' go to the library
        plane = [chr(c) for c in range(0xA0, 0x10000) if not 0xD800 <= c <= 0xDFFF]
        one = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        strange = [c for c in plane if unicodedata.category(c) == "Cn" or (len(one(f"a{c}a")) == 1) != c.isalpha() or normalize(c) != unicodedata.normalize("NFC", c).replace("Σ", "σ").lower() and not c.isspace()]
        self.strange = re.compile(f"[\U00010000-\U0010ffff{re.escape(''.join(strange))}]")

    def _chunks(self, text: str) -> list[str] | None:
        """What the text's table look-ups go by, or None for a text that goes to the library whole."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text or any(s in text for s in self.special):
            return None
        if not text.isascii():
            if self.strange.search(text):
                return None
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower().split()

    def encode(self, texts: list[str], tail: bytes) -> list[bytes]:
        """Ids of each text as little-endian integers of the encoder's type, and ``tail``."""
        chunks = [self._chunks(t) if len(t) <= PIECE_CHARS else None for t in texts]
        look = self._table(set().union(*filter(None, chunks))).__getitem__
        return [(self._apart(t) if c is None else b"".join(map(look, c))) + tail for t, c in zip(texts, chunks)]

    def _apart(self, text: str) -> bytes:
        """A very long text in pieces that end at white space, any other by the library whole."""
        if len(text) <= PIECE_CHARS or self._chunks(text) is None:
            return self._own(self.whole, text)
        out, at, space = [], 0, re.compile(r"\s")
        while at < len(text):
            m = space.search(text, min(len(text), at + PIECE_CHARS))
            end = m.start() if m else len(text)
            chunks = self._chunks(text[at:end])
            out.append(b"".join(map(self._table(set(chunks)).__getitem__, chunks)))
            at = max(end, at + 1)
        return b"".join(out)

    def _table(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of the chunks, in a table small enough to stay in a processor's cache; what is new is added to those known."""
        known = self.known
        table = dict(zip(chunks, map(known.get, chunks)))
        fresh = [w for w, ids in table.items() if ids is None]
        new = self._words([w for w in fresh if w.isalpha()])
        rest = [w for w in fresh if not w.isalpha()]
        marked = [w for w in rest if w[-1] in self.marks and w[:-1].isalpha()]  # letters and a mark are two pre-tokens
        bases = {w[:-1] for w in marked}.difference(new)
        bases = dict(zip(bases, map(known.get, bases)))
        new.update([(w, ids) for w, ids in bases.items() if ids is not None])
        new.update(self._words([w for w, ids in bases.items() if ids is None]))
        marks = self.marks
        new.update([(w, new[w[:-1]] + marks[w[-1]]) for w in marked])
        new.update([(w, self._own(self.chunk, w)) for w in rest if w not in new])
        table.update(new)
        if len(known) + len(new) > CACHE_WORDS:
            self.known = dict(table)
        else:
            known.update(new)
        return table

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of letters: each is one pre-token, and its ids end at the one with the mark of a word's end."""
        size, made = self.dtype.itemsize, {}
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            ids = np.array(self.word.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * size
            if len(ends) == len(part):
                flat, ends = ids.tobytes(), ends.tolist()
                made.update(zip(part, [flat[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                made.update([(w, self._own(self.chunk, w)) for w in part])
        return made

    def _own(self, tokenizer, text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def loaded(path: str, dtype: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("tokens", path, dtype), lambda: Encoder(path, dtype))


def id_bits(path: str, end_id: int) -> int:
    """The least width that holds the vocabulary and the end id."""
    from tokenizers import Tokenizer

    return max(1, max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length())


_TABLE = "bucket int, segment int, first_id long, last_id long, doc_ids array<long>, n_tokens long, payload binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> tuple[DataFrame, str]:
    """Encodes and writes; returns the file table (bucket, segment, first_id, last_id, doc_ids, n_tokens, payload) and its path.

    The file table goes to ``out``, where it stays; without ``out`` to the shared folder, where it is dropped when the interpreter ends.
    Texts are encoded where they are read; ids in the fewest whole bytes are shuffled into ranges
    of document ids. The ranges come from a quantile sketch of the id column alone, so nothing is encoded twice.
    """
    spark = docs.sparkSession
    n = n_partitions(spark, docs.select(id_col, text_col))
    bits = id_bits(path, end_id)
    wire = "<u2" if bits <= 16 else "<u4"
    size = int(wire[2])
    keys = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = keys.agg(F.percentile_approx("id", F.array(*[F.lit((k + 1) / n) for k in range(n - 1)]), F.lit(20 * n)).alias("c")).first()["c"] if n > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)  # one less than buckets at most

    def encode(batches):
        coder, tail = loaded(path, wire), np.array([end_id], wire).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                coded = coder.encode(part.column(1).to_pylist(), tail)
                ids = part.column(0)
                found = np.searchsorted(cuts, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), ids, pa.array([len(c) // size for c in coded], pa.int64()), pa.array(coded, pa.binary())], names=["bucket", "id", "n", "coded"])
        release()

    def gather(batches):
        bucket, k, ids, held, total = None, 0, [], [], 0

        def row():
            flat = [np.frombuffer(c, wire) for c in held]
            known = [i for i in ids if i is not None]
            made = {"bucket": bucket, "segment": k, "first_id": known[0] if known else None, "last_id": known[-1] if known else None, "doc_ids": ids, "n_tokens": total, "payload": segment(flat, bits)}
            return pa.RecordBatch.from_pylist([made], schema=_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for b, i, m, c in zip(*(part.column(name).to_pylist() for name in ("bucket", "id", "n", "coded"))):
                    if held and (b != bucket or total + m > SEGMENT_TOKENS):
                        yield row()
                        k, ids, held, total = (k + 1 if b == bucket else 0), [], [], 0
                    bucket = b
                    ids.append(i)
                    held.append(c)
                    total += m
        if held:
            yield row()

    given = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    coded = given.mapInArrow(encode, "bucket int, id long, n long, coded binary")
    ranged = coded.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "id", "n", "coded")
    made = ranged.mapInArrow(gather, _TABLE)
    if out is None:
        return written(made, "tokens")
    made.write.parquet(out)
    return spark.read.schema(made.schema).parquet(out), out


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The file table with ``base``, the number of ids before each segment. Payloads stay where they are read."""
    table = spark.read.schema(_TABLE).parquet(path)
    in_bucket = W.partitionBy("bucket").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    sizes = table.groupBy("bucket").agg(F.sum("n_tokens").alias("size"))
    # as many rows as buckets, which the number of partitions bounds
    starts = sizes.select("bucket", F.coalesce(F.sum("size").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("bucket_start"))
    within = table.select("bucket", "segment", F.coalesce(F.sum("n_tokens").over(in_bucket), F.lit(0)).alias("before"))
    placed = within.join(starts, "bucket").select("bucket", "segment", (F.col("before") + F.col("bucket_start")).alias("base"))
    if table.count() <= BROADCAST_SEGMENTS:  # three numbers a segment; more of them are joined by a shuffle
        placed = F.broadcast(placed)
    return table.join(placed, ["bucket", "segment"])


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """Reads a file table back: per document id, start, n_tokens, ids_crc32 and, with ``keep_ids``, ids.

    With ``first`` or ``last`` only documents whose id is in that range (ends included): segments without one aren't read,
    and of the others only those documents are unpacked.
    """
    table = _placed(spark, path)
    if first is not None:
        table = table.where(F.col("last_id") >= first)
    if last is not None:
        table = table.where(F.col("first_id") <= last)

    def out(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                seg = Segment(batch.column("payload")[k].as_py())
                base, o, docs = batch.column("base")[k].as_py(), seg.offsets, batch.column("doc_ids")[k].values
                a, b = 0, seg.n_docs
                if first is not None or last is not None:  # ids ascend, nulls first
                    known = np.array([-(1 << 63) if i is None else i for i in docs.to_pylist()], np.int64)
                    a = int(np.searchsorted(known, first, "left")) if first is not None else docs.null_count
                    b = int(np.searchsorted(known, last, "right")) if last is not None else len(known)
                    a = max(a, docs.null_count)
                if a >= b:
                    continue
                ids, at = seg.ids(int(o[a]), int(o[b])), o[a : b + 1] - o[a]
                parts = [ids[i:j] for i, j in zip(at[:-1], at[1:])]
                cols = [docs.slice(a, b - a), pa.array(base + o[a:b], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if keep_ids:
                    cols.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids])

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return table.select("doc_ids", "payload", "base").mapInArrow(out, schema).withColumnRenamed("id", id_col)


def read_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """Ids begin .. end (not included) of the whole stream: rows (start, ids), one for each segment that the range touches, of
    which only the range is unpacked."""
    table = _placed(spark, path).where((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > begin))

    def out(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                seg, base = Segment(batch.column("payload")[k].as_py()), batch.column("base")[k].as_py()
                a, b = max(0, begin - base), min(seg.n_tokens, end - base)
                yield pa.RecordBatch.from_arrays([pa.array([base + a], pa.int64()), pa.array([seg.ids(a, b).astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    return table.select("payload", "base").mapInArrow(out, "start long, ids array<int>")
