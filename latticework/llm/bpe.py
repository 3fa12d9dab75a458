"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A pre-token starts as its bytes. Leaf i of the tree holds ``rank * width + i`` of the pair that starts at
symbol i (or no merge); every inner node holds the least of its children, so the root is the leftmost pair of
lowest rank. A merge changes three leaves (the pair itself, the pair before it and the symbol that vanished),
each a path of log2(width) nodes, until the root says that no pair can be merged.

Short pre-tokens are merged many at a time (one row of a matrix each, trees of equal width side by side); long
ones one at a time. Each distinct pre-token of a worker is merged once; the table of known ones is emptied when
it reaches ``CACHE_WORDS`` entries, which changes speed only.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; the special
token's string inside a text becomes its id, as the tokenizers library does by default; very long texts and pre-tokens are encoded whole; repeated rows give
repeated rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from latticework.llm.common import kept, text_or_empty

CACHE_WORDS = 1_000_000  # some 200 bytes each
WIDE = 128  # longer pre-tokens are merged one at a time
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    rest = [b for b in range(256) if not out[b]]
    for k, b in enumerate(rest):
        out[b] = chr(256 + k)
    return out


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _ranges(kind: str) -> str:
    """The characters of the basic plane that the regex library has in a class, as ranges of a character set."""
    inside, out, start = regex.compile(kind).match, [], None
    for c in range(0x10001):
        has = c < 0x10000 and not 0xD800 <= c <= 0xDFFF and inside(chr(c)) is not None
        if has and start is None:
            start = c
        elif not has and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


def basic_plane(pattern: str) -> re.Pattern | None:
    """The pattern for the standard library, which matches faster and the same on texts of the basic plane: its Unicode classes are written out
    as the regex library has them. None where it has other classes than letters, numbers and white space."""
    sets = {kind: _ranges(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, in_set, at = [], False, 0
    while at < len(pattern):
        kind = next((k for k in (*sets, r"\S") if pattern.startswith(k, at)), None)
        if kind == r"\S":
            if in_set:
                return None
            out.append(f"[^{sets[r'\s']}]")
        elif kind:
            out.append(sets[kind] if in_set else f"[{sets[kind]}]")
        elif pattern[at] == "\\":
            return None
        else:
            in_set = pattern[at] == "[" or in_set and pattern[at] != "]"
            out.append(pattern[at])
        at += len(kind) if kind else 1
    try:
        return re.compile("".join(out))
    except re.error:
        return None


class Bpe:
    """Byte-level BPE of a tokenizers JSON file (no normalizer, one split pattern)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.split = regex.compile(pattern)
        self.quick = basic_plane(pattern) or self.split
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.piece = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, k in vocab.items():
            self.piece[k] = bytes(to_byte[c] for c in s)
        for s, k in self.special.items():
            self.piece[k] = s.encode()
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        self.rank = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(pairs)))}
        self.made = np.array([c for _, _, c in pairs], np.int64)
        key = np.array([a << 20 | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = np.append(key[order], NONE), np.append(order, 0)
        self.known: dict[str, bytes] = {}

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = a << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_long(self, word: bytes) -> bytes:
        """One pre-token of any length by a tree in plain lists."""
        tok = self.first[np.frombuffer(word, np.uint8)].tolist()
        n, width = len(tok), 1 << max(1, (len(tok) - 1).bit_length())
        none, rank, made = 1 << 62, self.rank, self.made.tolist()
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := rank.get((tok[i], tok[i + 1]))) is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        def pair(i: int) -> int:
            j = after[i]
            r = rank.get((tok[i], tok[j])) if j < n else None
            return none if r is None else r * width + i

        while tree[1] < none:
            r, i = divmod(tree[1], width)
            j = after[i]
            tok[i], after[i] = made[r], after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Pre-tokens of 1 to ``width`` bytes, each one row: the same steps for all rows whose root still has a merge."""
        rows, shift = len(words), width.bit_length() - 1
        size = np.fromiter(map(len, words), np.int64, rows)
        flat = self.first[np.frombuffer(b"".join(words), np.uint8)]
        start = np.cumsum(size) - size
        col = np.arange(width)
        inside = col < size[:, None]
        tok = np.zeros((rows, width), np.int64)
        tok[inside] = flat
        tree = np.full((rows, 2 * width), NONE)
        paired = col[:-1] < size[:, None] - 1
        r = self.ranks_of(tok[:, :-1][paired], tok[:, 1:][paired])
        leaf = np.full(len(r), NONE)
        leaf[r >= 0] = r[r >= 0] << shift | np.broadcast_to(col[:-1], paired.shape)[paired][r >= 0]
        tree[:, width : 2 * width - 1][paired] = leaf
        level = width
        while level > 1:
            level >>= 1
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        after = np.tile(col + 1, (rows, 1))
        before = np.tile(col - 1, (rows, 1))
        tree, tok, after, before = tree.ravel(), tok.ravel(), after.ravel(), before.ravel()
        live = np.ones(rows * width, bool)

        def put(row: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            base, k = row * (2 * width), i + width
            tree[base + k] = value
            for _ in range(shift):
                k = k >> 1
                at = base + 2 * k
                tree[base + k] = np.minimum(tree[at], tree[at + 1])

        def pair(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            base, fits = row * width, j < size[row]
            r = self.ranks_of(tok[base + i], tok[base + np.where(fits, j, 0)])
            return np.where(fits & (r >= 0), r << shift | i, NONE)

        row = np.arange(rows)
        while True:
            root = tree[row * (2 * width) + 1]
            more = root < NONE
            row, root = row[more], root[more]
            if not len(row):
                break
            i, base = root & (width - 1), row * width
            j = after[base + i]
            k = after[base + j]
            tok[base + i] = self.made[root >> shift]
            live[base + j] = False
            after[base + i] = k
            tail = k < size[row]
            before[(base + k)[tail]] = i[tail]
            put(row, j, np.full(len(row), NONE))
            put(row, i, pair(row, i, k))
            p = before[base + i]
            has = p >= 0
            put(row[has], p[has], pair(row[has], p[has], i[has]))
        keep = inside & live.reshape(rows, width)
        left = tok.reshape(rows, width)[keep].astype("<u4").tobytes()
        end = (np.cumsum(keep.sum(1)) * 4).tolist()
        return [left[a:b] for a, b in zip([0, *end], end)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            classes.setdefault(max(1, (len(w) - 1).bit_length()), []).append(k)
        for bits, members in classes.items():
            width = 1 << bits
            if width > WIDE:
                for k in members:
                    out[k] = self.merge_long(words[k])
                continue
            step = max(1, (1 << 19) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, ids in zip(part, self.merge_rows([words[k] for k in part], width)):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, astral, parts = self.known, ASTRAL.search, []
        for text in texts:
            split = (self.quick if text.isascii() or astral(text) is None else self.split).findall
            if self.cut and any(s in text for s in self.special) and self.cut.search(text):
                words: list[str] = []
                for seg in self.cut.split(text):
                    if seg in self.special:
                        known[seg] = np.array([self.special[seg]], "<u4").tobytes()
                        words.append(seg)
                    else:
                        words += split(seg)
                parts.append(words)
            else:
                parts.append(split(text))
        fresh: set[str] = set()
        for words in parts:
            fresh.update(words)
        new = [w for w in fresh if w not in known]
        if new:
            known.update(zip(new, self.merge([w.encode() for w in new])))
        look = known.__getitem__
        return [b"".join(map(look, words)) for words in parts]

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8; bytes that are not UTF-8 become replacement characters."""
        raw = b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


def loaded(path: str, pattern: str) -> Bpe:
    return kept(("bpe", path, pattern), lambda: Bpe(path, pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array of int) and decoded (string)."""
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = bpe.encode(part.column(1).to_pylist())
                plain = [bpe.decode(c) for c in coded]
                cols = [
                    part.column(0),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(p).hexdigest() for p in plain]),
                ]
                if keep_ids:
                    cols += [pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32())), pa.array([p.decode() for p in plain], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[n.split()[0] for n in schema.split(", ")])

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
