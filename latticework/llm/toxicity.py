"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

A window is a word of a text (lower case; letters, cut after 48 characters) between spaces, three times, so that even a
short one can pay for a compressed block. It is compressed once with each dictionary; its two lengths and
its own length make a cell. A cell's weight is the smoothed log-odds that a toxic text has a window in it, so the
thresholds on the two lengths are calibrated for each window length. A text's score is a logistic
function of its three largest weights (distinct windows), over all its windows.

Learning, on at most ``max_sample`` labelled texts of each label (by hash of the id; rows whose crc32(id) mod 5 is 0
are left out), of which the driver gets at most ``max_windows`` distinct windows each (those of the least hashes): near copies (equal
least shingle hash) count once. The toxic dictionary holds the windows that
stand out in toxic texts by more than z standard deviations, the ordinary one the commonest windows of
ordinary texts. Cells and the logistic function are fitted across folds: texts are weighed by dictionaries that
were made without them. z is the one of ``Z`` with the least loss so.

Defined cases: a null or empty text, or one without letters, has no window and gets the score of three zero weights;
with no labelled row of one of the labels every score is the share of toxic ones (0 without any label); documents
with repeated ids are scored each, and a label counts for each of them; null ids are held out of learning and have
held_out false; an empty table gives an empty result; very long texts are scored by all their windows; other columns are not read,
and pass through with ``keep`` whatever their names (those named as the results make way).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import kept, text_or_empty

Z = (2.0, 3.0, 4.5, 7.0)
FOLDS = 3
DICT_BYTES = 8192
LETTERS = re.compile(r"[^\W\d_]{1,48}")
TOP = 3
REPEAT = 3
PAD = b"\n" * 16  # the last bytes of a dictionary aren't indexed
CACHE_WORDS = 300_000


def windows(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    cells: dict[tuple[int, int, int], float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0,) * (TOP + 1)
    prior: float = 0.0

    def __post_init__(self) -> None:
        self._t = self._o = None
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("toxic", "ordinary", "cells", "weights", "prior")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def cell(self, word: str) -> tuple[int, int, int]:
        if self._t is None:
            self._t, self._o = compressor(self.toxic), compressor(self.ordinary)
        w = f" {word} ".encode()
        return min(len(w), 30), len(self._t(w * REPEAT)), len(self._o(w * REPEAT))

    def top(self, text: str) -> list[float]:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        words = windows(text)
        for w in words.difference(known):
            known[w] = self.cells.get(self.cell(w), 0.0)
        return largest([known[w] for w in words])

    def score(self, text: str) -> float:
        if not self.cells:
            return self.prior
        return float(squash(self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], self.top(text)))))


def largest(values: list[float]) -> list[float]:
    return sorted((v for v in sorted(values, reverse=True)[:TOP]), reverse=True) + [0.0] * max(0, TOP - len(values))


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


def dictionary(words: list[str]) -> bytes:
    """The given windows, the first nearest to the end, where matches are cheapest; contained ones are left out."""
    out = b""
    for w in words:
        if len(out) >= DICT_BYTES:
            break
        if (x := f" {w} ".encode()) not in out:
            out = x + out
    return out[-DICT_BYTES:] + PAD


def least_shingle(text: str) -> int:
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    return min(xxh64_intdigest(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 2)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = squash(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, str, int]]) -> Model:
    """A model of (least shingle, windows with spaces between, label) rows, labels 0 or 1; rows are taken in their order, so reruns agree."""
    labels = [y for *_, y in rows]
    if len(set(labels)) < 2:
        return Model(prior=float(sum(labels)) / max(1, len(labels)))
    once: dict[tuple[int, int], str] = {}
    for shingle, found, y in sorted(rows):
        once.setdefault((shingle, y), found)
    index: dict[str, int] = {}
    docs, labels = [], []
    for (_, y), found in once.items():
        docs.append(np.array(sorted(index.setdefault(w, len(index)) for w in found.split()), np.int64))
        labels.append(y)
    y = np.array(labels)
    words = list(index)
    fold = np.array([shingle % FOLDS for shingle, _ in once])
    df = np.array([[sum_of(docs, (fold == f) & (y == c), len(words)) for c in (0, 1)] for f in range(FOLDS)])

    def sides(use: np.ndarray, z: float) -> tuple[bytes, bytes]:
        n = np.array([np.isin(fold, use)[y == c].sum() for c in (0, 1)])
        a, b = df[use, 1].sum(0), df[use, 0].sum(0)
        p = (a + b) / max(1, n.sum())
        far = (a - n[1] * p) / np.sqrt(n[1] * p * (1 - p) + 1e-9)
        found = np.flatnonzero((far > z) & (a >= 2))
        found = found[np.argsort(-far[found], kind="stable")]
        return dictionary([words[k] for k in found[: DICT_BYTES // 3]]), dictionary([words[k] for k in np.argsort(-b, kind="stable")[: DICT_BYTES // 3]])

    best = None
    for z in Z:
        cells: list[dict[int, tuple[int, int, int]]] = []
        for f in range(FOLDS):  # what each fold's texts look like to dictionaries made without them
            m = Model(*sides(np.flatnonzero(np.arange(FOLDS) != f), z))
            seen = np.unique(np.concatenate([docs[k] for k in np.flatnonzero(fold == f)] or [np.zeros(0, np.int64)]))
            cells.append({int(k): m.cell(words[k]) for k in seen})
        per_doc = [{cells[fold[k]][w] for w in d.tolist()} for k, d in enumerate(docs)]
        x = np.zeros((len(docs), TOP))
        for f in range(FOLDS):  # and to weights made without them
            odds = log_odds(per_doc, y, fold != f)
            for k in np.flatnonzero(fold == f):
                x[k] = largest([odds.get(cells[f][w], 0.0) for w in docs[k].tolist()])
        w = logistic(x, y)
        p = np.clip(squash(w[0] + x @ w[1:]), 1e-6, 1 - 1e-6)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = loss, z, log_odds(per_doc, y, np.ones(len(y), bool)), tuple(w)
    _, z, odds, w = best
    return Model(*sides(np.arange(FOLDS), z), odds, w, float(y.mean()))


def sum_of(docs: list[np.ndarray], which: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(np.concatenate([docs[k] for k in np.flatnonzero(which)] or [np.zeros(0, np.int64)]), minlength=n)


def log_odds(per_doc: list[set], y: np.ndarray, which: np.ndarray) -> dict[tuple[int, int, int], float]:
    counts = (Counter(), Counter())
    n = [0, 0]
    for k in np.flatnonzero(which):
        counts[y[k]].update(per_doc[k])
        n[y[k]] += 1
    return {c: math.log((counts[1][c] + 0.3) / (n[1] + 0.6)) - math.log((counts[0][c] + 0.3) / (n[0] + 0.6)) for c in sorted(set(counts[0]) | set(counts[1]))}


def some_windows(text: str, most: int) -> str:
    """The text's distinct windows, or those of the least hashes, with spaces between."""
    found = windows(text)
    if len(found) > most:
        found = sorted(found, key=lambda w: (zlib.crc32(w.encode()), w))[:most]
    return " ".join(sorted(found))


def sample(docs: DataFrame, labels: DataFrame, max_sample: int, max_windows: int, id_col: str, text_col: str, label_col: str) -> list[tuple[int, str, int]]:
    """At most ``max_sample`` labelled rows of each label that are not held out: (least shingle, windows, label). The driver gets at
    most ``max_windows`` windows of each, of 48 letters at most."""
    known = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("k").cast("string")) % 5 != 0).groupBy("k").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(max_sample) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_sample small rows at most

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column("t").to_pylist()
                shingles = [least_shingle(t) >> 1 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(shingles, pa.int64()), pa.array([some_windows(t, max_windows) for t in texts]), part.column("y")], names=["k", "s", "w", "y"])

    texts = docs.select(F.col(id_col).cast("long").alias("k"), text_or_empty(text_col).alias("t")).join(ids, "k").select("k", "t", "y")
    made = texts.mapInArrow(cut, "k long, s long, w string, y int")
    # repeated ids: no more rows than ids
    made = made.groupBy("k").agg(F.min(F.struct("s", "w", "y")).alias("r"))
    return [(r["s"], r["w"], r["y"]) for r in made.select("r.*").toLocalIterator()]


def toxicity(docs: DataFrame, labels: DataFrame, max_sample: int = 4000, max_windows: int = 2048, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: bool = False) -> DataFrame:
    """Per document: id, held_out, score and predicted; with ``keep`` the other columns of ``docs`` come too."""
    model = fit(sample(docs, labels, max_sample, max_windows, id_col, text_col, label_col))
    return apply(docs, model, id_col, text_col, keep)


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")] if keep else [id_col]
    # the caller's columns travel in one, so none of their names can clash
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), text_or_empty(text_col).alias("text"))
    out = T.StructType([given.schema["doc"], T.StructField("score", T.DoubleType())])

    def run(batches):
        m = loaded(model)
        for batch in batches:
            texts = batch.column(1)
            scores = [m.score(t) for at in range(0, batch.num_rows, 256) for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc", "score"])

    scored = given.mapInArrow(run, out)
    one = F.col("doc").getField(id_col)
    held = F.coalesce(F.crc32(one.cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    columns = [F.col("doc").getField(c).alias(c) for c in rest] if keep else [one.cast("long").alias(id_col)]
    return scored.select(*columns, held, "score", predicted)


def loaded(model: Model) -> Model:
    """The model with this worker's table of known windows, kept between tasks."""
    return kept(("toxicity", model.toxic, model.ordinary, repr(sorted(model.cells.items()))), lambda: model)
