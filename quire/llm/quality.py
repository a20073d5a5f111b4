"""Quality classifier: Naive Bayes support vectors (NB-SVM).

Binary n-gram indicators are scaled by the class log-count ratios and a linear
hinge-loss model is fitted on them by dual coordinate descent; Platt's logistic
maps margins to scores.  The model is fitted on a bounded sample and is a vector
of 2**bits floats, so scoring reads each text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.textops import MIX, chunks, distinct_pairs, hash_words, mix, ngram_hashes, split_words


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 8_000  # labelled rows the model is fitted on, lowest hash first
    bits: int = 18  # indicators are hashed into 2**bits columns
    calibration: int = 4  # one row in so many fits the score curve, not the weights
    alpha: float = 1.0
    cost: float = 1.0
    epochs: int = 20
    threshold: float = 0.3


@dataclass
class Model:
    weights: np.ndarray  # by column: coefficient times log-count ratio
    squares: np.ndarray  # by column: the ratio's square, for the length of a row
    bias: float
    slope: float
    offset: float


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other characters kept, runs collapsed."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def indicators(texts: pa.LargeStringArray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of the distinct indicators of each text, in order.

    Word 1- and 2-grams, 1- to 3-grams of word shapes, and n-grams of equal
    words (two, three in a row)."""
    offsets, codes, words = split_words(texts)
    owners, values = [], []

    def add(h: np.ndarray, owner: np.ndarray, family: int) -> None:
        owners.append(owner)
        values.append(mix(h + np.uint64(int(MIX) * family & (1 << 64) - 1)) >> np.uint64(64 - bits))

    word, look = hash_words(words)[codes], hash_words([shape(w) for w in words], 1)[codes]
    for family, (h, n) in enumerate(((word, 1), (word, 2), (look, 1), (look, 2), (look, 3))):
        add(*ngram_hashes(h, offsets, n), family)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in (2, 3):
        same = np.ones(max(0, len(codes) - n + 1), bool)
        for k in range(1, n):
            same &= (codes[: len(same)] == codes[k : len(same) + k]) & (owner[: len(same)] == owner[k : len(same) + k])
        at = owner[: len(same)][same]
        add(np.full(len(at), n, np.uint64), at, 9)
    who, column, _ = distinct_pairs(np.concatenate(owners), np.concatenate(values), bits)
    return who, column.astype(np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> Model:
    """rows: columns of each document's indicators; y: 1 or 0."""
    dim = 1 << s.bits
    fitting = np.arange(len(rows)) % s.calibration != 0
    if len(rows) and y.min() < y.max() and len(set(y[fitting])) < 2:
        fitting[:] = True  # only the held-out rows have one of the labels
    if len(rows) == 0 or y.min() == y.max():
        p = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(dim), np.zeros(dim), 0.0, 1.0, float(np.log(p / (1 - p))))
    counts = np.full((2, dim), s.alpha)
    for i in np.flatnonzero(fitting):
        counts[int(y[i]), rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    w, bias = np.zeros(dim), 0.0
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.maximum(1, np.bincount(y.astype(int)[fitting], minlength=2))
    most = s.cost * fitting.sum() / (2.0 * share)  # classes weigh the same
    norm = np.array([1.0 / max(1e-12, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows])
    x = [ratio[r] * k for r, k in zip(rows, norm, strict=True)]
    dual = np.zeros(len(rows))
    order = np.random.default_rng(0)
    at = np.flatnonzero(fitting)
    for _ in range(s.epochs):
        moved = 0.0
        for i in order.permutation(at):
            r, v = rows[i], x[i]
            slack = 1.0 - sign[i] * (w[r] @ v + bias)
            new = min(max(dual[i] + slack / (v @ v + 1.0), 0.0), most[int(y[i])])
            step = (new - dual[i]) * sign[i]
            if step:
                dual[i] = new
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    held = ~fitting if (~fitting).any() and len(set(y[~fitting])) == 2 else fitting
    margins = np.array([w[rows[i]] @ x[i] + bias for i in np.flatnonzero(held)])
    slope, offset = platt(margins, y[held])
    return Model(w * ratio, ratio * ratio, bias, slope, offset)


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for the logistic of slope * m + offset, with Platt's smoothed targets."""
    n1, n0 = (y > 0).sum(), (y == 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * m * m).sum() + 1e-6, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        k = 1.0 / max(1.0, float(np.abs(d).max()) / 5)
        a, b = a - k * d[0], b - k * d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(max(a, 1e-6)), float(b)


def sample_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, text, y``: the labelled training rows with the lowest hash of the id.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out; several labels of a
    document count as their minimum, several texts as the smallest.  At most
    ``sample_rows`` ids, so the id list is safe to broadcast and the sample has
    as many rows."""
    ids = (
        labels.where("doc_id is not null and quality is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(s.sample_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on the sample; the driver sees only its hashed indicators."""
    bits = s.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            who, column = indicators(texts, bits)
            ends = np.searchsorted(who, np.arange(batch.num_rows + 1))
            packed = [column[a:b].astype(np.uint32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], names=["doc_id", "y", "x"])

    sample = sample_rows(docs, labels, s)
    kind = sample.schema["doc_id"].dataType.simpleString()
    # ids are in order, so reruns agree
    found = sample.mapInArrow(run, f"doc_id {kind}, y int, x binary").toArrow().sort_by("doc_id")
    rows = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in found["x"]]
    return fit(rows, found["y"].to_numpy().astype(np.int64), s)


def probabilities(texts: pa.LargeStringArray, model: Model, bits: int) -> np.ndarray:
    who, column = indicators(texts, bits)
    total = np.bincount(who, model.weights[column], len(texts))
    length = np.sqrt(np.bincount(who, model.squares[column], len(texts)))
    margin = total / np.maximum(length, 1e-12) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """``doc_id, score`` of every row: how likely label 1 is, 0 to 1.

    * Null and empty texts have no indicators: the score of the bias alone.
    * Equal texts score equally; every repeated row is returned.  A null doc_id
      is returned as null.  Other columns are ignored.
    * Without labels of both classes every score is the smoothed share of 1;
      an empty table gives an empty one.
    * A very long text is read whole, by one task.
    """
    shared, bits = docs.sparkSession.sparkContext.broadcast(model), s.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(texts, shared.value, bits))], names=["doc_id", "score"])

    lean = docs.select("doc_id", "text")
    return lean.mapInArrow(run, f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold.

    Rows are judged each by its text, as ``score`` does; null ids and repeated
    rows stay what they are."""
    shared, bits, least = docs.sparkSession.sparkContext.broadcast(model), s.bits, s.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text):
            yield batch.filter(pa.array(probabilities(texts, shared.value, bits) >= least))

    # columns by number: a map cannot take names with a dot
    plain, text = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_quality_classifier(spark, sf_dir):
    from quire.llm.store import read_table

    s = Settings()
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, train(docs, read_table(spark, sf_dir, "labels"), s), s)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
