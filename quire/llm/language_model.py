"""LM scoring by cross-entropy difference (Moore and Lewis).

Two bigram models of the same order and smoothing, one of a target text and one
of the background, share one vocabulary.  A document's score is the mean over its
tokens of the target's loss less the background's: the lower, the more it reads
like the target.

Every word and pair counts, however rare, so the model grows with the input and
is gathered nowhere.  Texts are cut into pieces of bounded size, kept as word
codes.  A piece sends its distinct words and pairs as sorted hashes with counts,
one block per range of hashes; whoever has a range sums the counts of all pieces
and answers every block with the totals, in its order.  The totals then meet the
codes.  A word that half of all texts hold is one hash per piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import materialize
from quire.llm.textops import MIX, chunks, hash_words, mix, split_words

PIECE = 8 << 20  # bytes of text whose distinct words and pairs are counted together; a longer text is one piece
RANGE_TOKENS = 1 << 20  # tokens for each range of hashes; a task holds the distinct words and pairs of one
START = 0  # stands for the beginning of a text
PIECES = "piece long, side int, ids array<{kind}>, texts int, n long, sizes binary, codes binary, words binary"
TARGET, BACKGROUND, OTHER = 1, 0, 2


@dataclass(frozen=True)
class Settings:
    prior: float = 16.0  # weight of p(word) against a history's counts
    add: float = 0.5  # added to every word's count


@dataclass
class Model:
    target: DataFrame  # pieces
    background: DataFrame  # pieces
    source: DataFrame  # the table that the background's pieces were cut from


def pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed: high bytes of small numbers cost nothing."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return pa.Codec("zstd").compress(planes, asbytes=True)


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pieces(df: DataFrame, side: int) -> DataFrame:
    """One row per piece of ``df(doc_id, text)``, written: the ids and word counts of its
    texts, the code of every token, and the hashes of its distinct words by code."""
    named = "doc_id" in df.columns
    kind = df.schema["doc_id"].dataType.simpleString() if named else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = side << 60 | TaskContext.get().partitionId() << 32
        for batch, texts in chunks(batches, "text", PIECE):
            offsets, codes, words = split_words(texts)
            h = hash_words(words)
            ids = batch.column("doc_id") if named else pa.nulls(batch.num_rows, pa.int64())
            row = {
                "piece": pa.array([at]), "side": pa.array([side], pa.int32()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "texts": pa.array([len(ids)], pa.int32()), "n": pa.array([len(codes)]), "sizes": pa.array([pack(np.diff(offsets).astype(np.int32))]),
                "codes": pa.array([pack(codes.astype(np.int32))]), "words": pa.array([np.where(h == START, 1, h).astype(np.uint64).tobytes()]),
            }
            yield pa.RecordBatch.from_pydict(row)
            at += 1

    return materialize(df.select(*["doc_id"] * named, "text").mapInArrow(run, PIECES.format(kind=kind)))


class Counted:
    """A piece's tokens with its distinct words and pairs in the order of their hashes."""

    def __init__(self, row: dict):
        self.offsets = np.concatenate([[0], np.cumsum(unpack(row["sizes"], row["texts"], np.int32))]).astype(np.int64)
        codes = unpack(row["codes"], row["n"], np.int32)
        words = np.append(np.frombuffer(row["words"], np.uint64), np.uint64(START))
        n = len(words) - 1  # the code of the beginning
        before = np.full(len(codes), n, np.int64)
        before[1:] = codes[:-1]
        before[self.offsets[:-1][np.diff(self.offsets) > 0]] = n
        key, self.pair, self.pair_count = np.unique(before * (n + 1) + codes, return_inverse=True, return_counts=True)
        self.history, self.word = key // (n + 1), key % (n + 1)
        self.word_hash, self.pair_hash = words, mix(words[self.history] * MIX + words[self.word])
        self.word_order, self.pair_order = np.argsort(self.word_hash, kind="stable"), np.argsort(self.pair_hash, kind="stable")
        self.word_count, self.history_count = np.bincount(codes, minlength=n + 1), np.bincount(before, minlength=n + 1)


def blocks(cut: DataFrame, bits: int) -> DataFrame:
    """``piece, range, words, pairs, data``: the words and pairs of each piece by the first ``bits`` of their hashes."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Counted(row)
                word, pair = c.word_hash[c.word_order], c.pair_hash[c.pair_order]
                counts = [c.word_count[c.word_order], c.history_count[c.word_order], c.pair_count[c.pair_order]]
                every = np.arange((1 << bits) + 1, dtype=np.uint64)
                w_at, p_at = (np.searchsorted(x >> shift, every) for x in (word, pair))
                out = {"range": [], "words": [], "pairs": [], "data": []}
                for r in np.flatnonzero(np.diff(w_at) + np.diff(p_at)).tolist():
                    a, b, d, e = int(w_at[r]), int(w_at[r + 1]), int(p_at[r]), int(p_at[r + 1])
                    out["range"].append(r)
                    out["words"].append(b - a)
                    out["pairs"].append(e - d)
                    # hashes ascend, so their differences are small
                    parts = [np.diff(word[a:b], prepend=np.uint64(0)), np.diff(pair[d:e], prepend=np.uint64(0)), counts[0][a:b], counts[1][a:b], counts[2][d:e]]
                    out["data"].append([pack(x.astype(k)) for x, k in zip(parts, (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32), strict=True)])
                kinds = {"range": pa.int32(), "words": pa.int32(), "pairs": pa.int32(), "data": pa.list_(pa.binary())}
                cols = [pa.array([row["piece"]] * len(out["range"]), pa.int64()), *[pa.array(out[k], t) for k, t in kinds.items()]]
                yield pa.RecordBatch.from_arrays(cols, names=["piece", *kinds])

    return cut.drop("ids").mapInArrow(run, "piece long, range int, words int, pairs int, data array<binary>")


def answers(asked: DataFrame, side: int) -> DataFrame:
    """``piece, range, words, pairs, vocabulary, data``: the totals for every block of a piece of ``side``.

    A row without a piece has the number of words of the range that target or background hold."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sides = [r["piece"] >> 60 for r in rows]

        def totals(n: str, key: int, *counts: int) -> tuple[int, list]:
            """How many hashes the two texts hold, and for every row its totals: target, background of each count."""
            every = np.concatenate([np.cumsum(unpack(r["data"][key], r[n], np.uint64), dtype=np.uint64) for r in rows])
            distinct, at = np.unique(every, return_inverse=True)
            cuts, sums = np.cumsum([r[n] for r in rows])[:-1], []
            for c in counts:
                for of in (TARGET, BACKGROUND):
                    x = np.concatenate([unpack(r["data"][c], r[n], np.uint32) if s == of else np.zeros(r[n], np.uint32) for r, s in zip(rows, sides, strict=True)])
                    sums.append(np.bincount(at, x, len(distinct)).astype(np.int64))
            held = int(np.count_nonzero(sums[0] + sums[1]))
            return held, list(zip(*[np.split(x[at], cuts) for x in sums], strict=True))

        words, of_words = totals("words", 0, 2, 3)
        _, of_pairs = totals("pairs", 1, 4)
        out = [{"piece": None, "range": rows[0]["range"], "words": 0, "pairs": 0, "vocabulary": words, "data": []}]
        for r, s, w, p in zip(rows, sides, of_words, of_pairs, strict=True):
            if s == side:
                out.append({k: r[k] for k in ("piece", "range", "words", "pairs")} | {"vocabulary": 0, "data": [pack(x) for x in (*w, *p)]})
        kinds = [("piece", pa.int64()), ("range", pa.int32()), ("words", pa.int32()), ("pairs", pa.int32()), ("vocabulary", pa.int64()), ("data", pa.list_(pa.binary()))]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return asked.groupBy("range").applyInArrow(run, "piece long, range int, words int, pairs int, vocabulary long, data array<binary>")


def train(target: DataFrame, background: DataFrame, s: Settings = Settings()) -> Model:
    """Cut both texts into pieces; null texts are empty.  Counts are summed by ``score``,
    once for the words and pairs of model and documents together."""
    return Model(pieces(target, TARGET), pieces(background, BACKGROUND), background)


def score(docs: DataFrame, model: Model, s: Settings = Settings(), leave_out: bool = False) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row.

    Losses are means per token in nats, score their difference.  With c(h, w) the
    times that w follows h, and c(h) the times that anything does, ``p(w | h) =
    (c(h, w) + prior * p(w)) / (c(h) + prior)`` and ``p(w) = (c(w) + add) / (c +
    add * (words + 1))``; words of neither text share the one more place.

    leave_out: ``docs`` is the background itself, and each token is predicted from
    all others, its own occurrence taken out of the background's counts.  Else a
    text that occurs once could hardly be told from one that occurs twice.

    * Null and empty texts have no tokens: losses and score are null.
    * Equal texts score equally; every repeated row is returned, a null doc_id
      as null.  Other columns are ignored; an empty table gives an empty one.
    * A very long text is one piece: a task holds its codes and distinct pairs.
    """
    own = docs is model.source
    if leave_out and not own:
        raise ValueError("only the background itself can be left out")
    lean = model.background if own else pieces(docs.select("doc_id", "text"), OTHER)
    every = model.target.drop("ids").unionAll(model.background.drop("ids"))
    every = every if own else every.unionAll(lean.drop("ids"))
    tokens = dict(every.groupBy("side").agg(F.sum("n")).collect())
    bits = max(1, (sum(tokens.values()) // RANGE_TOKENS).bit_length())
    found = materialize(answers(blocks(every, bits), BACKGROUND if own else OTHER))
    size = 1 + (found.where("piece is null").agg(F.sum("vocabulary")).first()[0] or 0)
    totals = np.array([tokens.get(TARGET) or 0, tokens.get(BACKGROUND) or 0], np.float64)
    out_of = np.array([0, 1 if leave_out else 0])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop(["ids"]).to_pylist()[0]
        c = Counted(row)
        rows = right.sort_by("range").to_pylist()

        def column(n: str, i: int) -> np.ndarray:
            return np.concatenate([unpack(r["data"][i], r[n], np.int64) for r in rows]) if rows else np.empty(0, np.int64)

        length, out = np.diff(c.offsets), []
        owner = np.repeat(np.arange(len(length)), length)
        for i in (0, 1):
            word, history, pair = np.empty(len(c.word_hash)), np.empty(len(c.word_hash)), np.empty(len(c.pair_hash))
            word[c.word_order], history[c.word_order], pair[c.pair_order] = column("words", i), column("words", 2 + i), column("pairs", 4 + i)
            p = (word - out_of[i] + s.add) / (totals[i] - out_of[i] + s.add * size)
            loss = -np.log((pair - out_of[i] + s.prior * p[c.word]) / (history[c.history] - out_of[i] + s.prior))
            out.append(np.bincount(owner, loss[c.pair], len(length)) / np.maximum(length, 1))
        columns = [pa.array(x, mask=length == 0) for x in (*out, out[0] - out[1])]
        return pa.table([left["ids"].combine_chunks().flatten(), pa.array(length), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    return lean.groupBy("piece").cogroup(found.where("piece is not null").groupBy("piece")).applyInArrow(run, schema)


def op3_lm_scoring(spark, sf_dir):
    """Documents scored towards the benchmark texts, against all other documents."""
    from quire.llm.store import read_table

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(read_table(spark, sf_dir, "benchmark"), docs), leave_out=True)
