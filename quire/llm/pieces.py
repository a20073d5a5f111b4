"""SentencePiece encoding and decoding with a given model.

Encoding is relational: texts are cut into segments across which no piece can
reach, distinct segments are exploded into substrings of bounded length (those
that a filter of hashes does not exclude) and equi-joined to the piece table, and
the resulting lattice is grouped by segment and folded by a higher-order aggregate.  Viterbi finds the path of the best sum of
scores, which is the encoding of a unigram model.  A BPE model is not scored by sums: there the fold applies, best score first, the
edges that join two neighbouring symbols, which gives the ids of the public
library; Viterbi over its scores does not.

Texts are read twice and never shuffled.  What is shuffled is one row per
distinct segment and chunk.
"""

from __future__ import annotations

import ast
import functools
import hashlib
import heapq
import json
import mmap
import os
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.store import materialize
from quire.llm.textops import MIX, chunks, relax

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
COUNT_CHUNK = 8 << 20
ENCODE_CHUNK = 5 << 19
TABLE_CHARS = 512  # characters whose neighbours are looked up in a table
PACK_ROWS = 1 << 16  # segments whose ids are brought into order at once
GATHER_ROWS = 1 << 19  # segments that the driver gathers at once, about
TASK_SEGMENTS = 40_000  # distinct segments that one task folds
FILTER_BITS = 20  # of the hashes by which substrings are excluded before the join
BEGINS, IS_PIECE = 1, 2


@dataclass(frozen=True)
class Settings:
    lattice_chars: int = 48  # longer segments are folded by the same rules outside the lattice
    shared_rows: int = 3_000_000  # segments sent to every worker at most, the most frequent; the rest is joined
    shared_ids: int = 32_000_000  # and ids of these segments at most


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple  # by id
    scores: tuple
    kinds: tuple
    kind: int  # UNIGRAM or BPE
    dummy_prefix: bool
    unk: int

    @cached_property
    def usable(self) -> dict:
        """piece -> id of the pieces that a text can contain."""
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}

    @cached_property
    def byte_ids(self) -> list | None:
        """Ids of the bytes 0 to 255, or None without byte fallback."""
        found = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        return [found[f"<0x{b:02X}>"] for b in range(256)] if len(found) == 256 else None

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.usable), default=1)

    @cached_property
    def neighbours(self) -> np.ndarray:
        """Pairs of characters that are neighbours in some piece, ascending.

        No piece, and so no merge, reaches across any other pair."""
        pairs = {ord(a) << 21 | ord(b) for p in self.usable for a, b in zip(p, p[1:], strict=False)}
        return np.array(sorted(pairs), dtype=np.uint64)

    @cached_property
    def neighbour_table(self) -> tuple[np.ndarray, np.ndarray]:
        """(code by character, whether two codes are neighbours) for the characters most often in such pairs; code 0 for all others."""
        first, second = self.neighbours >> np.uint64(21), self.neighbours & np.uint64((1 << 21) - 1)
        found, n = np.unique(np.concatenate([first, second]), return_counts=True)
        found = np.sort(found[np.argsort(-n, kind="stable")[:TABLE_CHARS]]).astype(np.int64)
        codes = np.zeros((found[-1] if len(found) else 0) + 2, np.int16)
        codes[found] = np.arange(1, len(found) + 1)
        table = np.zeros((len(found) + 1, len(found) + 1), bool)
        a, b = (codes[np.minimum(x, len(codes) - 1).astype(np.int64)] for x in (first, second))
        table[a, b] = (a > 0) & (b > 0)
        return codes, table

    @cached_property
    def hash_filter(self) -> np.ndarray:
        """By hash of a string: BEGINS if a piece may begin with it, IS_PIECE if it may be one.

        Strings can share a hash, so the filter excludes; it does not find."""
        out = np.zeros(1 << FILTER_BITS, np.uint8)
        chars, n = np.frombuffer("".join(self.usable).encode("utf-32-le"), np.uint32), np.array([len(p) for p in self.usable], np.int64)
        at, hashed = np.cumsum(n) - n, np.zeros(len(n), np.uint64)
        for size in range(1, self.longest + 1):
            long = n >= size
            at, hashed, n = at[long], hashed[long], n[long]
            hashed = hashed * MIX + chars[at + size - 1]
            out[_slots(hashed)] |= BEGINS
            out[_slots(hashed[n == size])] |= IS_PIECE
        return out

    @cached_property
    def costs(self) -> list:
        """The distinct costs (negated scores) of usable pieces, ascending, and last that of an unknown character."""
        return [*sorted({-float(self.scores[i]) for i in self.usable.values()}), unk_cost(self)]

    @cached_property
    def whole(self) -> bool:
        """Whether all costs are whole numbers of 31 bits, as those of trained BPE models are."""
        return all(0 <= c < 1 << 31 and c.is_integer() for c in self.costs)

    @cached_property
    def ranks(self) -> dict:
        """cost -> a number in the order of the costs: the cost itself if all are whole, else its place."""
        return {c: int(c) if self.whole else i for i, c in enumerate(self.costs)}

    @cached_property
    def monotone(self) -> bool:
        """Whether the merges that build a piece come in the order of their scores, for every piece.

        Inside any text the characters of a piece merge as they do alone until the
        piece is built or cut.  So no merge of such a model makes a better one
        possible, and one pass over the edges in order applies them all."""
        rank = {p: -self.scores[i] for p, i in self.usable.items()}
        for piece in rank:
            symbols, last = list(piece), float("-inf")
            while len(symbols) > 1:
                joined = [(rank.get(a + b, float("inf")), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
                best, at = min(joined)
                if best == float("inf"):
                    break
                if best < last:
                    return False
                symbols[at : at + 2], last = [symbols[at] + symbols[at + 1]], best
        return True

    @cached_property
    def surface(self) -> pa.Array:
        """The bytes that each id decodes to."""
        out = []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode())
        return pa.array(out, pa.large_binary())


def load(path: str) -> PieceModel:
    """Read a .model file on the driver.  Models that normalise text are refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    if m.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    kinds = tuple(p.type for p in m.pieces)
    return PieceModel(
        tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), kinds,
        m.trainer_spec.model_type, n.add_dummy_prefix, kinds.index(UNKNOWN),
    )


# -- segments -----------------------------------------------------------------


def _tokens(texts: pa.LargeStringArray, dummy: bool) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """(offsets, codes, distinct) of the space-led tokens of each text, spaces escaped."""
    odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}|^$" if dummy else ".*").to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts), " ")
    offsets = plain.offsets.to_numpy().astype(np.int64)
    coded = plain.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    large = pa.large_string()
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.binary_join_element_wise(pa.scalar(SPACE, large), coded.dictionary, pa.scalar("", large))
    offsets = offsets - offsets[0]
    if not odd.any():
        return offsets, codes, words
    words = words.to_pylist()
    index = {w: i for i, w in enumerate(words)}
    parts, sizes = [], np.diff(offsets)
    for i in np.flatnonzero(odd):
        text = texts[int(i)].as_py().replace(" ", SPACE)
        found = []
        if text:
            # a run of spaces goes with the word after it
            text, at = (SPACE + text if dummy else text), 0
            while at < len(text):
                to = at
                while to < len(text) and text[to] == SPACE:
                    to += 1
                to = text.find(SPACE, to) if to < len(text) else to
                to = len(text) if to < 0 else to
                found.append(text[at:to])
                at = to
        for w in found:
            if w not in index:
                index[w] = len(words)
                words.append(w)
        parts.append((i, np.array([index[w] for w in found], np.int64)))
        sizes[i] = len(found)
    out = np.concatenate([[0], np.cumsum(sizes)])
    merged = np.empty(out[-1], np.int64)
    regular = np.repeat(~odd, np.diff(offsets))
    merged[np.repeat(~odd, sizes)] = codes[regular]
    for i, c in parts:
        merged[out[i] : out[i + 1]] = c
    return out, merged, pa.array(words, large)


def _are_neighbours(chars: np.ndarray, model: PieceModel) -> np.ndarray:
    """Whether each character and the next are neighbours in some piece."""
    codes, table = model.neighbour_table
    code = codes[np.minimum(chars, len(codes) - 1)]
    found = table[code[:-1], code[1:]]
    # the pairs of which the table knows one character at most
    rest = np.flatnonzero((code[:-1] == 0) | (code[1:] == 0))
    if len(rest):
        pair = chars[rest].astype(np.uint64) << np.uint64(21) | chars[rest + 1]
        at = np.minimum(np.searchsorted(model.neighbours, pair), max(0, len(model.neighbours) - 1))
        found[rest] = model.neighbours[at] == pair if len(model.neighbours) else False
    return found


def _parts(texts: pa.LargeStringArray, model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, first, part, distinct): the words of text i are codes[offsets[i] : offsets[i + 1]], the segments of word w are
    part[first[w] : first[w + 1]], codes of the distinct ones; spaces escaped."""
    offsets, codes, words = _tokens(texts, model.dummy_prefix)
    if words.offset or not len(words):
        words = pa.array(words.to_pylist(), pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
    if not ends[-1]:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), []
    joined = words.buffers()[2].slice(0, int(ends[-1]))
    raw = np.frombuffer(joined, np.uint8)
    heads = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # where characters begin
    chars = np.frombuffer(joined.to_pybytes().decode().encode("utf-32-le"), np.uint32)
    starts = np.searchsorted(heads, ends)
    cut = np.ones(len(chars) + 1, bool)
    cut[1:-1] = ~_are_neighbours(chars, model)
    cut[starts] = True
    edges = np.flatnonzero(cut)
    coded = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(heads[edges].astype(np.int64)), joined).dictionary_encode()
    part = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets, codes, np.searchsorted(edges, starts), part, coded.dictionary.to_pylist()


def segments(texts: pa.LargeStringArray, model: PieceModel) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, distinct) of the segments of each text, spaces escaped."""
    offsets, codes, first, part, distinct = _parts(texts, model)
    start, n = span(first, codes)
    return np.concatenate([[0], np.cumsum(n)])[offsets], gather(start, n, part), distinct


def segment_counts(texts: pa.LargeStringArray, model: PieceModel) -> tuple[list[str], np.ndarray]:
    """The distinct segments and how often each occurs, counted by distinct words."""
    _, codes, first, part, distinct = _parts(texts, model)
    words = np.bincount(codes, minlength=len(first) - 1)
    n = np.bincount(part, weights=np.repeat(words, np.diff(first)), minlength=len(distinct))
    return distinct, n.astype(np.int64)


# -- folding ------------------------------------------------------------------


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """``piece, rank``: as many rows as the model has pieces."""
    return spark.createDataFrame([(p, model.ranks[-float(model.scores[i])]) for p, i in model.usable.items()], "piece string, rank long")


def _slots(hashed: np.ndarray) -> np.ndarray:
    return hashed * MIX >> np.uint64(64 - FILTER_BITS)


def spans(segs: list[str], model: PieceModel, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, spans) of the substrings of each segment that may be pieces of ``least`` characters or more, as
    end << 8 | start, and at least the first one of ``least`` characters; with ``least`` 1 every character is among them.

    A start is left as soon as no piece begins like the characters from there."""
    n = np.array([len(x) for x in segs], np.int64)
    ends = np.cumsum(n)
    chars = np.frombuffer("".join(segs).encode("utf-32-le"), np.uint32)
    left = np.repeat(ends, n) - np.arange(len(chars))  # characters from here to the segment's end
    found = np.zeros((len(chars), min(model.longest, n.max(initial=1))), bool)
    at, hashed = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
    for size in range(1, found.shape[1] + 1):
        hashed = hashed * MIX + chars[at + size - 1]
        kind = model.hash_filter[_slots(hashed)]
        if size >= least:
            found[at, size - 1] = kind & IS_PIECE
        more = (kind & BEGINS != 0) & (left[at] > size)
        at, hashed = at[more], hashed[more]
    if least == 1:
        found[:, 0] = True
    elif found.shape[1] >= least:
        found[(ends - n)[n >= least], least - 1] = True
    at, size = np.nonzero(found)
    owner = np.repeat(np.arange(len(n)), n)[at]
    start = at - (ends - n)[owner]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
    return offsets, ((start + size + 1) << 8 | start).astype(np.int16)


def substrings(segs: DataFrame) -> DataFrame:
    """``seg, n, s, e, sub``: the substrings of each segment at its ``spans``."""
    at = segs.select("seg", "n", F.explode("spans").alias("x")).select("seg", "n", F.expr("x & 255").cast("int").alias("s"), F.expr("shiftright(x, 8)").alias("e"))
    return at.select("*", F.substring(F.col("seg"), F.col("s") + 1, F.col("e") - F.col("s")).alias("sub"))


SINGLE = 1 << 47  # above every rank << 16


def lattice(segs: DataFrame, pieces: DataFrame, model: PieceModel, paths: bool) -> DataFrame:
    """``seg, n, edges, merges``: the pieces found in each segment of ``segs(seg, n, spans)``, at most 48 characters long.

    Substrings of bounded length are exploded, joined to the piece table (which
    is broadcast: its size is fixed by the model) and grouped by segment.  merges are
    the pieces of two characters or more packed as rank << 16 | s << 8 | e, so that
    ascending order is that of a BPE model's merges: best score first, then
    leftmost.  edges, null unless ``paths``, are the pieces packed as
    e << 40 | s << 32 | rank, in order, with an edge for every character, marked by bit
    31: one without a piece has the last rank, that of an unknown one.  Numbers are
    grouped in half the time that structs take, and both lists come from one."""
    subs = substrings(segs)
    single = F.col("e") - F.col("s") == 1
    # the first substring of a segment stays without a piece too, so that no segment is lost
    hit = subs.join(F.broadcast(pieces), subs["sub"] == pieces["piece"], "left").where(F.col("rank").isNotNull() | (F.col("s") == 0) | single)
    rank = F.when(single, F.coalesce("rank", F.lit(model.ranks[model.costs[-1]]).cast("long"))).otherwise(F.col("rank"))
    packed = F.shiftleft(rank, 16) + F.col("s") * 256 + F.col("e") + F.when(single, F.lit(SINGLE)).otherwise(0)
    grouped = hit.groupBy("seg", "n").agg(F.sort_array(F.collect_list(packed)).alias("found"))
    none = F.lit(None).cast("array<bigint>")
    if paths:
        # there is one single character for each, and they come last
        edges = F.expr("sort_array(transform(found, x -> shiftleft(x & 255, 40) | shiftleft(x & 65280, 24) | (shiftright(x, 16) & 4294967295)))")
        return grouped.select("seg", "n", edges.alias("edges"), F.expr("slice(found, 1, size(found) - char_length(seg))").alias("merges"))
    grouped = grouped.select("seg", "n", none.alias("edges"), F.col("found").alias("merges"))
    return grouped.unionByName(segs.where("char_length(seg) = 1").select("seg", "n", none.alias("edges"), F.array().cast("array<bigint>").alias("merges")))


#: Symbol boundaries are a bit mask.  An edge applies if both its ends and exactly one
#: position between them are boundaries; then that position no longer is one.
_S, _E = "cast(shiftright(x, 8) & 255 as int)", "cast(x & 255 as int)"
_INNER = f"(shiftleft(1L, {_E}) - shiftleft(1L, {_S} + 1))"
_APPLIES = f"(shiftright(st, {_E}) & 1) = 1 and (shiftright(st, {_S}) & 1) = 1 and bit_count(st & {_INNER}) = 1"
_ALL = "shiftleft(1L, char_length(seg) + 1) - 1L"
#: For monotone models every edge is looked at once.
FOLD_BPE_ONCE = f"aggregate(merges, {_ALL}, (st, x) -> if({_APPLIES}, st & ~{_INNER}, st))"
#: For the others a pass applies the first edge that it can; the sign bit says that it has.
FOLD_BPE = f"""
aggregate(sequence(1, greatest(1, char_length(seg) - 1)), {_ALL}, (mask, i) ->
  aggregate(merges, mask, (st, x) ->
    if(st < 0, st, if({_APPLIES}, (st & ~{_INNER}) | (-9223372036854775807L - 1), st))) & 9223372036854775807L)
"""


def fold_viterbi(cost: str) -> str:
    """Edges come by their end, the single character last: then the best path to that end is known and
    kept, by position.  A path is its cost and its boundaries as a mask; ties go to the longer last piece.
    ``cost`` is that of edge x."""
    came = "st.done[shiftright(x, 32) & 255]"
    cost, mask = f"({came}.cost + {cost})", f"({came}.mask | shiftleft(1L, cast(shiftright(x, 40) as int)))"
    return f"""
aggregate(edges,
  struct(array(struct(0D AS cost, 0L AS mask)) AS done, double('infinity') AS cost, 0L AS mask),
  (st, x) -> if((x & {1 << 31}) = 0,
    if({cost} < st.cost, struct(st.done AS done, {cost} AS cost, {mask} AS mask), st),
    struct(concat(st.done, array(if({cost} < st.cost, struct({cost} AS cost, {mask} AS mask), struct(st.cost AS cost, st.mask AS mask)))) AS done,
           double('infinity') AS cost, 0L AS mask)),
  st -> element_at(st.done, -1))
"""


def fold(edges: DataFrame, model: PieceModel, paths: bool) -> DataFrame:
    """``seg, n, mask, best``: the boundaries of each segment's symbols, bit i before character i,
    and the best path by the sum of scores (cost, mask), null unless ``paths``."""
    rank = f"(x & {(1 << 31) - 1})"
    if paths and not model.whole:
        # one literal, which the planner reads once
        edges = edges.withColumn("costs", F.from_json(F.lit(json.dumps(model.costs)), "array<double>"))
    best = F.expr(fold_viterbi(rank if model.whole else f"costs[{rank}]")) if paths else F.lit(None).cast("struct<cost:double,mask:bigint>")
    if model.kind == BPE:
        return edges.select("seg", "n", F.expr(FOLD_BPE_ONCE if model.monotone else FOLD_BPE).alias("mask"), best.alias("best"))
    return edges.select("seg", "n", best.alias("best")).select("seg", "n", F.col("best.mask").bitwiseOR(F.lit(1)).alias("mask"), "best")


def symbol_ids(seg: str, bounds: list[int], model: PieceModel) -> list[int]:
    out: list[int] = []
    for s, e in zip(bounds, bounds[1:], strict=False):
        k = model.usable.get(seg[s:e])
        out += [k] if k is not None else [model.byte_ids[b] for b in seg[s:e].encode()] if model.byte_ids else [model.unk]
    return out


def unk_cost(model: PieceModel) -> float:
    """The library's penalty of an unknown character: the lowest score less 10, negated."""
    return 10.0 - min((model.scores[i] for i in model.usable.values()), default=0.0)


def best_path(seg: str, model: PieceModel) -> tuple[list[int], float]:
    """Boundaries and cost of the best path of a long segment, in n * longest steps."""
    usable, scores, n = model.usable, model.scores, len(seg)
    cost, came, unk = [0.0] + [float("inf")] * n, [0] * (n + 1), unk_cost(model)
    for e in range(1, n + 1):
        for s in range(max(0, e - model.longest), e):
            k = usable.get(seg[s:e])
            c = cost[s] + (-scores[k] if k is not None else unk if e == s + 1 else float("inf"))
            if c < cost[e]:
                cost[e], came[e] = c, s
    bounds = [n]
    while bounds[-1]:
        bounds.append(came[bounds[-1]])
    return bounds[::-1], cost[n]


def encode_long(seg: str, model: PieceModel) -> list[int]:
    """The ids of one long segment by the rules of the fold, in n log n steps (BPE) or n * longest."""
    usable, scores, n = model.usable, model.scores, len(seg)
    if model.kind == BPE:
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                e = after[j]
                k = usable.get(seg[i:e]) if e - i <= model.longest else None
                if k is not None:
                    heapq.heappush(heap, (-scores[k], i, j, e))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and after[j] == e):
                continue
            alive[j], after[i] = False, e
            if e < n:
                before[e] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        bounds = [i for i in range(n) if alive[i]] + [n]
    else:
        bounds = best_path(seg, model)[0]
    return symbol_ids(seg, bounds, model)


def encode_segments(docs: DataFrame, model: PieceModel, s: Settings = Settings(), paths: bool = False) -> DataFrame:
    """``seg, n, hi, lo, ids, cost, steps`` of the distinct segments of ``docs(text)``: n their
    number, hi and lo their hash; with ``paths`` cost and pieces of their best path."""
    paths = paths or model.kind == UNIGRAM
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text", COUNT_CHUNK):
            segs, n = segment_counts(texts, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.string()), pa.array(n)], names=["seg", "n"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, found = spans(batch.column("seg").to_pylist(), shared.value, 1 if paths else 2)
            cols = [batch.column("seg"), batch.column("n"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found))]
            yield pa.RecordBatch.from_arrays(cols, names=["seg", "n", "spans"])

    def finished(batch: pa.RecordBatch, ids: list, cost, steps) -> pa.RecordBatch:
        hi, lo = _hashes(batch.column("seg").to_pylist())
        cols = [batch.column("seg"), batch.column("n"), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(ids, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(cost, pa.float64()), pa.array(steps, pa.int32())], names=["seg", "n", "hi", "lo", "ids", "cost", "steps"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of the symbols between the folded boundaries."""
        for batch in batches:
            ids = []
            for seg, mask in zip(batch.column("seg").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                ids.append(symbol_ids(seg, [i for i in range(len(seg) + 1) if mask >> i & 1], shared.value))
            yield finished(batch, ids, batch.column("cost"), batch.column("steps"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segs = batch.column("seg").to_pylist()
            found = [best_path(x, shared.value) if paths else ([], None) for x in segs]
            yield finished(batch, [encode_long(x, shared.value) for x in segs], [c for _, c in found], [len(b) - 1 if b else None for b, _ in found])

    found = docs.select("text").mapInArrow(count, "seg string, n long").groupBy("seg").agg(F.sum("n").alias("n"))
    found = materialize(found)
    short = F.char_length("seg") <= s.lattice_chars
    # dealt by segment before the explosion, so that grouping its edges needs no exchange
    dealt = found.where(short).mapInArrow(candidates, "seg string, n long, spans array<smallint>").repartition(max(1, found.count() // TASK_SEGMENTS), "seg")
    folded = fold(lattice(dealt, piece_table(spark, model), model, paths), model, paths)
    folded = folded.select("seg", "n", "mask", F.col("best.cost").alias("cost"), F.bit_count("best.mask").cast("int").alias("steps"))
    ids = "seg string, n long, hi long, lo long, ids array<int>, cost double, steps int"
    return materialize(folded.mapInArrow(resolve, ids).unionByName(found.where(~short).mapInArrow(rest, ids)))


HASH = np.dtype([("hi", ">u8"), ("lo", ">u8")])


def _hashes(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each segment, in two halves."""
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in parts), HASH)
    return h["hi"].astype(np.uint64), h["lo"].astype(np.uint64)


def _packed(table: pa.Table) -> tuple:
    """Hashes (first halves ascending, then the second), offsets, ids, costs and steps: what workers look segments up in.

    Of segments that share a first half only one is held; the others are as good as not shared."""
    ids = table["ids"].combine_chunks()
    hi, order = np.unique(table["hi"].to_numpy().view(np.uint64), return_index=True)
    lo = table["lo"].to_numpy().view(np.uint64)[order]
    off, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    ends = np.zeros(len(order) + 1, np.int64)
    np.cumsum(np.diff(off)[order], out=ends[1:])
    # every worker holds these: as narrow as they can be
    flat = np.empty(ends[-1], np.uint16 if values.max(initial=0) < 1 << 16 else np.int32)
    for at in range(0, len(order), PACK_ROWS):
        rows = order[at : at + PACK_ROWS]
        start = off[rows].astype(np.int64)
        flat[ends[at] : ends[at + len(rows)]] = gather(start, off[rows + 1] - start, values)
    path = [None, None]
    if "cost" in table.schema.names:
        cost, steps = table["cost"].to_numpy()[order], table["steps"].to_numpy()[order]
        short = cost.astype(np.float32)
        path = [short if (short == cost).all() else cost, steps.astype(np.uint16 if steps.max(initial=0) < 1 << 16 else np.int32)]
    return hi, lo, ends.astype(np.uint32 if ends[-1] < 1 << 32 else np.int64), flat, *path


def _gathered(frequent: DataFrame, rows: int) -> tuple:
    """The packed table of ``frequent``, of about so many rows: gathered by ranges of hashes, so that
    the driver holds a part of it as Arrow data and narrow arrays of the rest."""
    bits = max(0, -(-rows // GATHER_ROWS) - 1).bit_length()
    parts = []
    for k in range(1 << bits):
        part = frequent.where(F.expr(f"shiftrightunsigned(hi, {64 - bits}) = {k}")) if bits else frequent
        parts.append(_packed(part.toArrow()))
        relax()
    if not bits:
        return parts[0]
    before = np.cumsum([0, *(len(p[3]) for p in parts)])
    ends = np.concatenate([p[2][:-1] + b for p, b in zip(parts, before, strict=False)] + [before[-1:]])
    rest = [None if p is None else np.concatenate([q[i] for q in parts]) for i, p in enumerate(parts[0]) if i != 2]
    return *rest[:2], ends.astype(np.uint32 if before[-1] < 1 << 32 else np.int64), *rest[2:]


MAGIC = b"quire packed arrays 1 "


def _blob(arrays: tuple) -> bytes:
    """The arrays (or None) one after the other, placed so that they are aligned in a broadcast's file."""
    before = pickle.dumps(MAGIC + bytes(1 << 17), pickle.HIGHEST_PROTOCOL).find(MAGIC)
    arrays = [a if a is None else np.ascontiguousarray(a) for a in arrays]
    at, plan = 1024 - before, []
    for a in arrays:
        plan.append(None if a is None else (a.dtype.str, len(a), at))
        at += 0 if a is None else -(-a.nbytes // 64) * 64
    head = MAGIC + repr(plan).encode()
    parts = [head.ljust(1024 - before)]
    for a in arrays:
        parts += [] if a is None else [a.data, bytes(-a.nbytes % 64)]
    return b"".join(parts)


def _arrays(data, at: int = 0) -> tuple:
    """The arrays of the blob that begins at ``at``; not copied where they are aligned."""
    plan = ast.literal_eval(bytes(data[at + len(MAGIC) : at + 960]).decode())
    return tuple(None if x is None else np.require(np.frombuffer(data, x[0], x[1], at + x[2]), requirements="A") for x in plan)


@functools.lru_cache(1)
def _mapped(path: str) -> tuple | None:
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    at = data.find(MAGIC, 0, 1024)
    return _arrays(data, at) if at >= 0 else None


def _held(broadcast) -> tuple:
    """The arrays of a broadcast blob.  The workers of an executor map the file that it has of it
    anyway, instead of holding a copy each; without such a file (an encrypted one) they hold copies."""
    path = getattr(broadcast, "_path", None)
    return path and os.path.isfile(path) and _mapped(path) or _arrays(broadcast.value)


def most_frequent(table: DataFrame, s: Settings) -> DataFrame:
    """The segments that occur 2**k times or more, for the least k at which they are within the bounds.

    The driver sees two sums for each power of two."""
    power = F.floor(F.log2("n")).cast("int")
    size = {k: (n, ids) for k, n, ids in table.groupBy(power).agg(F.count("*"), F.sum(F.size("ids"))).collect()}
    least, rows, ids = 64, 0, 0
    while least > 0:
        more = size.get(least - 1, (0, 0))
        rows, ids = rows + more[0], ids + more[1]
        if rows > s.shared_rows or ids > s.shared_ids:
            break
        least -= 1
    return table.where(power >= least)


def span(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of each row start, and how many there are."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = ends[rows].astype(np.int64)
    return start, ends[rows + 1].astype(np.int64) - start


def gather(starts: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + n[i]] for every i, joined."""
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each values[bounds[i] : bounds[i + 1]]."""
    upto = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=upto[1:])
    return np.diff(upto[bounds])


def _columns(doc_id, bounds: np.ndarray, ids: np.ndarray, model: PieceModel | None, path: tuple | None) -> pa.RecordBatch:
    """doc_id and ids; with a model also their number and a digest of the text decoded from them; with a path its pieces and cost."""
    values = pa.array(ids, pa.int32())
    out = {"doc_id": doc_id, "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)}
    if model is not None:
        digest = [hashlib.sha256(x).hexdigest() for x in decode_ids(bounds, values, model)]
        out = {"doc_id": doc_id, "n_tokens": pa.array(np.diff(bounds)), "ids": out["ids"], "decoded_sha256": pa.array(digest, pa.string())}
    if path is not None:
        out |= {"path_pieces": pa.array(path[1].astype(np.int64)), "path_cost": pa.array(path[0].astype(np.float64))}
    return pa.RecordBatch.from_pydict(out)


def encode(docs: DataFrame, model: PieceModel, s: Settings = Settings(), check: bool = False, paths: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs(doc_id, text)``; with ``check`` also
    ``n_tokens`` and ``decoded_sha256``, the digest of the text decoded from the ids;
    with ``paths`` also ``path_pieces`` and ``path_cost``: how many pieces the path of
    the best sum of scores has, found by Viterbi, and the sum, negated.

    The ids are the library's: of a unigram model those of the best path, of a BPE
    model those of its merges.

    * Null and empty texts: no ids.  Every repeated row is returned; a null
      doc_id as null.  Other columns are ignored; an empty table: empty.
    * Characters without a piece become byte pieces, or <unk> without them; a
      path pays the price of an unknown character for them.
    * The most frequent segments, as many as ``shared_rows`` and ``shared_ids``
      allow, are sent to the workers; occurrences of rarer ones are joined by
      segment and put into their places.
    * A very long text is one row of one task, as it is in the table; its
      segments are folded where all others are.
    """
    spark = docs.sparkSession
    table = encode_segments(docs, model, s, paths)
    known = table.count()
    packed = _gathered(most_frequent(table, s).select("hi", "lo", "ids", *["cost", "steps"] * paths), min(known, s.shared_rows))
    # a segment that shares half its hash with another is joined
    whole = len(packed[0]) == known
    relax()
    packed = _blob(packed)
    packed = spark.sparkContext.broadcast(packed)
    relax()
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", path_pieces long, path_cost double" if paths else ""
    schema = (f"doc_id {kind}, n_tokens long, ids array<int>, decoded_sha256 string" if check else f"doc_id {kind}, ids array<int>") + more

    def rows_of(segs):
        """The row of each segment in the table, -1 if it has none."""
        first, second, *_ = _held(packed)
        hi, lo = _hashes(segs)
        order = np.argsort(hi)  # ascending keys are looked up in near memory
        at = np.empty(len(hi), np.int64)
        at[order] = np.minimum(np.searchsorted(first, hi[order]), max(0, len(first) - 1))
        known = (first[at] == hi) & (second[at] == lo) if len(first) else np.zeros(len(hi), bool)
        return np.where(known, at, -1)

    def look_up(texts):
        _, _, ends, flat, cost, steps = _held(packed)
        offsets, codes, segs = segments(texts, shared.value)
        row = rows_of(segs)[codes]
        path = None
        if paths:
            # sums of each text as differences of a running sum; what is not shared counts nothing here
            path = []
            for x in (cost, steps):
                path.append(_sums(np.where(row >= 0, x[row], 0) if len(x) else np.zeros(len(row)), offsets))
        return offsets, codes, segs, row, ends, flat, path

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", ENCODE_CHUNK):
            _, _, ends, flat, cost, steps = _held(packed)
            offsets, codes, first, part, segs = _parts(texts, shared.value)
            row = rows_of(segs)[part]
            # the ids of each distinct word, then those of each text's words
            start, n = span(ends, row)
            word_ids, word_ends = gather(start, n, flat), np.concatenate([[0], np.cumsum(n)])[first]
            start, n = span(word_ends, codes)
            ids = gather(start, n, word_ids)
            bounds = np.concatenate([[0], np.cumsum(n)])[offsets]
            path = [_sums(_sums(x[row], first)[codes], offsets) for x in (cost, steps)] if paths else None
            yield _columns(batch.column("doc_id"), bounds, ids, shared.value if check else None, path)

    lean = docs.select("doc_id", "text")
    if whole:
        return lean.mapInArrow(direct, schema)

    def holed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments that are not shared leave -1 in ids and their text in holes."""
        for batch, texts in chunks(batches, "text"):
            offsets, codes, segs, row, ends, flat, path = look_up(texts)
            keep = row >= 0
            start, n = span(ends, np.where(keep, row, 0))
            n = np.where(keep, n, 1)
            out = np.concatenate([[0], np.cumsum(n)])
            ids = np.full(out[-1], -1, np.int32)
            ids[np.repeat(keep, n)] = gather(start[keep], n[keep], flat)
            missing = np.concatenate([[0], np.cumsum(~keep)])[offsets]
            holes = pa.array(segs, pa.string()).take(pa.array(codes[~keep]))
            cols = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(out[offsets], pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array(missing, pa.int32()), holes)]
            cols += [pa.array(x.astype(np.float64)) for x in path] if paths else []
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "holes", *["cost", "steps"] * paths])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, found = [], [x or [] for x in batch.column("parts").to_pylist()]
            for ids, parts in zip(batch.column("ids"), found, strict=True):
                a = ids.values.to_numpy()
                if parts:
                    at = np.flatnonzero(a < 0)
                    pieces = np.split(a, at)
                    a = np.concatenate([pieces[0], *[x for p, piece in zip(parts, pieces[1:], strict=True) for x in (np.array(p["ids"], np.int32), piece[1:])]])
                out.append(a)
            bounds = np.concatenate([[0], np.cumsum([len(a) for a in out])]).astype(np.int64)
            path = tuple(batch.column(c).to_numpy() + np.array([sum(p[c] for p in parts) for parts in found]) for c in ("cost", "steps")) if paths else None
            yield _columns(batch.column("doc_id"), bounds, np.concatenate(out), shared.value if check else None, path)

    # written, so that row numbers stay what they are
    sums = ", cost double, steps double" if paths else ""
    first = materialize(lean.mapInArrow(holed, f"doc_id {kind}, ids array<int>, holes array<string>{sums}").withColumn("row", F.monotonically_increasing_id()))
    holes = first.select("row", F.posexplode("holes").alias("k", "seg"))
    got = F.struct("k", F.col("got").alias("ids"), F.col("got_cost").alias("cost"), F.col("got_steps").alias("steps"))
    there = table.select("seg", F.col("ids").alias("got"), F.col("cost").alias("got_cost"), F.col("steps").alias("got_steps"))
    parts = holes.join(there, "seg").groupBy("row").agg(F.array_sort(F.collect_list(got)).alias("parts"))
    return first.join(parts, "row", "left").select("doc_id", "ids", "parts", *["cost", "steps"] * paths).mapInArrow(fill, schema)


def decode_ids(bounds: np.ndarray, ids: pa.Array, model: PieceModel) -> list[bytes]:
    """The bytes of every text; ids of text i are bounds[i] : bounds[i + 1]."""
    taken = model.surface.take(ids)
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8) if len(taken) else np.zeros(1, np.int64)
    data = memoryview(taken.buffers()[2]) if len(taken) and taken.buffers()[2] else b""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        raw = bytes(data[int(ends[a]) : int(ends[b])])
        out.append(raw[1:] if model.dummy_prefix and raw[:1] == b" " else raw)
    return out


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """``doc_id, text`` of every row of ``encoded(doc_id, ids)``.

    Null or empty ids give an empty text; bytes that are not UTF-8 are replaced
    as the library does; control pieces give nothing.  Decoding undoes encoding
    except for texts that hold U+2581, which the format cannot tell from a space.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, ids = list_parts(batch.column("ids"))
            texts = [x.decode("utf-8", "replace") for x in decode_ids(bounds, ids, shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def list_parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the flat values of a list column; null is empty."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64), lists.flatten()


def public_model(path: str | None = None) -> PieceModel:
    """The model at ``path``, else the public 32k piece model of this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return load(path)


def encode_and_check(docs: DataFrame, model: PieceModel, s: Settings = Settings(), paths: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every row, in one pass over the texts; with
    ``paths`` also the best path's ``path_pieces, path_cost``."""
    return encode(docs, model, s, check=True, paths=paths)


def op1_sentencepiece(spark, sf_dir, path: str | None = None):
    """Encode every text, decode the ids again and return both with a digest, and the best
    path that Viterbi finds in the same lattice."""
    from quire.llm.store import read_table

    return encode_and_check(read_table(spark, sf_dir, "documents"), public_model(path), paths=True)
