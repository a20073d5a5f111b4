"""N-gram Jaccard join by chosen paths (after CPSJOIN).

Every text is the set of its five-word shingles, and a set of min-hash tokens
stands for it (their overlap estimates the Jaccard similarity).  Each run splits
all sets on sampled shared tokens: at the root a set goes to the children of the
tokens that a hash of the path selects.  Small buckets are compared pairwise on
sketches; large ones are split again, by the value of one token whose place the
path decides, so every set goes on to one child.  What is still large at the last
level is compared with pivots, and whoever is unlike their main group with
everyone, in blocks: every pair that meets there is linked if it is alike.

What the buckets find are candidate groups.  Inside a group every pair is then
verified on the exact shingle sets, in pairs of bounded blocks, which counts
links without writing them.  Copies of one word sequence count as one text, so a
group of a million copies is a single set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import components, local_components
from quire.llm.store import materialize
from quire.llm.textops import MIX, chunks, hash_words, mix, ngram_hashes, split_words


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    tokens: int = 64  # min-hash tokens of a set
    runs: int = 24  # a pair at the threshold is missed with less than 1e-4 at any level (see `recall`)
    first: float = 2.0  # expected tokens that a set selects at the root of a run; one at deeper levels
    bucket: int = 200  # sets that are compared pairwise; larger buckets are split again
    depth: int = 5  # levels
    brief: int = 192  # tokens by whose low bytes sets are compared
    slack: float = 0.14  # sketches err: nearly five standard deviations of 192 tokens at 0.8
    pivots: int = 64  # expected pivots of a bucket that is large at the last level
    block_keys: int = 1024  # sets in a block that is compared on sketches
    block_rows: int = 256  # sets in a block of the exact check
    block_tokens: int = 1 << 18  # shingles in a block, so long texts make smaller blocks


def recall(s: Settings, level: int | None = None) -> float:
    """Chance that a pair at the threshold becomes a candidate if all its buckets above
    ``level`` (the last one by default) stay large, the sketch filter included.

    A pair that is together in a bucket is compared there, also at the last level."""

    def tail(n: int, least: int):
        for same in range(least, n + 1):
            yield same, math.comb(n, same) * s.similarity**same * (1 - s.similarity) ** (n - same)

    met = 0.0
    for same, p in tail(s.tokens, 0):
        kept = (same / s.tokens) ** ((level or s.depth) - 1)
        met += p * (1 - (1 - s.first / s.tokens * kept) ** (same * s.runs))
    return met * sum(p for _, p in tail(s.brief, math.ceil((s.similarity - s.slack) * s.brief)))


def shingles(texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner, word hashes, word offsets); texts under n words have one shingle, empty ones none."""
    texts = pa.compute.utf8_lower(texts)
    offsets, codes, words = split_words(texts)
    w = hash_words(words)[codes]
    h, owner = ngram_hashes(w, offsets, n)
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(w[offsets[i] : offsets[i + 1]].tobytes()) for i in short], np.uint64)
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner, w, offsets


def sketch(h: np.ndarray, owner: np.ndarray, n: int, tokens: int, brief: int) -> tuple[np.ndarray, np.ndarray]:
    """n x tokens min-hashes of 32 bits, and the low bytes of n x brief ones; rows of empty sets are zero.

    A product of 64 bits gives two min-hashes: the path tokens are upper halves."""
    long, short = np.zeros((n, tokens), np.uint32), np.zeros((n, brief), np.uint8)
    if len(h):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows = owner[starts]
        products = max(tokens, (brief + 1) // 2)
        seeds = mix(np.arange(1, products + 1, dtype=np.uint64) * MIX) | np.uint64(1)
        for j in range(products):
            x = h * seeds[j]
            upper = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
            if j < tokens:
                long[rows, j] = upper
            if 2 * j < brief:
                short[rows, 2 * j] = upper.astype(np.uint8)
            if 2 * j + 1 < brief:
                short[rows, 2 * j + 1] = np.minimum.reduceat(x.astype(np.uint32), starts).astype(np.uint8)
    return long, short


def row_hash(text):
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, th, key, n, sketch, brief``: key names the word sequence, n counts its shingles."""
    words, tokens, brief = s.words, s.tokens, s.brief

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            h, owner, w, offsets = shingles(texts, words)
            long, short = sketch(h, owner, len(texts), tokens, brief)
            keys = [xxhash.xxh3_128_digest(w[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            n = np.bincount(owner, minlength=len(texts))
            cols = [pa.array(keys, pa.binary()), pa.array(n), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in (long, short)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *cols], names=["doc_id", "th", "key", "n", "sketch", "brief"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_hash(F.col("text")).alias("th")).mapInArrow(run, f"doc_id {kind}, th long, key binary, n long, sketch binary, brief binary")


def split(sets: DataFrame, expected: float | None, tokens: int) -> DataFrame:
    """``path, key`` of the children: each set follows ``expected`` of its tokens on average,
    or, if that is None, the one token whose place the path decides.

    sets: path, key, sketch.  The hash of (path, token) decides, so two sets of a
    bucket select the same of the tokens that they share."""
    least = np.uint64(int(min(1.0, (expected or 0) / tokens) * (2**64 - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mix(np.arange(1, tokens + 1, dtype=np.uint64) * MIX)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                values = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(-1, tokens).astype(np.uint64)
                path = part.column("path").to_numpy().astype(np.uint64)
                token = mix(values + place)
                child = mix(token + mix(path)[:, None])
                if expected is None:
                    row, col = np.arange(len(path)), (mix(path + MIX) % np.uint64(tokens)).astype(np.int64)
                else:
                    row, col = np.nonzero(mix(child + MIX) <= least)
                keys = part.column("key").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(child[row, col].view(np.int64)), keys], names=["path", "key"])

    return sets.select("path", "key", "sketch").mapInArrow(run, "path long, key binary")


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``names`` in sorted batches, each as one table.

    Only groups of bounded size may be read this way; one group is held at a time."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for c in names:
            x = t[c].combine_chunks()
            x = x.dictionary_encode().indices if pa.types.is_binary(x.type) else x
            x = x.to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change)])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield t.slice(a, b - a)
        rest = t.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def local_labels(linked: np.ndarray) -> np.ndarray:
    """The least index in the component of each row of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    if n > 1:
        reach = linked | np.eye(n, dtype=bool)
        while True:
            new = np.where(reach, label[None, :], n).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return label


def alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y share ``least`` of their bytes."""
    out = np.empty((len(x), len(y)), bool)
    for i in range(len(x)):
        out[i] = (y == x[i]).sum(axis=1) >= least * x.shape[1]
    return out


def briefs(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["brief"].to_pylist()), np.uint8).reshape(t.num_rows, -1)


def star(keys: list, label: np.ndarray) -> pa.RecordBatch:
    """``u, v``: everyone whose label is another, with the one that it names."""
    at = np.flatnonzero(label != np.arange(len(keys)))
    return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in x], pa.binary()) for x in (at, label[at])], names=["u", "v"])


def compare_buckets(leaves: DataFrame, s: Settings) -> DataFrame:
    """``u, v`` star links of the sets of each small bucket whose sketches are alike.

    leaves: path, key, brief."""
    least = s.similarity - s.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["path"]):
            x = briefs(t)
            yield star(t["key"].to_pylist(), local_labels(alike(x, x, least)))

    return leaves.repartition("path").sortWithinPartitions("path").mapInArrow(run, "u binary, v binary")


def compare_large(large: DataFrame, s: Settings) -> DataFrame:
    """``u, v`` links that join all alike sets of each bucket that is large at the last level.

    large: path, size, key, brief.  Every set is compared with the pivots of its
    bucket, picked by a hash; those like a pivot of the main group (pivots linked
    with each other, the most of them) are linked to it.  Sets outside the main
    group are then compared with all sets of the bucket, so no pair is left out.
    Buckets are dealt in blocks; pivots and outsiders are copied to each of them."""
    least, rows = s.similarity - s.slack, s.block_keys

    def dealt(parts):
        return F.pmod(F.xxhash64("key", "path"), parts).cast("int")

    def every(parts):
        return F.explode(F.sequence(F.lit(0), parts - 1))

    def main_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["path", "block"]):
            t = t.sort_by("key")
            pivot, x, keys = t["pivot"].to_numpy(), briefs(t), np.array(t["key"].to_pylist(), object)
            at, rest = np.flatnonzero(pivot), np.flatnonzero(~pivot)
            head = np.zeros(0, int)
            if len(at):
                label = local_labels(alike(x[at], x[at], least))
                head = at[label == np.bincount(label).argmax()]
            with_head = alike(x[rest], x[head], least).any(axis=1)
            # pivots are in every block; the first one speaks for them
            mine = rest if t["block"][0].as_py() else np.concatenate([at, rest])
            inside = np.zeros(len(x), bool)
            inside[head], inside[rest[with_head]] = True, True
            to = pa.array([keys[head[0]] if inside[i] else None for i in mine], pa.binary())
            yield pa.RecordBatch.from_arrays([t["path"].combine_chunks().take(pa.array(mine)), pa.array(keys[mine].tolist(), pa.binary()), to], names=["path", "key", "head"])

    parts = F.ceil(F.col("size") / rows).cast("int")
    chance = F.lit(float(s.pivots)) / F.col("size")
    pivot = F.pmod(F.xxhash64("path", "key"), F.lit(1 << 30)) < chance * (1 << 30)
    flagged = large.select("path", "size", "key", "brief", pivot.alias("pivot"))
    shown = flagged.where("pivot").select("path", every(parts).alias("block"), "pivot", "key", "brief")
    shown = shown.unionAll(flagged.where("not pivot").select("path", dealt(parts).alias("block"), "pivot", "key", "brief"))
    keys = ["path", "block"]
    named = materialize(shown.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(main_group, "path long, key binary, head binary"))
    outside = materialize(named.where("head is null").select("path", "key"))
    linked = named.where("head is not null and head <> key").select(F.col("key").alias("u"), F.col("head").alias("v"))
    if not outside.limit(1).count():
        return linked
    n = materialize(outside.groupBy("path").agg(F.ceil(F.count("*") / rows).cast("int").alias("outsiders")))
    there = large.join(n, "path")
    asking = there.join(outside, ["path", "key"]).select("path", dealt(F.col("outsiders")).alias("i"), every(parts).alias("j"), F.lit(True).alias("asks"), "key", "brief")
    shown = there.select("path", every(F.col("outsiders")).alias("i"), dealt(parts).alias("j"), F.lit(False).alias("asks"), "key", "brief").unionAll(
        asking.select("path", "i", "j", "asks", "key", "brief")
    )

    def outsiders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["path", "i", "j"]):
            asks, x, names = t["asks"].to_numpy(), briefs(t), t["key"].to_pylist()
            a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
            u, v = np.nonzero(alike(x[a], x[b], least))
            n = len(a)
            # links of both sides as stars, so that a block gives at most one per set
            label = local_components(u, v + n, n + len(b))
            yield star([names[k] for k in np.concatenate([a, b])], label)

    keys = ["path", "i", "j"]
    found = shown.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(outsiders, "u binary, v binary")
    return linked.unionAll(found.where("u <> v"))


def candidate_links(sets: DataFrame, s: Settings) -> DataFrame:
    """``u, v`` links that span every group of likely similar sets; sets: key, sketch, brief."""
    tokens = s.tokens
    roots = sets.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(s.runs).cast("long"))).alias("path"), "key", "sketch")
    state = materialize(split(roots, s.first, tokens))
    leaves, out = [], None
    for level in range(1, s.depth + 1):
        sizes = materialize(state.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"))
        here = materialize(state.join(sizes, "path"))
        leaves.append(here.where(F.col("size") <= s.bucket).select("path", "key"))
        large = here.where(F.col("size") > s.bucket)
        if not large.limit(1).count():
            break
        if level == s.depth:
            out = compare_large(materialize(large.join(sets.select("key", "brief"), "key").select("path", "size", "key", "brief")), s)
        else:
            state = materialize(split(large.select("path", "key").join(sets.select("key", "sketch"), "key"), None, tokens))
    every = leaves[0]
    for x in leaves[1:]:
        every = every.unionAll(x)
    # a bucket that lost members to other levels does not occur: sizes are per path
    small = compare_buckets(every.join(sets.select("key", "brief"), "key").select("path", "key", "brief"), s)
    return small if out is None else small.unionAll(out)


def verify(members: DataFrame, s: Settings) -> DataFrame:
    """``key, label, links`` rows from the exact sets of each candidate group.

    members: comp, key, set (ascending 64-bit shingles as bytes).  Groups are cut
    into blocks by a hash of the key; a task compares one pair of blocks.  links
    counts the similar sets in the other block, label is the least similar key
    reached there."""
    sized = members.withColumn("n", F.length("set") / 8)
    blocks = materialize(
        members.select("comp", F.length("set").alias("b")).groupBy("comp")
        .agg(F.greatest(F.ceil(F.count("*") / s.block_rows), F.ceil(F.sum("b") / (8 * s.block_tokens))).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = (
        sized.drop("n").join(blocks, "comp").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "set")
    )
    num, den = int(round(s.similarity * 1000)), 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["comp", "i", "j"]):
            if t.num_rows < 2:
                continue
            keys, mine = t["key"].to_pylist(), t["mine"].to_numpy()
            linked = similar([np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()], num, den)
            if t["i"][0].as_py() != t["j"][0].as_py():
                linked &= mine[:, None] != mine[None, :]
            n = linked.sum(axis=1)
            label = local_labels(linked)
            at = np.flatnonzero(n)
            if len(at):
                cols = [pa.array([keys[i] for i in at], pa.binary()), pa.array([keys[i] for i in label[at]], pa.binary()), pa.array(n[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "label", "links"])

    keys = ["comp", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "key binary, label binary, links long")


def similar(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs of different sets have |a & b| / |a | b| >= num / den."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    shared = token[count > 1]
    common = np.zeros((n, n), np.float64)
    at = [np.searchsorted(shared, x) for x in sets]
    at = [a[(a < len(shared)) & (shared[np.minimum(a, len(shared) - 1)] == x)] if len(shared) else a[:0] for a, x in zip(at, sets, strict=True)]
    for low in range(0, len(shared), 4096):
        dense = np.zeros((n, min(4096, len(shared) - low)), np.float32)
        for i, a in enumerate(at):
            dense[i, a[np.searchsorted(a, low) : np.searchsorted(a, low + 4096)] - low] = 1
        common += dense @ dense.T
    union = size[:, None] + size[None, :] - common
    linked = (common * den >= union * num) & (common > 0)
    np.fill_diagonal(linked, False)
    return linked


def join_similar(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, class_id, copy_of, n_copies, n_links`` of every row of ``docs(doc_id, text)``.

    class_id: the least doc_id among the texts connected by links; copy_of: the
    least among rows with the same words; n_copies: rows with the same words;
    n_links: other word sequences at the similarity or above.

    * Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased; texts of fewer than five
      words are one shingle.  Null and empty texts are copies of each other and
      have no links.
    * Every repeated row is returned.  A null doc_id is returned as null and is
      never the least unless all of its class are null.  Rows that share an id
      but not a text are decided each by its text.
    * A very long text is one set: a task holds its shingles, and a block of
      the check no more than ``block_tokens`` beside it.
    * Other columns are ignored; an empty table gives an empty one.
    """
    lean = docs.select("doc_id", "text", row_hash(F.col("text")).alias("th"))
    sig = materialize(signatures(docs, s))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "th")).alias("one")
    texts = materialize(sig.groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), one))
    sets = materialize(sig.where("n > 0").select("key", "sketch", "brief").dropDuplicates(["key"]))
    groups = components(candidate_links(sets, s)).select(F.col("u").alias("key"), F.col("label").alias("comp"))
    # one row of each candidate text has its shingles taken again, exactly
    asked = texts.join(groups, "key").select(F.col("one.doc_id").alias("id"), F.col("one.th").alias("of"), F.col("key").alias("want"), "comp")
    words = s.words

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in chunks(batches, "text"):
            h, owner, w, offsets = shingles(part, words)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            keys = [xxhash.xxh3_128_digest(w[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            # rows that share an id and a hash could hold other texts
            ok = [i for i, (k, x) in enumerate(zip(keys, batch.column("want").to_pylist(), strict=True)) if k == x]
            rows = [np.unique(h[ends[i] : ends[i + 1]]).tobytes() for i in ok]
            cols = [batch.column("comp").take(pa.array(ok, pa.int64())), batch.column("want").take(pa.array(ok, pa.int64())), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["comp", "key", "set"])

    fetched = lean.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("of"))).select("comp", "want", "text")
    members = materialize(fetched.mapInArrow(exact, "comp binary, key binary, set binary").dropDuplicates(["key"]))
    checked = materialize(verify(members, s))
    named = components(checked.select(F.col("key").alias("u"), F.col("label").alias("v")).where("u <> v"))
    links = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    info = texts.drop("one").join(links, "key", "left").join(named.withColumnRenamed("u", "key"), "key", "left").withColumn("class", F.coalesce("label", "key"))
    info = materialize(info.select("key", "class", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    heads = materialize(info.groupBy("class").agg(F.min("copy_of").alias("class_id")))
    info = materialize(info.join(heads, "class").select("key", "class_id", "copy_of", "n_copies", "n_links"))
    return sig.select("doc_id", "key").join(info, "key").select("doc_id", "class_id", "copy_of", "n_copies", "n_links")


def op10_jaccard_join(spark, sf_dir):
    from quire.llm.store import read_table

    return join_similar(read_table(spark, sf_dir, "documents"))
