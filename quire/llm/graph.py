"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import materialize


#: Links that one task contracts, and tasks at least.
TASK_LINKS, TASKS = 200_000, 8


def contract(links: DataFrame) -> DataFrame:
    """``u, v`` with the same components in at most one link per node and task.

    Every task replaces its share of the links, of bounded number, by stars: a
    group whose members were found together again and again shrinks to its size."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        n = t.num_rows
        coded = pa.chunked_array([*t["u"].chunks, *t["v"].chunks]).combine_chunks().dictionary_encode()
        ends, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        label = local_components(ends[:n], ends[n:], len(keys))
        at = np.flatnonzero(label != np.arange(len(keys)))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), keys.take(pa.array(label[at]))], names=["u", "v"])

    links = materialize(links.select("u", "v").where("u <> v"))
    tasks = max(TASKS, links.count() // TASK_LINKS)
    return links.repartition(tasks).mapInArrow(run, f"u {kind}, v {kind}")


def local_components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        # a root takes the least label that a link of its members offers
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """``u, label`` for every node of ``links(u, v)``; label is the component's least node.

    Each round a node takes the least label among itself and its neighbours, then
    the label of its label, so that chains halve; rounds stop when no label
    moves.  A round is two grouped minima with map-side combination and joins
    between written tables, which adaptive execution can split at a hub.
    """
    stars = materialize(contract(links))
    both = materialize(stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")))
    while True:
        named = labels.select(F.col("u").alias("v"), F.col("label").alias("far"))
        near = materialize(both.join(named, "v").groupBy("u").agg(F.min("far").alias("far")))
        moved = materialize(labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "far").alias("label")))
        jump = moved.select(F.col("u").alias("k"), F.col("label").alias("next"))
        after = materialize(
            moved.join(jump, moved["label"] == jump["k"]).select("u", "old", F.least("label", "next").alias("label"))
        )
        labels = after.select("u", "label")
        if not after.where("label <> old").limit(1).count():
            return labels
