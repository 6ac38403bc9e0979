"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, lean, stored

#: Links up to which one task finds the components: at 32 bytes a link, some tens of MB. More go through rounds of joins, with the same result.
ONE_TASK = 500_000


def local_forest(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For n nodes with links (a, b): the place of each node's least id in its component."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = np.arange(n)
    a, b = rank[a], rank[b]
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return order[label][rank]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all links of a partition. Nodes are numbers, or structs of numbers, which are ordered field by field."""
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not held:
        return
    t = pa.concat_tables(held).combine_chunks()
    a, b = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (t.column("a"), t.column("b")))
    fields = a.type if pa.types.is_struct(a.type) else None
    ends = [np.stack([f.to_numpy(zero_copy_only=False) for f in (x.flatten() if fields else [x])], 1) for x in (a, b)]
    nodes, place = np.unique(np.concatenate(ends), axis=0, return_inverse=True)
    place = place.reshape(-1)
    root = local_forest(len(nodes), place[: t.num_rows], place[t.num_rows :], np.arange(len(nodes)))

    def column(rows: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(rows[:, k], f.type) for k, f in enumerate(fields)], fields=list(fields)) if fields else pa.array(rows[:, 0], a.type)

    yield pa.RecordBatch.from_arrays([column(nodes), column(nodes[root])], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the least node reachable, for every node in ``edges`` (a, b).

    Up to ``one_task`` links are united in one task. Otherwise, each round takes the least label among a node's neighbours, and sends it to the node that the old label names as well, so that whole trees are hooked onto others (minima, which are combined before the shuffle, so that a node with very many links is no burden); then the label's own label, so that long chains shrink by half. The rounds grow with the logarithm of a chain's length. Labels are written out between rounds. Ends when nothing changes, and not before.
    """
    links = stored(edges.select("a", "b"), "links")
    if links.count() <= one_task:
        kind = links.schema["a"].dataType.simpleString()
        found = stored(links.coalesce(1).mapInArrow(lean(_united), f"node {kind}, component {kind}"), "labels")
        drop_stored(links)
        return found
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    drop_stored(links)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        seen = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near"))
        hooks = seen.where("near < label").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        least = seen.join(hooks, "node", "left").select("node", "label", F.least("near", F.coalesce("hook", "near")).alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("further"))
        after = stored(least.join(jump, "now", "left").select("node", F.least("now", F.coalesce("further", "now")).alias("label"), (F.least("now", F.coalesce("further", "now")) != F.col("label")).alias("moved")), "labels")
        moved = after.where("moved").limit(1).count()
        drop_stored(labels)
        labels = after.select("node", "label")
        if not moved:
            break
    drop_stored(both)
    return labels.select("node", F.col("label").alias("component"))
