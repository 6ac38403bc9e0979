"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) come from a bounded sample. A vector is described by its permutation: its ``NEAREST`` pivots, nearest first. The inverted lists are kept by two pivots, so that a list holds vectors that share both; a vector enters the lists of those pairs whose places in its permutation add up to ``REACH`` at most, so that the nearest pivots count most. Vectors that share a list are candidates, and each pair is looked at in the least list that it shares. Every vector is indexed; lists longer than ``block`` are cut into blocks whose pairs are compared in tasks of their own, so none is capped.

Lists carry a vector as whole numbers of 8 bits with the length of its rounding error, which bounds the cosine of two vectors from above: pairs below the threshold fall away for certain. Only vectors that have a possible partner are then sent as they are, and verified in double precision.

Equal vectors are one class; classes are compared, members take their class's links. Links inside a list are counted and reduced to a spanning forest there; pairs are never sent. Components run over classes, never over ids.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own component; so do vectors of different lengths with each other. Null ids take part and come out with null as the id; a component of null ids alone has a null component, and all its rows count as kept. Rows that share an id with different vectors are told apart. Repeated rows are vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dealt, drop_stored, lean, lots, release_shuffles, stored
from .graph import components, local_forest

#: Pivots, and the vectors they are chosen from: numbers that don't depend on the data. No two pivots have a cosine of APART or more.
PIVOTS, SAMPLE, APART = 512, 4096, 0.5
NEAREST, REACH = 8, 6
BLOCK = 1000
#: Groups up to this many rows are compared together, by shifts of whole columns.
SMALL = 48
NO_ID = 2**63 - 1


def unit(rows: list[list[float]], width: int | None = None) -> np.ndarray:
    """Rows as unit vectors in double precision, cut or filled with zeros to ``width``. Scaled by their greatest component first, so that no square overflows or vanishes."""
    width = width or max(map(len, rows), default=1)
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        x[k, : min(width, len(r))] = r[:width]
    top = np.abs(x).max(1, keepdims=True) if x.size else np.ones((len(rows), 1))
    x /= np.where(top > 0, top, 1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit numbers, scale, length of the error) of unit vectors."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    error = np.linalg.norm(x - q * scale.astype(np.float32).astype(np.float64)[:, None], axis=1)
    return q, scale.astype(np.float32), (error * 1.0001 + 1e-6).astype(np.float32)


def nearest(x: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` nearest pivots of each unit vector, nearest first."""
    s = x @ pivots.T
    count = min(count, len(pivots))
    top = np.argpartition(-s, count - 1, axis=1)[:, :count]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def fit(classes: DataFrame, count: int = PIVOTS, sample: int = SAMPLE, apart: float = APART) -> np.ndarray:
    """At most ``count`` pivots out of the first ``sample`` classes by a hash: one after the other, if its cosine to those before is below ``apart``. So a large group of near copies doesn't bring many pivots that its members would have to choose among."""
    rows = classes.select("h1", "v").orderBy(F.xxhash64("h1"), "h1").limit(sample).select("v").collect()
    if not rows:
        return np.zeros((0, 1))
    x = unit([r["v"] for r in rows])
    chosen = np.zeros((count, x.shape[1]))
    n = 0
    for v in x:
        if n < count and (not n or (chosen[:n] @ v).max() < apart):
            chosen[n] = v
            n += 1
    return chosen[:n]


def list_keys(near: np.ndarray, pivots: int, reach: int) -> np.ndarray:
    """The lists of each permutation, in ascending order."""
    m = near.shape[1]
    if m < 2:
        return np.zeros((len(near), 1), np.int64)  # with fewer than two pivots all vectors are in one list
    pairs = [(a, b) for a in range(m) for b in range(a + 1, m) if a + b <= reach]
    keys = [np.minimum(near[:, a], near[:, b]).astype(np.int64) * pivots + np.maximum(near[:, a], near[:, b]) for a, b in pairs]
    return np.sort(np.stack(keys, 1), axis=1)


def own_pairs(lists: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of rows have ``key`` as the least list that they share."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 50_000):
        some = slice(at, at + 50_000)
        x, y, k = lists[a[some]], lists[b[some]], key[a[some]]
        # No smaller list in common: lists are in order, so only those before ``key`` count.
        lower = np.where(x < k[:, None], x, -1)
        out[some] = ~((lower[:, :, None] == y[:, None, :]) & (lower[:, :, None] >= 0)).any((1, 2))
    return out


def close_pairs(starts: np.ndarray, i: np.ndarray, j: np.ndarray, side: np.ndarray, x: np.ndarray, error: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (groups begin at ``starts``) whose cosine may reach ``least``: x[a] @ x[b] plus what the errors may add. A group of two blocks pairs rows of different sides only."""
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = np.flatnonzero(sizes[group] <= SMALL)
    g, two = group[small], (i != j)[small]
    for shift in range(1, SMALL):
        if shift >= len(small):
            break
        together = g[shift:] == g[:-shift]
        if not together.any():
            break
        at = np.flatnonzero(together & ~(two[shift:] & (side[small[shift:]] == side[small[:-shift]])))
        for k in range(0, len(at), 50_000):
            a, b = small[at[k : k + 50_000]], small[at[k : k + 50_000] + shift]
            e, f = error[a], error[b]
            hit = np.einsum("ij,ij->i", x[a], x[b]) + e + f + e * f >= least
            if hit.any():
                yield a[hit], b[hit]
    for n in np.flatnonzero(sizes > SMALL):
        rows = np.arange(starts[n], starts[n + 1])
        same = i[rows[0]] == j[rows[0]]
        left, right = rows[side[rows] == 0], rows if same else rows[side[rows] == 1]
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            bound = x[some] @ x[right].T + error[some][:, None] + error[right][None, :] + error[some][:, None] * error[right][None, :]
            a, b = np.nonzero(bound >= least)
            a, b = some[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield a, b


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, pivots: int = PIVOTS, nearest_pivots: int = NEAREST, block: int = BLOCK, reach: int = REACH) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = df.sparkSession
    bounded_batches(spark, 4096)
    kind = df.schema[vec_col].dataType.simpleString()
    vector = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")
    own = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = own.withColumn("ok", sound).withColumn("h1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")))
    # Equal vectors: 128 bits of hash.
    classes = stored(marked.where("ok").groupBy("h1", "h2").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")), "classes")
    points = fit(classes, pivots)
    count, m = len(points), min(nearest_pivots, len(points))
    width = points.shape[1]
    shared = spark.sparkContext.broadcast(points)  # at most ``pivots`` vectors

    # What lists carry: permutation, 8-bit numbers, scale, error, vector length.
    def packed(near: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        q, scale, error = rounded(x)
        return [a.tobytes() + s.tobytes() + e.tobytes() + z.tobytes() + b[:z].tobytes() for a, s, e, z, b in zip(near.astype("<i2"), scale, error, sizes.astype("<i4"), q)]

    def unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lists, numbers, error, vector length)."""
        head = np.frombuffer(b"".join(d[: 2 * m + 12] for d in data), np.dtype([("near", "<i2", (m,)), ("scale", "<f4"), ("error", "<f4"), ("size", "<i4")]))
        top = int(head["size"].max())
        if (head["size"] == top).all():
            q = np.frombuffer(b"".join(d[2 * m + 12 :] for d in data), np.int8).reshape(len(data), top)
        else:
            q = np.zeros((len(data), top), np.int8)
            for k, d in enumerate(data):
                q[k, : head["size"][k]] = np.frombuffer(d, np.int8, head["size"][k], 2 * m + 12)
        return list_keys(head["near"], max(count, 2), reach), q.astype(np.float32) * head["scale"][:, None], head["error"] + np.float32(1e-5), head["size"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(2).to_pylist()
            sizes = np.array([len(r) for r in rows])
            near = nearest(unit(rows, width), shared.value, m)
            keys = list_keys(near, max(count, 2), reach)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed(near, unit(rows), sizes), pa.binary()), lists], names=["h1", "h2", "d", "keys"])

    described = stored(classes.select("h1", "h2", "v").mapInArrow(index, "h1 long, h2 long, d binary, keys array<long>"), "pivots")
    listed = described.select(F.explode("keys").alias("key"), "h1", "h2", "d")
    # There are at most pivots * (pivots - 1) / 2 lists, whatever the number of vectors.
    grouped = dealt(listed, "key", "h1", block, bounded=True).select("key", "i", "j", "side", "h1", "h2", "d").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(starts: np.ndarray, t: pa.Table, x: np.ndarray, error: np.ndarray, lists: np.ndarray, sizes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, i, j, side = (t.column(c).to_numpy() for c in ("key", "i", "j", "side"))
        for a, b in close_pairs(starts, i, j, side, x, error, least):
            fits = (sizes[a] == sizes[b]) & own_pairs(lists, key, a, b)
            if fits.any():
                yield a[fits], b[fits]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, t in lots(batches, 3, 4096):
            lists, x, error, sizes = unpacked(t.column("d").to_pylist())
            hit = np.zeros(t.num_rows, bool)
            for a, b in pairs(starts, t, x, error, lists, sizes, least):
                hit[a] = hit[b] = True
            if hit.any():
                some = t.take(pa.array(np.flatnonzero(hit)))
                near = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * lists.shape[1]), pa.array(lists[hit].reshape(-1)))
                yield from some.select(["key", "i", "j", "side", "h1", "h2"]).append_column("lists", near).combine_chunks().to_batches()

    asked = stored(grouped.mapInArrow(lean(probe), "key long, i int, j int, side int, h1 long, h2 long, lists array<long>"), "asked")
    drop_stored(described)
    release_shuffles(spark)
    full = asked.join(classes.select("h1", "h2", "mult", "v"), ["h1", "h2"]).select("key", "i", "j", "side", "h1", "h2", "mult", "lists", "v").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "h1", "h2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, t in lots(batches, 3, 4096):
            h1, h2, mult = (t.column(c).to_numpy() for c in ("h1", "h2", "mult"))
            rows = t.column("v").to_pylist()
            x, sizes = unit(rows), np.array([len(r) for r in rows])
            lists = np.array(t.column("lists").to_pylist(), np.int64)
            links, aa, bb = np.zeros(t.num_rows, np.int64), [], []
            for a, b in pairs(starts, t, x, np.zeros(t.num_rows), lists, sizes, least):
                np.add.at(links, a, mult[b])
                np.add.at(links, b, mult[a])
                aa.append(a)
                bb.append(b)
            some = np.flatnonzero(links > 0)
            if len(some):
                root = local_forest(t.num_rows, np.concatenate(aa), np.concatenate(bb), np.lexsort((h2, h1)).argsort())
                cols = (h1[some], h2[some], links[some], h1[root[some]], h2[root[some]])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h1", "h2", "links", "r1", "r2"])

    found = stored(full.mapInArrow(lean(verify), "h1 long, h2 long, links long, r1 long, r2 long"), "found")
    drop_stored(asked)
    release_shuffles(spark)
    counted = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    # A class is known by its least id and its hash: the least node of a component has the component's least id.
    names = classes.select("h1", "h2", F.struct("rep", "h1", "h2").alias("node"))
    edges = found.where("h1 <> r1 or h2 <> r2").select("h1", "h2", "r1", "r2").distinct().join(names.withColumnRenamed("node", "a"), ["h1", "h2"]).join(names.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("node").alias("b")), ["r1", "r2"]).select("a", "b")
    joined = components(edges).select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), F.col("component.rep").alias("c"))
    per_class = classes.select("h1", "h2", "rep", "mult").join(counted, ["h1", "h2"], "left").join(joined, ["h1", "h2"], "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("c", "rep").alias("c"))
    out = marked.select("id", "h1", "h2").join(per_class, ["h1", "h2"], "left")
    component = F.coalesce("c", "id")
    component = F.when(component != NO_ID, component)
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


#: The same over ``embeddings`` by brute force, as SQL, for ids that are there and unique.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id"""
