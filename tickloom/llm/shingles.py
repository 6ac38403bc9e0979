"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of five words (words: runs of what isn't white space); fewer words make one shingle, none make the empty set. Sets are embedded by ``SKETCH`` least hashes. In each run, a tree splits the sets: at a node, one coordinate (and with probability 1/4 a second, so that a pair at the threshold survives a level about once) is sampled by a hash of the node; sets that agree there share a child. A node of at most ``limit`` sets is compared by brute force; a larger one is split again, up to ``depth`` times. A pair of similarity ``least`` is found in a run with a probability that follows from the depth; the number of runs follows from that and the target recall.

Nodes are tables of (node, set): splitting and counting are joins and counts. A node that stays large (copies with small changes don't come apart) is cut into blocks, whose pairs are compared in tasks of their own: nothing is capped. A pair that shares several nodes counts in the first of them. Sketches tell which sets have a possible partner (an estimate far below the threshold is none); only those are read again, and compared shingle by shingle.

Sets that are equal are one class; its members take its links. Links are counted and reduced to a spanning forest in the task that finds them; pairs are never sent. Empty sets link with nothing. Components run over classes, each known by its first row's id and a hash of its text, so that neither null ids nor ids shared by several texts join anything. Null texts are empty; null ids take part and come last in order, and a component of null ids alone has null as its class; repeated rows are documents of their own, and are kept or not together. The largest 64-bit number stands for null ids and is no id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dealt, drop_stored, groups, lean, release_shuffles, stored, utf8
from .graph import components, local_forest

WORDS, LEAST = 5, 0.8
SKETCH = 64
LIMIT, DEPTH, BLOCK = 256, 3, 1500
RECALL = 0.99999
#: Sketches that agree in a smaller part than this have no similarity of 0.8: five standard deviations below.
POSSIBLE = 0.55
#: Words that a worker remembers before it starts anew, and characters up to which it remembers a word.
REMEMBERED, SHORT = 200_000, 64
NO_ID = 2**63 - 1
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(word) <= SHORT:
            self[word] = h
        return h


_words = _Words()


def forget_words() -> None:
    _words.clear()


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's shingles."""
    if len(_words) > REMEMBERED:
        _words.clear()
    own = text.split()
    if not own:
        return np.zeros(0, U)
    h = np.fromiter(map(_words.__getitem__, own), U, len(own))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(words, len(h)), U)
    for k in range(min(words, len(h))):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


_seeds = np.random.default_rng(5).integers(0, 2**63, (2, SKETCH), np.int64).astype(U) * U(2) + U(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """The least hash of each coordinate; the upper 32 bits."""
    if not len(s):
        return np.zeros(SKETCH, np.uint32)
    least = np.full(SKETCH, 2**64 - 1, U)
    for at in range(0, len(s), 4096):
        x = s[at : at + 4096, None] * _seeds[0] + _seeds[1]
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(0), out=least)
    return (least >> U(32)).astype(np.uint32)


def runs_for(recall: float, least: float, depth: int) -> int:
    """Runs after which a pair of similarity ``least`` is missed with probability 1 - recall."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - least * p) * (1 - least * p / 4)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def children(nodes: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): the children that each row's node sends it to."""
    a = mixed(nodes ^ U(0xA5A5A5A5A5A5A5A5))
    rows = np.arange(len(nodes))
    first = (a % U(SKETCH)).astype(np.int64)
    more = np.flatnonzero(mixed(a) >> U(62) == 0)
    second = (a[more] // U(SKETCH) % U(SKETCH)).astype(np.int64)
    rows, at = np.concatenate([rows, more]), np.concatenate([first, second])
    return rows, mixed(nodes[rows] * U(0x9E3779B97F4A7C15) + at.astype(U) * U(1 << 32) + sketches[rows, at])


def describe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, h1, h2, n, sketch) for every row: its set's 128-bit hash, size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, n, sk = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingle_set(text.decode("utf-8", "replace"))
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                n.append(len(s))
                sk.append(sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(sk, pa.binary())], names=["id", "version", "h1", "h2", "n", "sketch"])

    own = df.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("b"))
    return own.select("id", F.xxhash64("b").alias("version"), "b").mapInArrow(lean(run, forget_words), "id long, version long, h1 long, h2 long, n long, sketch binary")


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _split(runs: int):
    """Rows of (h1, h2, sketch[, node]) to (node, h1, h2) of the next level; without nodes, of the first level of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk = _sketches(b.column(2))
            if b.num_columns > 3:
                sources = [b.column(3).to_numpy().view(U)]
            else:
                sources = [np.full(b.num_rows, r * 0x9E3779B97F4A7C15 + 1 & 2**64 - 1, U) for r in range(1, runs + 1)]
            for nodes in sources:
                rows, child = children(nodes, sk)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(0).take(at), b.column(1).take(at)], names=["node", "h1", "h2"])

    return run


SPLIT = "node long, h1 long, h2 long"


def leaves(classes: DataFrame, runs: int, limit: int, depth: int) -> DataFrame:
    """(node, h1, h2), stored: the nodes at which sets are compared, each with two sets at least."""
    used = []
    level = classes.select("h1", "h2", "sketch").mapInArrow(_split(runs), SPLIT).distinct()
    out = None
    for d in range(depth):
        level = stored(level, "nodes")
        # Stored, so that both sides of the join are plain exchanges, which Spark splits where a node is hot.
        sizes = stored(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        sized = level.join(sizes, "node")
        used += [level, sizes]
        done = (sized if d == depth - 1 else sized.where(F.col("size") <= limit)).select("node", "h1", "h2")
        out = done if out is None else out.unionByName(done)
        if d == depth - 1:
            break
        large = sized.where(F.col("size") > limit).select("node", "h1", "h2")
        level = large.join(classes.select("h1", "h2", "sketch"), ["h1", "h2"]).select("h1", "h2", "sketch", "node").mapInArrow(_split(runs), SPLIT).distinct()
    out = stored(out, "leaves")
    drop_stored(*used)
    return out


def _patterns(nodes: list[np.ndarray], node: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows' kinds by their nodes below this one, and which kinds share one: those pairs of rows are compared elsewhere."""
    below = [x[x < node].tobytes() for x in nodes]
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(x, len(kinds)) for x in below])
    where: dict[int, list[int]] = {}
    for x, k in kinds.items():
        for n in np.frombuffer(x, np.int64).tolist():
            where.setdefault(n, []).append(k)
    elsewhere = np.zeros((len(kinds), len(kinds)), bool)
    for ks in where.values():
        if len(ks) == 1:
            elsewhere[ks[0], ks[0]] = True
        else:
            elsewhere[np.ix_(ks, ks)] = True
    return kind, elsewhere


def _pairs(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))


def possible(node: int, side: np.ndarray, same: bool, sizes: np.ndarray, sk: np.ndarray, nodes: list[np.ndarray], least: float, part: float = POSSIBLE) -> np.ndarray:
    """Rows that have a possible partner here whose first shared node this is."""
    left, right = _pairs(side, same)
    hit = np.zeros(len(side), bool)
    kind, elsewhere = _patterns(nodes, node)
    need = int(part * SKETCH)
    step = max(1, 400_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        ok = ~elsewhere[np.ix_(kind[rows], kind[right])]
        if same:
            ok &= rows[:, None] < right[None, :]
        ok &= (sizes[rows][:, None] >= least * sizes[right][None, :]) & (sizes[right][None, :] >= least * sizes[rows][:, None])
        r, c = np.nonzero(ok)
        for k in range(0, len(r), 100_000):
            i, j = rows[r[k : k + 100_000]], right[c[k : k + 100_000]]
            close = (sk[i] == sk[j]).sum(1) >= need
            hit[i[close]] = True
            hit[j[close]] = True
    return hit


def compared(node: int, side: np.ndarray, same: bool, sets: list[np.ndarray], mult: np.ndarray, nodes: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, place of the least row of its component) for the pairs whose first shared node this is, by exact similarity."""
    left, right = _pairs(side, same)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1  # a shingle of one set is in no intersection
    owner, number = owner[often], number[often]
    if len(number):
        fresh = np.ones(len(number), bool)
        fresh[1:] = number[1:] != number[:-1]
        number = np.cumsum(fresh) - 1
    total = int(number[-1]) + 1 if len(number) else 0
    kind, elsewhere = _patterns(nodes, node)
    links, aa, bb = np.zeros(len(sets), np.int64), [], []
    step = 512
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        both = np.zeros((len(rows), len(right)), np.float32)
        place = np.full(len(sets), -1)
        place[rows] = np.arange(len(rows))
        place_r = np.full(len(sets), -1)
        place_r[right] = np.arange(len(right))
        for col in range(0, total, 4096):  # counts below 2**24 are exact in single precision
            a, b = np.searchsorted(number, [col, col + 4096])
            o, n = owner[a:b], number[a:b] - col
            width = min(4096, total - col)
            x, y = np.zeros((len(rows), width), np.float32), np.zeros((len(right), width), np.float32)
            k = place[o] >= 0
            x[place[o[k]], n[k]] = 1
            k = place_r[o] >= 0
            y[place_r[o[k]], n[k]] = 1
            both += x @ y.T
        union = sizes[rows][:, None] + sizes[right][None, :] - both
        ok = (both >= least * union - 1e-6 * union) & ~elsewhere[np.ix_(kind[rows], kind[right])]
        # The threshold in whole numbers, where it is a fraction of small ones.
        top = round(least * 1000)
        ok &= both.astype(np.int64) * 1000 >= top * union.astype(np.int64)
        if same:
            ok &= rows[:, None] < right[None, :]
        r, c = np.nonzero(ok)
        r, c = rows[r], right[c]
        np.add.at(links, r, mult[c])
        np.add.at(links, c, mult[r])
        aa.append(r)
        bb.append(c)
    a, b = (np.concatenate(aa), np.concatenate(bb)) if aa else (np.zeros(0, np.int64),) * 2
    return links, local_forest(len(sets), a, b, np.arange(len(sets)))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, recall: float = RECALL, limit: int = LIMIT, depth: int = DEPTH, block: int = BLOCK, versions: bool = False) -> DataFrame:
    """(id, class_id, n_links, copy_of, kept[, version]) for every row. class_id: the least id reachable by links, itself included; n_links: other documents of similarity ``least`` or more; copy_of: the least id with an equal set; kept: whether the row is its component's first by (id, version), null ids last; version: xxhash64 of the text's bytes, which tells rows of one id apart."""
    spark = df.sparkSession
    bounded_batches(spark)
    described = stored(describe(df, id_col, text_col), "sets")
    # Combined before the shuffle: any number of copies is one row a task.
    classes = stored(described.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "version")).alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    where = leaves(classes, runs_for(recall, least, depth), limit, depth)
    of_class = where.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("node")).alias("nodes"))  # a set has a few nodes for each run
    tasks = dealt(where, "node", "h1", block)
    full = tasks.join(classes.select("h1", "h2", "n", "sketch").join(of_class, ["h1", "h2"]), ["h1", "h2"]).select("node", "i", "j", "side", "h1", "h2", "n", "sketch", "nodes")
    grouped = full.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, i, j), t in groups(batches, 3):
            side = t.column("side").to_numpy()
            nodes = [np.array(x, np.int64) for x in t.column("nodes").to_pylist()]
            hit = np.flatnonzero(possible(node, side, i == j, t.column("n").to_numpy(), _sketches(t.column("sketch")), nodes, least))
            if len(hit):
                some = t.select(["node", "i", "j", "side", "h1", "h2", "nodes"]).take(pa.array(hit))
                yield from some.combine_chunks().to_batches()

    asked = stored(grouped.mapInArrow(lean(probe), "node long, i int, j int, side int, h1 long, h2 long, nodes array<long>"), "asked")
    drop_stored(where)
    release_shuffles(spark)
    # The texts of the classes that have a possible partner, once each, then their sets to each task that compares them.
    needed = asked.select("h1", "h2").distinct().join(classes.select("h1", "h2", "mult", F.col("rep.id").alias("id"), F.col("rep.version").alias("version")), ["h1", "h2"])
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), utf8(text_col).alias("b")).withColumn("version", F.xxhash64("b"))
    own = needed.join(texts, ["id", "version"]).join(asked.groupBy("h1", "h2").agg(F.collect_list(F.struct("node", "i", "j", "side")).alias("tasks"), F.first("nodes").alias("nodes")), ["h1", "h2"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(x.decode("utf-8", "replace")).tobytes() for x in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sets, b.column(4), b.column(5)], names=["h1", "h2", "mult", "s", "tasks", "nodes"])

    task_type = "array<struct<node: long, i: int, j: int, side: int>>"
    sets = own.select("h1", "h2", "mult", "b", "tasks", "nodes").mapInArrow(lean(to_sets, forget_words), f"h1 long, h2 long, mult long, s binary, tasks {task_type}, nodes array<long>")
    spread = sets.select("h1", "h2", "mult", "s", "nodes", F.explode("tasks").alias("t")).select("t.node", "t.i", "t.j", "t.side", "h1", "h2", "mult", "s", "nodes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (node, i, j), t in groups(batches, 3):
            h1, h2 = t.column("h1").to_numpy(), t.column("h2").to_numpy()
            once = np.sort(np.unique(np.stack([h1, h2, t.column("side").to_numpy()]), axis=1, return_index=True)[1])  # repeated rows bring a set twice
            t = t.take(pa.array(once))
            h1, h2 = h1[once], h2[once]
            links, root = compared(node, t.column("side").to_numpy(), i == j, [np.frombuffer(s, U) for s in t.column("s").to_pylist()], t.column("mult").to_numpy(), [np.array(x, np.int64) for x in t.column("nodes").to_pylist()], least)
            some = np.flatnonzero(links > 0)
            if len(some):
                cols = (h1[some], h2[some], links[some], h1[root[some]], h2[root[some]])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h1", "h2", "links", "r1", "r2"])

    found = stored(spread.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(lean(compare), "h1 long, h2 long, links long, r1 long, r2 long"), "found")
    drop_stored(asked)
    release_shuffles(spark)
    counted = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    # A class is known by its first row (id, version): ids alone may be null or shared by several texts.
    names = classes.select("h1", "h2", F.col("rep").alias("name"))
    edges = found.where("h1 <> r1 or h2 <> r2").select("h1", "h2", "r1", "r2").distinct().join(names.withColumnRenamed("name", "a"), ["h1", "h2"]).join(names.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("name").alias("b")), ["r1", "r2"]).select("a", "b")
    joined = components(edges)
    per_class = classes.select("h1", "h2", "rep", "mult").join(counted, ["h1", "h2"], "left").join(joined, F.col("rep") == F.col("node"), "left").select("h1", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = described.select("id", "version", "h1", "h2").join(per_class, ["h1", "h2"], "left")
    own = F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "version")
    real = lambda c: F.when(c["id"] != NO_ID, c["id"])
    component = F.coalesce("component", own)
    return out.select(F.col("id").alias(id_col), real(component).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), real(F.coalesce("rep", own)).alias("copy_of"), (component == own).alias("kept"), *(["version"] if versions else []))


#: The join over ``documents`` as SQL, for ids that are there and unique.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b, m = x.n AND m = y.n AS equal FROM m JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE m * 10 >= 8 * (x.n + y.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE equal) AS twin FROM p GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, least(doc_id, coalesce(twin, doc_id)) AS copy_of, doc_id = class_id AS kept
FROM documents JOIN c ON c.a = doc_id LEFT JOIN k ON k.a = doc_id"""
