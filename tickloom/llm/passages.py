"""Suffix-array dedup: removes every byte covered by a 100-byte string that also begins earlier.

Order: (document id, version, first byte), where the version is a hash that tells texts of one id apart. Texts are bytes; windows never cross documents.

1. Every window of ``WIDTH`` bytes has an anchor: the least hash of the ``GRAM``-byte strings in it, the leftmost of equals. Equal windows have equal anchors at equal places, so windows that share an anchor can be compared apart from all others. A run of windows with one anchor is a region. Scanning a document needs only itself.
2. Regions meet by anchor. A region that equals an earlier one repeats wholly (hashes of 64 bits under one of 32; equal ones inside a task are found there and not sent on). An anchor with one distinct region is done. Anchors with several send those regions' bytes to step 3; all else is unique.
3. Regions that meet by anchor fill buckets of about 200 KB, each of several shards of SHARD bytes; the shards' block-wise Burrows-Wheeler transforms are merged by interleave refinement (suffixes.py), whose common prefixes give the intervals of repeated windows.
4. Spans meet their document and are united and removed.

Rows travel as packed arrays, a row per task and bucket; buckets grow in number with the input. Texts are sent twice, to the spans they need, and tasks stream them. Anchors with very many distinct regions are dealt by the hash of each window instead of the anchor's, and of the windows that are equal in a lot only the first is sent on: a passage in very many documents comes to step 3 once a lot, not once a document. An anchor that is frequent in one lot of a task already (more than OFTEN distinct regions) sends no regions to step 2 from there but a mark, so that what meets there is at most OFTEN entries of 36 bytes from each lot.

Null texts are empty. Null ids come last in order, as one id. Rows equal in id and text count as one document; each gets its result. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import bounded_batches, lean, release_shuffles, stored, utf8

WIDTH, GRAM = suffixes.WIDTH, 32
SPREAD = WIDTH - GRAM + 1  # strings of GRAM bytes in a window
SLICE = 300_000  # bytes of text that are scanned at once
ENTRIES = 400_000  # regions that a task gathers before it sends them on
#: Bytes of text for each task of step 2, of regions for each task of step 3, and of regions for each of its buckets.
ANCHOR_BYTES, REGION_BYTES, BUCKET_BYTES = 8_000_000, 4_000_000, 200_000
SHARD = 1 << 15
#: Distinct regions of an anchor above which its windows are dealt one by one: in all, and among the ENTRIES that a task gathers.
FREQUENT, OFTEN = 20_000, 200
NO_ID = np.int64(2**63 - 1)

ENTRY = np.dtype([("anchor", "<u4"), ("region", "<u8"), ("doc", "<i8"), ("version", "<i8"), ("start", "<i4"), ("end", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("version", "<i8"), ("start", "<i4"), ("end", "<i4"), ("key", "<u4"), ("each", "<u4")])

# Kinds of rows that meet a document, in the order in which they are read.
SPANS, TEXT = 0, 1


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse; a random number for each byte."""
    base = 0x9E3779B97F4A7C15
    p = np.full(n, base, np.uint64)
    p[0] = 1
    q = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    q[0] = 1
    table = np.random.default_rng(11).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return np.cumprod(p), np.cumprod(q), table


def forget_powers() -> None:
    _powers.cache_clear()


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def regions_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, anchor, region hash) of the runs of windows with one anchor in texts laid end to end. ``ends``: where each text ends."""
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none.astype(np.uint32), none.astype(np.uint64)
    h = suffixes.gram_hashes(data, GRAM).astype(np.uint64)
    least = _slide(h << np.uint64(32) | np.arange(len(h), dtype=np.uint64), SPREAD)
    n = len(least)
    limit = np.full(n, -1, np.int64)  # the end of the text in which a window begins
    starts = np.concatenate([[0], ends[:-1]])
    sizes = np.minimum(ends, n) - np.minimum(starts, n)
    limit = np.repeat(ends, np.maximum(sizes, 0))
    at = np.flatnonzero(np.arange(n) + WIDTH <= limit)
    if not len(at):
        return none, none, none.astype(np.uint32), none.astype(np.uint64)
    where = least[at] & np.uint64(0xFFFFFFFF)
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    first = at[heads]
    end = at[np.concatenate([heads[1:], [len(at)]]) - 1] + WIDTH
    p, q, table = _powers(1 << max(12, int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * p[: len(data)])])
        region = (sums[end] - sums[first]) * q[first]
    return first, end, (least[first] >> np.uint64(32)).astype(np.uint32), region


def _slices(docs: list[int], versions: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Texts in lots of about SLICE bytes: (documents, versions, offsets, texts). A longer text comes in parts that overlap by a window less a byte, so that each window is in one."""
    d, v, o, t, size = [], [], [], [], 0
    for doc, version, text in zip(docs, versions, texts):
        for at in range(0, max(1, len(text) - WIDTH + 1), SLICE):
            part = text[at : at + SLICE + WIDTH - 1] if len(text) > SLICE else text
            d.append(doc)
            v.append(version)
            o.append(at)
            t.append(part)
            size += len(part)
            if size >= SLICE:
                yield np.array(d, np.int64), np.array(v, np.int64), np.array(o, np.int64), t
                d, v, o, t, size = [], [], [], [], 0
    if t:
        yield np.array(d, np.int64), np.array(v, np.int64), np.array(o, np.int64), t


def entries_of(docs: list[int], versions: list[int], texts: list[bytes]) -> Iterator[np.ndarray]:
    for d, v, o, t in _slices(docs, versions, texts):
        lengths = np.array([len(x) for x in t], np.int64)
        ends = np.cumsum(lengths)
        first, end, anchor, region = regions_of(np.frombuffer(b"".join(t), np.uint8), ends)
        own = np.searchsorted(ends, first, side="right")
        shift = o[own] - (ends - lengths)[own]
        e = np.empty(len(first), ENTRY)
        e["anchor"], e["region"], e["doc"], e["version"], e["start"], e["end"] = anchor, region, d[own], v[own], first + shift, end + shift
        yield e


def first_of_kind(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by anchor and region, then document order, each once (a repeated row brings them again); whether each is the first of its anchor and region."""
    e = e[np.lexsort((e["start"], e["version"], e["doc"], e["region"], e["anchor"]))]
    if len(e) > 1:
        same = np.ones(len(e) - 1, bool)
        for k in ("start", "doc", "version", "region", "anchor"):
            same &= e[k][1:] == e[k][:-1]
        if same.any():
            e = e[np.concatenate([[True], ~same])]
    first = np.ones(len(e), bool)
    first[1:] = (e["anchor"][1:] != e["anchor"][:-1]) | (e["region"][1:] != e["region"][:-1])
    return e, first


def united(doc: np.ndarray, version: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans, with those of a document that touch or overlap joined."""
    order = np.lexsort((start, version, doc))
    out = np.zeros(len(order), SPAN)
    out["doc"], out["version"], out["start"], out["end"] = doc[order], version[order], start[order], end[order]
    if len(out) < 2:
        return out
    new = np.ones(len(out), bool)
    new[1:] = (out["doc"][1:] != out["doc"][:-1]) | (out["version"][1:] != out["version"][:-1])
    group = np.cumsum(new)
    reach = np.maximum.accumulate(out["end"].astype(np.int64) + group * (1 << 32)) - group * (1 << 32)
    new[1:] |= out["start"][1:] > reach[:-1]
    heads = np.flatnonzero(new)
    merged = out[heads]
    merged["end"] = reach[np.concatenate([heads[1:], [len(out)]]) - 1]
    return merged


def _bucket(doc: np.ndarray, version: np.ndarray, buckets: int) -> np.ndarray:
    """A document's bucket. Versions are hashes already; ``bucket_column`` computes the same in Spark."""
    return ((version ^ doc) % buckets).astype(np.int32)


def bucket_column(doc: str, version: str, buckets: int) -> F.Column:
    return F.pmod(F.col(version).bitwiseXOR(F.coalesce(F.col(doc), F.lit(int(NO_ID)))), F.lit(buckets)).cast("int")


def _sent(kind: int, bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """(kind, bucket, rows, packed rows) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(heads, [*heads[1:], len(bucket)]):
        yield kind, int(bucket[a]), int(b - a), rows[a:b].tobytes()


SENT = "kind int, bucket int, n long, data binary"


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["kind", "bucket", "n", "data"])


# What step 2 hands on.
WHOLE, ASKED, LOCAL = 0, 1, 2


def _scan(anchor_buckets: int, doc_buckets: int, often: int):
    """Step 1 and, inside each lot of entries, step 2. An anchor with very many distinct regions in a lot is frequent: its regions are asked for at once, and only a mark (an entry without bytes) goes on to where the anchor meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            e, first = first_of_kind(np.concatenate(held))
            again = e[~first]
            spans = united(again["doc"], again["version"], again["start"], again["end"])
            e = e[first]
            new = np.ones(len(e), bool)
            new[1:] = e["anchor"][1:] != e["anchor"][:-1]
            many = np.diff(np.concatenate([np.flatnonzero(new), [len(e)]])) > often
            hot = np.repeat(many, np.diff(np.concatenate([np.flatnonzero(new), [len(e)]])))
            marks = np.zeros(int(many.sum()), ENTRY)
            marks["anchor"] = e["anchor"][new][many]
            ask = _asked(e[hot], True)
            e = np.concatenate([e[~hot], marks])
            return _batch([*_sent(WHOLE, (e["anchor"] % np.uint32(anchor_buckets)).astype(np.int32), e), *_sent(LOCAL, _bucket(spans["doc"], spans["version"], doc_buckets) % anchor_buckets, spans), *_sent(ASKED, _bucket(ask["doc"], ask["version"], doc_buckets) % anchor_buckets, ask)])

        for b in batches:
            docs = [NO_ID if d is None else d for d in b.column(0).to_pylist()]
            for e in entries_of(docs, b.column(1).to_pylist(), b.column(2).to_pylist()):
                held.append(e)
                size += len(e)
                if size >= ENTRIES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _asked(e: np.ndarray, each: bool | np.ndarray) -> np.ndarray:
    """Entries as spans whose bytes step 3 needs, window by window where ``each``."""
    ask = np.zeros(len(e), SPAN)
    ask["doc"], ask["version"], ask["start"], ask["end"], ask["key"], ask["each"] = e["doc"], e["version"], e["start"], e["end"], e["anchor"], each
    return ask


def _meet(doc_buckets: int, frequent: int):
    """Step 2, on all entries of a task's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            passed = []
            for kind, data in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if kind in (LOCAL, ASKED):
                    s = np.frombuffer(data, SPAN)
                    passed += _sent(WHOLE if kind == LOCAL else ASKED, _bucket(s["doc"], s["version"], doc_buckets), s)
                else:
                    parts.append(np.frombuffer(data, ENTRY))
            if passed:
                yield _batch(passed)
        if not parts:
            return
        e = np.concatenate(parts)
        del parts
        hot = np.unique(e["anchor"][e["end"] == 0])
        e, first = first_of_kind(e[e["end"] > 0])
        again = e[~first]
        spans = united(again["doc"], again["version"], again["start"], again["end"])
        yield _batch(list(_sent(WHOLE, _bucket(spans["doc"], spans["version"], doc_buckets), spans)))
        e = e[first]
        new = np.ones(len(e), bool)
        new[1:] = e["anchor"][1:] != e["anchor"][:-1]
        kinds = np.diff(np.concatenate([np.flatnonzero(new), [len(e)]]))
        kinds = np.repeat(kinds, kinds)
        # What is frequent in one task is dealt window by window everywhere, so that equal windows meet.
        kinds[np.isin(e["anchor"], hot)] = frequent + 2
        ask = _asked(e[kinds > 1], kinds[kinds > 1] > frequent)
        yield _batch(list(_sent(ASKED, _bucket(ask["doc"], ask["version"], doc_buckets), ask)))

    return run


class Lookup:
    """Rows of spans by document."""

    def __init__(self, parts: list[bytes]):
        s = np.frombuffer(b"".join(parts), SPAN)
        self.rows = s[np.lexsort((s["start"], s["version"], s["doc"]))]
        doc, version = self.rows["doc"], self.rows["version"]
        new = np.ones(len(s), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
        heads = np.flatnonzero(new).tolist()
        self.at = {(int(doc[a]), int(version[a])): (a, b) for a, b in zip(heads, [*heads[1:], len(s)])}

    def of(self, doc: int, version: int) -> np.ndarray:
        a, b = self.at.get((doc, version), (0, 0))
        return self.rows[a:b]


def distinct_windows(doc: np.ndarray, version: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of regions: (region, offset, hash, whether it is sent on), in the order of their hashes. A window that equals an earlier one of the same lot, byte by byte, repeats, and isn't sent on."""
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lengths) - lengths
    times = np.maximum(lengths - WIDTH + 1, 0)
    own = np.repeat(np.arange(len(texts)), times)
    inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    at = base[own] + inside
    data = np.frombuffer(b"".join(texts), np.uint8)
    p, q, table = _powers(1 << max(12, int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * p[: len(data)])])
        key = (sums[at + WIDTH] - sums[at]) * q[at]
    order = np.lexsort((start[own] + inside, version[own], doc[own], key))
    own, inside, at, key = own[order], inside[order], at[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    model = at[np.flatnonzero(first)][np.cumsum(first) - 1] if len(at) else at
    windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH) if len(data) >= WIDTH else np.zeros((0, WIDTH), np.uint8)
    sent = first.copy()
    for k in range(0, len(at), 50_000):
        some = slice(k, k + 50_000)
        sent[some] |= (windows[at[some]] != windows[model[some]]).any(1)
    return own, inside, key, sent


def _cut(region_buckets: int, doc_buckets: int):
    """Step 3a: the asked regions' bytes, by anchor, or by window where the anchor is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lookup = [], None
        lots: dict[int, list] = {}
        frequent: list[tuple[int, int, int, bytes]] = []
        size, many = 0, 0

        def flush() -> pa.RecordBatch:
            rows = []
            for bucket, regions in lots.items():
                head = np.zeros(len(regions), SPAN)
                for k, (doc, version, start, end, _) in enumerate(regions):
                    head[k] = (doc, version, start, end, 0, 0)
                rows.append((ASKED, bucket, len(regions), head.tobytes() + b"".join(r[4] for r in regions)))
            return _batch(rows)

        def apart() -> pa.RecordBatch:
            """Windows of frequent anchors: the distinct ones by their hash, the others' spans."""
            doc, version, start = (np.array([r[k] for r in frequent], np.int64) for k in range(3))
            texts = [r[3] for r in frequent]
            own, inside, key, sent = distinct_windows(doc, version, start, texts)
            again = own[~sent]
            begin = start[again] + inside[~sent]
            spans = united(doc[again], version[again], begin, begin + WIDTH)
            rows = list(_sent(LOCAL, _bucket(spans["doc"], spans["version"], doc_buckets) % region_buckets, spans))
            by: dict[int, list[int]] = {}
            for k, bucket in zip(np.flatnonzero(sent).tolist(), ((key[sent] >> np.uint64(32)) % np.uint64(region_buckets)).tolist()):
                by.setdefault(bucket, []).append(k)
            for bucket, ks in by.items():
                head = np.zeros(len(ks), SPAN)
                head["doc"], head["version"], head["start"] = doc[own[ks]], version[own[ks]], start[own[ks]] + inside[ks]
                head["end"] = head["start"] + WIDTH
                rows.append((ASKED, bucket, len(ks), head.tobytes() + b"".join(texts[own[k]][inside[k] : inside[k] + WIDTH] for k in ks)))
            return _batch(rows)

        for b in batches:
            kinds = b.column(0).to_pylist()
            for k, kind in enumerate(kinds):
                if kind == SPANS:
                    parts.append(b.column(2)[k].as_py())
                    continue
                if lookup is None:
                    lookup, parts = Lookup(parts), []
                doc = b.column(3)[k].as_py()
                doc = int(NO_ID) if doc is None else doc
                version = b.column(4)[k].as_py()
                found = lookup.of(doc, version)
                if not len(found):
                    continue
                lookup.at.pop((doc, version))  # a repeated row has been seen
                text = b.column(2)[k].as_py()
                for start, end, key, each in zip(found["start"].tolist(), found["end"].tolist(), found["key"].tolist(), found["each"].tolist()):
                    if each:
                        frequent.append((doc, version, start, text[start:end]))
                        many += end - start
                        if many >= SLICE:
                            yield apart()
                            frequent, many = [], 0
                    else:
                        lots.setdefault(key % region_buckets, []).append((doc, version, start, end, text[start:end]))
                        size += end - start
                if size >= 4_000_000:
                    yield flush()
                    lots, size = {}, 0
        if lots:
            yield flush()
        if frequent:
            yield apart()

    return run


def _merge(doc_buckets: int):
    """Step 3b: repeated windows among a task's regions, a bucket at a time where they come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heads, texts = None, [], []

        def solve() -> pa.RecordBatch:
            head = np.concatenate(heads)
            place = np.stack([head["doc"], head["version"], head["start"].astype(np.int64)], 1)
            own, at = suffixes.repeated(texts, place, SHARD)
            start = head["start"][own].astype(np.int64) + at
            spans = united(head["doc"][own], head["version"][own], start, start + WIDTH)
            return _batch(list(_sent(WHOLE, _bucket(spans["doc"], spans["version"], doc_buckets), spans)))

        for b in batches:
            for kind, bucket, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if kind == LOCAL:
                    spans = np.frombuffer(data, SPAN)
                    yield _batch(list(_sent(WHOLE, _bucket(spans["doc"], spans["version"], doc_buckets), spans)))
                    continue
                if bucket != current and heads:
                    yield solve()
                    heads, texts = [], []
                current = bucket
                head = np.frombuffer(data, SPAN, n)
                at = n * SPAN.itemsize
                for size in (head["end"] - head["start"]).tolist():
                    texts.append(data[at : at + size])
                    at += size
                heads.append(head)
        if heads:
            yield solve()

    return run


def _with_texts(texts: DataFrame, spans: DataFrame, buckets: int, keep: list[str]) -> DataFrame:
    """Texts and the packed spans of their bucket in one task, the spans first."""
    left = spans.select(F.lit(SPANS).alias("kind"), "bucket", "data", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("version"), *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in keep))
    right = texts.select(F.lit(TEXT).alias("kind"), "bucket", F.col("b").alias("data"), "doc", "version", *keep)
    return left.unionByName(right).repartition(max(1, buckets // 8), "bucket").sortWithinPartitions("kind")


def _prepared(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(doc, version, b, k_0, ...): only the columns that are used, under names of our own."""
    own = df.select(F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("b"), *(F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)))
    return own.withColumn("version", F.xxhash64("b"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), frequent: int = FREQUENT, texts: bool = True, characters: bool = False, often: int = OFTEN) -> DataFrame:
    """(id, n_bytes, spans array<struct<start, end>>, kept binary, kept_sha256, *keep): the maximal removed spans of every row, and what is left. ``texts``: with the bytes that are left, else null. ``characters``: spans are shrunk to whole characters of UTF-8."""
    spark = df.sparkSession
    bounded_batches(spark)
    own = _prepared(df, id_col, text_col, keep)
    total = own.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    anchor_tasks = max(8, int(total // ANCHOR_BYTES) + 1)
    anchor_buckets = doc_buckets = 8 * anchor_tasks
    scanned = own.select("doc", "version", "b").mapInArrow(lean(_scan(anchor_buckets, doc_buckets, often), forget_powers), SENT)
    met = scanned.repartition(anchor_tasks, "bucket").mapInArrow(lean(_meet(doc_buckets, frequent)), SENT)
    found = stored(met, "passages")
    release_shuffles(spark)

    bucketed = own.withColumn("bucket", bucket_column("doc", "version", doc_buckets))
    asked = found.where(F.col("kind") == ASKED)
    n = asked.agg(F.sum("n")).first()[0] or 0
    # Buckets follow the bytes alone, so that each has several shards on small tables as well.
    buckets = int(n * 140 // BUCKET_BYTES) + 1
    region_tasks = min(buckets, max(8, int(n * 140 // REGION_BYTES) + 1))
    cut = _with_texts(bucketed.select("doc", "version", "b", "bucket"), asked, doc_buckets, []).mapInArrow(lean(_cut(buckets, doc_buckets), forget_powers), SENT)
    windows = stored(cut.repartition(region_tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_merge(doc_buckets)), SENT), "passages")
    release_shuffles(spark)

    spans = found.where(F.col("kind") == WHOLE).unionByName(windows)
    kept_names = [f"k_{i}" for i in range(len(keep))]
    joined = _with_texts(bucketed.select("doc", "version", "b", "bucket", *kept_names), spans, doc_buckets, kept_names)
    names = [id_col, "n_bytes", "spans", "kept", "kept_sha256", *keep]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lookup = [], None
        for b in batches:
            kinds = b.column(0).to_pylist()
            if SPANS in kinds:
                parts += [b.column(2)[k].as_py() for k, kind in enumerate(kinds) if kind == SPANS]
                b = b.filter(pa.array([kind == TEXT for kind in kinds]))
            if not b.num_rows:
                continue
            if lookup is None:
                lookup, parts = Lookup(parts), []
            n, found, left, sha = [], [], [], []
            for text, doc, version in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                s = lookup.of(int(NO_ID) if doc is None else doc, version)
                s = united(s["doc"], s["version"], s["start"], s["end"]) if len(s) else s
                a, e = s["start"].tolist(), s["end"].tolist()
                if characters and a:
                    whole = whole_characters(text, list(zip(a, e)))
                    a, e = [x for x, _ in whole], [y for _, y in whole]
                rest = b"".join(text[x:y] for x, y in zip([0, *e], [*a, len(text)])) if a else text
                n.append(len(text))
                found.append([{"start": x, "end": y} for x, y in zip(a, e)])
                left.append(rest if texts else None)
                sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(n, pa.int64()), pa.array(found, span_type), pa.array(left, pa.binary()), pa.array(sha, pa.string()), *b.columns[5:]], names=names)

    schema = f"`{id_col}` long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string" + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(lean(finish), schema)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    s = repeated_spans(df, id_col, text_col, texts=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return s.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to the characters of UTF-8 that lie in them wholly."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` (columns ``keep``) with their repeated passages taken out of the text, by whole characters, and the count of characters set anew. Rows of which nothing is left are dropped; rows that were empty or null stay."""
    own = {c: f"c_{i}" for i, c in enumerate(keep) if c != text_col}
    renamed = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *(F.col(c).alias(n) for c, n in own.items()), F.col(text_col).isNull().alias("none"))
    found = repeated_spans(renamed, "i", "t", keep=(*own.values(), "none"), characters=True)
    left = found.where("n_bytes = 0 or octet_length(kept) > 0").withColumn("t", F.when(~F.col("none"), F.col("kept").cast("string")))
    out = left.select(*(F.col(own.get(c, "t")).alias(c) for c in keep))
    return out.withColumn(count_col, F.length(text_col).cast(df.schema[count_col].dataType)) if count_col in keep else out


#: The digest over ``documents`` as SQL, window by window over the bytes' hexadecimal digits, for ids that are there and unique.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d)),
f AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM f)),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
