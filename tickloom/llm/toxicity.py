"""Toxicity by subword bags: n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word (lower case, without punctuation around it) counts with its character n-grams of ``NGRAMS`` characters, ends marked, and with itself, each hashed to one of ``buckets`` vectors. The distinct words of a lot of texts are hashed together, in whole arrays. A text's vector is the mean over all its words' features, and a linear softmax over two classes reads it. Vectors and softmax are trained together. A misspelling that was never seen shares most n-grams with the word it stands for, and so its vectors.

Training takes at most ``sample`` labelled rows (the first by a hash of their id), whose feature counts go to the driver; the fitted model is one number per bucket, at most ``buckets`` of them, and goes to the executors. Scoring is local to a row and reads whole texts.

Null and empty texts have no words and score by the bias alone. Null labels and ids aren't trained on. Repeated rows score alike. Without any labelled row, or with labels of one kind only, all scores are that kind's share (0.5 without any).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, bounded_batches, lean, utf8

BUCKETS = 1 << 16
NGRAMS = (3, 4, 5)
SAMPLE = 6000
DIM = 8
#: Characters of text whose words are looked at together, and characters whose n-grams are.
LOT, PART = 4_000_000, 500_000
EDGE = "\"'`.,;:!?()[]{}<>|*#%&$@~^_=+-/\\…«»“”‘’¡¿"
BREAK = re.compile(r"\s+")
#: Bytes of a word up to which whole words are hashed side by side.
LOCKSTEP = 64


@lru_cache(1)
def crc_table() -> np.ndarray:
    """What crc32 does with a byte, by its polynomial, bit by bit."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = t >> np.uint32(1) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


def crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return crc_table()[(state ^ byte) & np.uint32(255)] ^ state >> np.uint32(8)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, its number, the distinct words) for the words that have a letter or digit, in lower case and without punctuation around them."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
    coded = split.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    names = pc.utf8_trim(coded.dictionary, EDGE)
    sound = pc.match_substring_regex(names, r"[\pL\pN]").to_numpy(zero_copy_only=False)
    kept = sound[number] if len(number) else np.zeros(0, bool)
    return owner[kept], (np.cumsum(sound) - 1)[number[kept]], names.filter(pa.array(sound))


def features(words: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, feature number) of the words' features, in parts: of each word with its ends marked, the n-grams that are shorter than it, and the whole. A feature's number is its crc32, worked out a byte at a time for all n-grams at once."""
    if not len(words):
        return
    marked = [f"<{w}>".encode("utf-8", "replace") for w in words.to_pylist()]
    data = np.frombuffer(b"".join(marked), np.uint8)
    chars = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where characters begin
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(sizes)
    none = np.uint32(0xFFFFFFFF)
    for at in range(0, len(chars) - 1, PART):
        place = np.arange(at, min(len(chars) - 1, at + PART))
        own = np.searchsorted(ends, place, side="right")
        room = ends[own] - place  # characters from here to the word's end
        fits = (room >= NGRAMS[0]) & (sizes[own] > NGRAMS[0])
        place, own, room = place[fits], own[fits], room[fits]
        state = np.full(len(place), none, np.uint32)
        for n in range(1, NGRAMS[-1] + 1):
            if n > NGRAMS[0]:
                fits = (room >= n) & (sizes[own] > n)
                place, own, room, state = place[fits], own[fits], room[fits], state[fits]
            begin = chars[place + n - 1]
            long = chars[place + n] - begin
            state = crc_step(state, data[begin])
            for k in range(1, 4):
                some = np.flatnonzero(long > k)
                if not len(some):
                    break
                state[some] = crc_step(state[some], data[begin[some] + k])
            if n >= NGRAMS[0]:
                yield own, ((state ^ none) % np.uint32(buckets)).astype(np.int64)
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    begin = np.cumsum(length) - length
    state = np.full(len(marked), none, np.uint32)
    live = np.flatnonzero(length <= LOCKSTEP)
    for k in range(LOCKSTEP):
        live = live[length[live] > k]
        if not len(live):
            break
        state[live] = crc_step(state[live], data[begin[live] + k])
    for w in np.flatnonzero(length > LOCKSTEP).tolist():
        state[w] = zlib.crc32(marked[w]) ^ 0xFFFFFFFF
    yield np.arange(len(marked)), ((state ^ none) % np.uint32(buckets)).astype(np.int64)


@dataclass
class Model:
    """``weights``: what a feature adds to the logit of class 1, before averaging. ``bias``: the logit of an empty text."""

    weights: np.ndarray
    bias: float

    def score(self, total: float, n: int) -> float:
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = 8, rate: float = 3.0, batch: int = 64, decay: float = 1e-6, seed: int = 7) -> Model:
    """Fits vectors E (buckets x dim) and softmax W (dim x 2), b by Adagrad on the cross entropy. ``bags``: (feature numbers, counts) of each text. Vectors start at 0, so that features never seen say nothing."""
    y = np.asarray(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    E = np.zeros((buckets, dim), np.float32)
    W = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    b = np.log(np.array([1 - share, share], np.float32))
    hE, hW, hb = np.full((buckets, dim), 1e-8, np.float32), np.full((dim, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    scale = 100.0  # means over thousands of features are small; the scale only changes their unit
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            own = [bags[i] for i in at]
            sizes = np.array([len(f) for f, _ in own])
            ids = np.concatenate([f for f, _ in own]).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
            share_of = np.concatenate([c * np.float32(scale / c.sum(dtype=np.float64)) if len(c) else c for _, c in own]).astype(np.float32) if sizes.sum() else np.zeros(0, np.float32)
            row = np.repeat(np.arange(len(at)), sizes)
            V = np.stack([np.bincount(row, weights=E[ids, k] * share_of, minlength=len(at)) for k in range(dim)], 1).astype(np.float32)
            z = V @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            gW, gb, gV = V.T @ p, p.sum(0), p @ W.T
            used, inverse = np.unique(ids, return_inverse=True)
            for k in range(dim):
                g = np.bincount(inverse, weights=gV[row, k] * share_of, minlength=len(used)).astype(np.float32) + decay * E[used, k]
                hE[used, k] += g * g
                E[used, k] -= step * 0.1 * g / np.sqrt(hE[used, k])
            hW += gW * gW
            W -= step * 0.1 * gW / np.sqrt(hW)
            hb += gb * gb
            b -= step * 0.1 * gb / np.sqrt(hb)
    return Model((E @ (W[:, 1] - W[:, 0]) * scale).astype(np.float32), float(b[1] - b[0]))


def parts_of(text: str) -> list[str]:
    """A text in parts of about a lot, cut at white space."""
    out, start = [], 0
    while len(text) - start > LOT:
        found = BREAK.search(text, start + LOT)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.end()
    return [*out, text[start:]]


def scores(model: Model, texts: list[str]) -> list[float]:
    """The score of each text. Texts are looked at in lots, long ones in parts; nothing is remembered between lots."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    lot: list[str] = []
    owner: list[int] = []
    size = 0

    def done() -> None:
        at, number, words = words_of(lot)
        own, times = np.zeros(len(words)), np.zeros(len(words), np.int64)
        for word, feature in features(words, len(model.weights)):
            own += np.bincount(word, weights=model.weights[feature], minlength=len(words))
            times += np.bincount(word, minlength=len(words))
        text = np.array(owner, np.int64)[at]
        total[:] += np.bincount(text, weights=own[number], minlength=len(texts))
        n[:] += np.bincount(text, weights=times[number], minlength=len(texts)).astype(np.int64)

    for k, t in enumerate(texts):
        for part in parts_of(t):
            lot.append(part)
            owner.append(k)
            size += len(part)
            if size >= LOT:
                done()
                lot, owner, size = [], [], 0
    if lot:
        done()
    return [model.score(a, b) for a, b in zip(total.tolist(), n.tolist())]


def bag(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, counts) of a text."""
    total = np.zeros(buckets)
    for part in parts_of(text):
        _, number, words = words_of([part])
        times = np.bincount(number, minlength=len(words))
        for word, feature in features(words, buckets):
            total += np.bincount(feature, weights=times[word], minlength=buckets)
    ids = np.flatnonzero(total)
    return ids, total[ids].astype(np.int64)


def held_out(id_col: str) -> F.Column:
    """Rows whose labels are never learned: crc32 of the id as text is 2 modulo 4. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """Trains on at most ``sample`` labelled rows that aren't held out."""
    bounded_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(~held_out("_id") & F.col("_y").isin(0, 1))
    chosen = marked.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most ``sample`` pairs of numbers.
    rows = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_b")).join(F.broadcast(chosen), "_id").select("_id", "_b", "_y")

    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bag(t.decode("utf-8", "replace"), buckets) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array([f.astype(kind).tobytes() for f, _ in found], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c in found], pa.binary()), b.column(2)], names=["id", "f", "c", "y"])

    # The bags stay in the Arrow buffers that they arrive in.
    got = rows.mapInArrow(lean(run), "id string, f binary, c binary, y int").toArrow()
    ids, y = got.column("id").to_pylist(), got.column("y").to_numpy()
    views = [[(np.frombuffer(chunk[k].as_buffer(), dtype)) for chunk in got.column(name).chunks for k in range(len(chunk))] for name, dtype in (("f", kind), ("c", "<f4"))]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], views[0][k].tobytes()[:64]))
    return train([(views[0][k], views[1][k]) for k in order], y[order], buckets)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, score, predicted[, kept columns]) for every row. A kept column of one of these names comes out as kept_<name>."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # one number per bucket
    own = [id_col, "held_out", "score", "predicted"]
    names = [*own, *(apart(c, own) for c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scores(shared.value, [t.decode("utf-8", "replace") for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32()), *b.columns[3:]], names=names)

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    schema = ", ".join([f"{id_col} {kinds[id_col]}, held_out boolean, score double, predicted int", *(f"`{apart(c, own)}` {kinds[c]}" for c in keep)])
    return docs.select(F.col(id_col), held_out(id_col).alias("h"), utf8(text_col).alias("b"), *(F.col(c) for c in keep)).mapInArrow(lean(run), schema)
