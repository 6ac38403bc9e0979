"""Packing token pieces into fixed-length sequences: shortest-pack-first over the length histogram.

1. Each text becomes token ids and a closing id; it is cut into pieces of at most ``max_len`` ids.
2. The pieces' length histogram (at most ``max_len`` rows) goes to the driver, which places the lengths longest first, each into the shortest packs that still have room, and keeps a count for each pattern of lengths. The number of patterns depends on ``max_len``, not on the corpus.
3. The pieces of each length are ranked and the patterns' places are handed out by rank. Ranks come from counts per (bucket, length) and a rank inside each, so that no length is ever in one task, however frequent.

Null text: empty, so the closing id alone. Repeated rows are packed as often as they come; null ids are kept. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean, stored, utf8

#: White space without a break beyond which a text goes to the tokenizer library: the other coder's pattern matcher steps back over it on a stack of limited depth.
BLANK = 500
# How a byte-level BPE splits a text (its pre-tokenizer's pattern), and the characters that its file writes for bytes.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _bytes_of_characters() -> dict[str, int]:
    """The printed bytes stand for themselves, the others for the characters from 256 on."""
    rest = [b for b in range(256) if b not in PRINTED]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Token ids of texts as the tokenizer library gives them.

    Where the file is a plain byte-level BPE whose ids follow the order of its merges, a merge is known by what it gives, and tiktoken's coder finds the same ids from the vocabulary alone, several times faster and without remembering words. That is checked when the file is read, over the settings and over every token of the vocabulary. Texts that hold an added token's string, or very long white space, go to the library, as does every text if the file isn't such a BPE.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.blank, self.two = re.compile(rf"\s{{{BLANK}}}"), re.compile(r"\s\s")
        self.coder = self._coder()

    def _coder(self):
        import tiktoken

        spec = json.loads(self.tok.to_str())
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not any(spec[k] for k in ("normalizer", "truncation", "padding"))
        if not (plain and usual):
            return None
        of = _bytes_of_characters()
        vocabulary = {k: v for k, v in model["vocab"].items() if k not in self.added}
        if any(c not in of for k in vocabulary for c in k):
            return None
        ranks = {bytes(of[c] for c in k): v for k, v in vocabulary.items()}
        given = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
        if None in given or any(a >= b for a, b in zip(given, given[1:])) or len(given) + 256 != len(ranks):
            return None
        coder = tiktoken.Encoding(name="by-vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        words = [t for t in (k.decode("utf-8", "ignore") for k in ranks) if t]
        same = all(coder.encode_ordinary(w) == e.ids for w, e in zip(words, self.tok.encode_batch_fast(words, add_special_tokens=False)))
        return coder if same else None

    def whole(self, text: str) -> list[int]:
        """By the library."""
        return self.tok.encode(text, add_special_tokens=False).ids

    def one(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        # Of BLANK characters in a row, two neighbours among every BLANK / 2nd are white space: few texts need the full search.
        if self.coder is None or any(a in text for a in self.added) or (self.two.search(text[:: BLANK // 2]) and self.blank.search(text)):
            return np.array(self.whole(text), np.uint32)
        return self.coder.encode_to_numpy(text, disallowed_special=())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.one(t) for t in texts]


@lru_cache(2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): each text's ids, then ``end_id``, in pieces of at most ``max_len``. ``ids``: little-endian unsigned 32-bit numbers."""
    bounded_batches(df.sparkSession)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = byte_tokens(tokenizer)
        for b in batches:
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for k, ids in enumerate(tok.encode([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()])):
                ids = np.append(ids, end_id).astype("<u4")
                for at in range(0, len(ids), max_len):
                    part = ids[at : at + max_len].tobytes()
                    row.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids))
                    if keep_ids:
                        kept.append(part)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))] + [pa.array(kept, pa.binary())] * keep_ids, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), utf8(text_col).alias("b")).mapInArrow(lean(run), f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def pack_histogram(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their counts. Lengths go longest first; each goes into the shortest packs that have room for it, many at a time; what finds no room opens packs of its own."""
    groups: list[tuple[int, int, tuple[int, ...], int]] = []  # a heap: (used, order, pattern, count)
    order = 0
    full: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left and groups and groups[0][0] + length <= max_len:
            used, _, pattern, count = heapq.heappop(groups)
            n = min(count, left)
            if count > n:
                order += 1
                heapq.heappush(groups, (used, order, pattern, count - n))
            left -= n
            grown.append((used + length, (*pattern, length), n))
            if not left or not groups or groups[0][0] + length > max_len:
                # what has just grown may take another piece of this length
                for u, p, c in grown:
                    order += 1
                    heapq.heappush(groups, (u, order, p, c))
                grown = []
        for u, p, c in grown:
            order += 1
            heapq.heappush(groups, (u, order, p, c))
        if left:
            per = max_len // length  # new packs hold as many of these as fit
            for size in [per] * (left >= per) + [left % per] * bool(left % per):
                n = left // per if size == per else 1
                if n:
                    order += 1
                    heapq.heappush(groups, (size * length, order, (length,) * size, n))
    full += [(p, c) for _, _, p, c in sorted(groups, key=lambda g: (-g[0], g[2]))]
    merged: dict[tuple[int, ...], int] = {}
    for p, c in full:
        merged[p] = merged.get(p, 0) + c
    return list(merged.items())


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pattern places that pieces of a length take by rank."""
    out, taken, base = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            at = taken.get(length, 0)
            out.append((length, at, at + count, base, offset))
            taken[length] = at + count
            offset += length
        base += count
    return out


def ranked(df: DataFrame, by: str, order: list[str], rows_each: int = 100_000) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... among the rows of equal ``by``. Buckets by a hash of the order columns keep every group small."""
    n = df.count()
    width = max(16, n // rows_each)
    mixed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(width)).cast("int"))
    counts = mixed.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), (F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = mixed.withColumn("_inside", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1)
    joined = inside.join(before, (F.col(by) == F.col("_by")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("rank", F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_by", "_b", "_before")


def pack(cut: DataFrame, id_col: str = "doc_id", max_len: int = 1024) -> DataFrame:
    """Pieces (stored, as they are read three times) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_len rows
    slots = spark.createDataFrame(places(pack_histogram(histogram, max_len)), "p_length long, p_first long, p_end long, p_base long, p_offset long")
    # Pieces that agree in all of these columns are alike, so that it doesn't matter which comes first if a lost task runs again.
    at = ranked(cut, "length", [c for c in cut.columns if c != "length"])
    # Places: their number is bounded by max_len alone, whatever the number of pieces.
    found = at.join(F.broadcast(slots), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_end")))
    return found.select(*cut.columns, (F.col("p_base") + F.col("rank") - F.col("p_first")).alias("sequence_id"), F.col("p_offset").alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row per piece: (id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset)."""
    return pack(stored(pieces(df, tokenizer, id_col, text_col, max_len, end_id, keep_ids), "pieces"), id_col, max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed pieces that keep their ids: a sequence's pieces in the order of their offsets, unpadded."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", "length", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
