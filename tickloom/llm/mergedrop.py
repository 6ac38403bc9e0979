"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Encoding follows the merge-type algorithm over a model's own vocabulary: an agenda of candidate merges, the best-scored first, of equals the leftmost. Each candidate, when its turn comes, is skipped with probability ``dropout`` by a keyed hash of (seed, text id, place of the word in its text, number of the candidate); so every occurrence of a word has a segmentation of its own, a seed always gives the same ones, and other seeds give others. With dropout 0 the ids are the library's.

No piece joins a space to a character before it, so a text is encoded word by word (a word begins with its spaces). Agendas run side by side over a lot of words in numpy: a round takes one candidate of each. Occurrences of a word share a row until a hash tells them apart; then the row is doubled. Words longer than the widest rows run one at a time. Nothing is remembered between lots, whose size is bounded, so memory doesn't grow with the vocabulary; a longer text is encoded in parts, cut between words.

Characters without a piece, and a literal word marker (U+2581), become byte pieces, so decoding always gives back the text's bytes.

Null text: empty, no tokens, decoded as the empty text. Rows are handled one by one: repeated rows repeat, null ids are kept, other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, bounded_batches, lean, utf8

#: Characters of text whose words are encoded side by side.
LOT = 4_000_000
#: Widths of the rows; longer words run one at a time.
WIDTHS = (6, 8, 10, 12, 16, 24, 40, 64)
MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15
SPACES = re.compile(r" *[^ ]+| +$")
#: Marks in rows: no candidate; a symbol that has been merged into the one before; beyond the word's end.
NONE, GONE, BEYOND = 2**31 - 1, -2, -3
U = np.uint64


def mixed(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def mixed_array(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


class Pairs:
    """(left piece, right piece) -> rank of their merge, as an open table for whole arrays."""

    def __init__(self, merges: dict[int, int]):
        keys, ranks = np.fromiter(merges.keys(), np.int64, len(merges)), np.fromiter(merges.values(), np.int32, len(merges))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, ranks, slot = keys[rest], ranks[rest], slot[rest] + 1 & len(self.keys) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(U) * U(GOLDEN) >> U(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << np.int64(32) | right.astype(np.int64)
        slot = self.slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], np.int32(NONE))
        further = np.flatnonzero((there != keys) & (there >= 0))
        while len(further):
            slot[further] = slot[further] + 1 & len(self.keys) - 1
            there = self.keys[slot[further]]
            hit = there == keys[further]
            out[further[hit]] = self.ranks[slot[further[hit]]]
            further = further[~hit & (there >= 0)]
        return out


class Agendas:
    """The agendas of words of at most ``width`` characters, a row each: symbols, the places of their neighbours, and the rank of each symbol's merge with the next. The last column lies beyond every word."""

    def __init__(self, coder: MergeCoder, symbols: np.ndarray):
        n, w = symbols.shape
        self.coder, self.n = coder, n
        self.symbols = symbols
        self.after = np.broadcast_to(np.minimum(np.arange(w) + 1, w - 1).astype(np.int8), (n, w)).copy()
        self.before = np.broadcast_to(np.where(np.arange(w), np.arange(w) - 1, w - 1).astype(np.int8), (n, w)).copy()
        self.ranks = np.full((n, w), NONE, np.int32)
        for k in range(w - 1):
            self.ranks[:, k] = coder.pairs.rank(symbols[:, k], symbols[:, k + 1])

    def doubled(self, rows: np.ndarray) -> np.ndarray:
        """New rows like ``rows``."""
        need = self.n + len(rows)
        for name in ("symbols", "after", "before", "ranks"):
            x = getattr(self, name)
            if need > len(x):
                grown = np.empty((max(need, len(x) * 5 // 4), x.shape[1]), x.dtype)
                grown[: self.n] = x[: self.n]
                x = grown
                setattr(self, name, x)
            x[self.n : need] = x[rows]
        new = np.arange(self.n, need)
        self.n = need
        return new

    def merge(self, rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        gone = self.after[rows, at]
        after, before = self.after[rows, gone], self.before[rows, at]
        made = self.coder.given[rank]
        self.symbols[rows, at], self.symbols[rows, gone] = made, GONE
        self.after[rows, at], self.before[rows, after] = after, at
        self.ranks[rows, gone] = NONE
        self.ranks[rows, at] = self.coder.pairs.rank(made, self.symbols[rows, after])
        self.ranks[rows, before] = self.coder.pairs.rank(self.symbols[rows, before], made)

    def run(self, row: np.ndarray, keys: np.ndarray, skip: int) -> np.ndarray:
        """Each occurrence's row in the end. ``row``: its row in the beginning; ``keys``: its key."""
        row, live, running, turn = row.copy(), np.arange(self.n), np.arange(len(row)), 0
        while len(live):
            at = self.ranks[live].argmin(1)
            rank = self.ranks[live, at]
            more = rank < NONE
            live, at, rank = live[more], at[more], rank[more]
            if skip and len(live):
                place = np.full(self.n, -1, np.int32)
                place[live] = np.arange(len(live))
                running = running[place[row[running]] >= 0]
                low = mixed_array(keys[running] + U(turn * GOLDEN & MASK)) >> U(32) < U(skip)
                skips, takes = np.zeros(len(live), bool), np.zeros(len(live), bool)
                skips[place[row[running[low]]]] = True
                takes[place[row[running[~low]]]] = True
                both, only = np.flatnonzero(skips & takes), np.flatnonzero(skips & ~takes)
                self.ranks[live[only], at[only]] = NONE
                new = self.doubled(live[both])
                self.ranks[new, at[both]] = NONE
                to = np.full(len(live), -1, np.int64)
                to[both], to[only] = new, live[only]
                row[running[low]] = to[place[row[running[low]]]]
                self.merge(live[takes], at[takes], rank[takes])
                live = np.concatenate([live, new])
            elif len(live):
                self.merge(live, at, rank)
            turn += 1
        return row

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each row in the end, how many)."""
        x = self.symbols[: self.n]
        kept = x >= 0
        return x[kept], kept.sum(1)


class MergeCoder:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids: dict[str, int] = {}
        self.byte_ids, self.raw = np.zeros(256, np.int64), [b""] * sp.get_piece_size()
        scores = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                if " " in text.lstrip(" "):
                    raise ValueError(f"piece {piece!r} goes over a word's end")
                self.ids[text], self.raw[i] = i, text.encode()
                scores[text] = sp.get_score(i)
        if any(sp.normalize(x) != "▁" + x.replace(" ", "▁") for x in ("a  b", " a ", "ﬁé\n\tz")):
            raise ValueError("the model doesn't leave texts as they are")
        # Best score first. A merge is known by the two pieces' numbers; its value is the rank of the piece that it gives.
        order = sorted((t for t in scores if len(t) > 1), key=lambda t: (-scores[t], self.ids[t]))
        self.given = np.array([self.ids[t] for t in order], np.int32)
        self.merges = {self.ids[t[:k]] << 32 | self.ids[t[k:]]: r for r, t in enumerate(order) for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.pairs = Pairs(self.merges)
        #: The symbol of each character: its piece, or ``other`` and its number.
        self.other = sp.get_piece_size()
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.other
        for t, i in self.ids.items():
            if len(t) == 1 and t != "▁":
                self.symbol[ord(t)] = i

    def segment(self, word: str, key: int = 0, skip: int = 0) -> list[int]:
        """Symbols of one word by a plain agenda. ``skip``: candidates whose 32 bits are below it are passed over."""
        n, merges, turn = len(word), self.merges, 0
        symbols = self.symbol[[ord(c) for c in word]].tolist()
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := merges.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i, j, stop = heapq.heappop(agenda)
            if end[i] != j or end[j] != stop:
                continue  # one of the two has been merged meanwhile
            turn += 1
            if skip and mixed(key + (turn - 1) * GOLDEN & MASK) >> 32 < skip:
                continue
            end[i], end[j] = stop, -1
            symbols[i] = made = int(self.given[r])
            if stop < n:
                prev[stop] = i
                if (r := merges.get(made << 32 | symbols[stop])) is not None:
                    heapq.heappush(agenda, (r, i, stop, end[stop]))
            if (p := prev[i]) >= 0 and (r := merges.get(symbols[p] << 32 | made)) is not None:
                heapq.heappush(agenda, (r, p, i, stop))
        out, at = [], 0
        while at < n:
            out.append(symbols[at])
            at = end[at]
        return out

    def bytes_of_others(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and how many of them each text has, with characters without a piece as byte pieces."""
        odd = flat >= self.other
        if not odd.any():
            return flat, lengths
        code = flat[odd] - self.other
        times = np.ones(len(flat), np.int64)
        times[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        ends = np.cumsum(np.concatenate([[0], times]))
        upto = np.cumsum(lengths)
        lengths = ends[upto] - ends[upto - lengths]
        flat, odd = np.repeat(flat, times), np.repeat(odd, times)
        flat[odd] = self.byte_ids[np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        return flat, lengths

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(words without their first space, how many each text has)."""
        plain = [t for t in texts if "  " not in t and t[:1] != " " and t[-1:] != " "]
        split = pc.split_pattern(pa.array([t for t in plain if t], pa.large_string()), " ")
        if len(plain) == len(texts):
            counts = np.zeros(len(texts), np.int64)
            counts[[k for k, t in enumerate(texts) if t]] = np.diff(split.offsets.to_numpy())
            return split.flatten(), counts
        lists, at = split.to_pylist(), iter(range(len(plain)))
        lists = [([] if not t else lists[next(at)] if "  " not in t and t[:1] != " " and t[-1:] != " " else [w[1:] for w in SPACES.findall(" " + t)]) for t in texts]
        return pa.array([w for x in lists for w in x], pa.large_string()), np.array([len(x) for x in lists], np.int64)

    def lot(self, keys: np.ndarray, texts: list[str], skip: int, first: int = 0) -> list[np.ndarray]:
        """Ids of each text. ``first``: the place of the first words."""
        words, counts = self.words(texts)
        if not len(words):
            return [np.zeros(0, np.int64) for _ in texts]
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary
        sizes = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)  # without the space
        chars = np.frombuffer("".join(names.to_pylist()).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts) + first
        own = mixed_array(np.repeat(keys, counts) + place.astype(U) * U(GOLDEN))
        # Each occurrence's ids: where they lie, and how many.
        begin, length, parts, base = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64), [], 0
        low = -1
        for width in (*WIDTHS, None):
            some = (sizes >= low) & (sizes < width) if width else sizes >= low
            low = width
            kinds = np.flatnonzero(some)
            if not len(kinds):
                continue
            number = np.full(len(sizes), -1, np.int64)
            number[kinds] = np.arange(len(kinds))
            at = np.flatnonzero(number[code] >= 0)
            if width:
                k = np.arange(width)[None, :] - 1
                inside = (k >= 0) & (k < sizes[kinds][:, None])
                symbols = np.full((len(kinds), width + 1), BEYOND, np.int32)
                symbols[:, :width][inside] = self.symbol[chars[(starts[kinds][:, None] + k)[inside]]]
                symbols[:, 0] = self.symbol[32]
                agendas = Agendas(self, symbols)
                row = agendas.run(number[code[at]], own[at], skip)
                flat, n = agendas.result()
            else:
                known: dict[int, int] = {}
                found, row = [], np.zeros(len(at), np.int64)
                for q, o in enumerate(at.tolist()):
                    c = int(code[o])
                    if skip or c not in known:
                        known[c] = len(found)
                        found.append(self.segment(" " + names[c].as_py(), int(own[o]), skip))
                    row[q] = known[c]
                flat, n = np.array([s for x in found for s in x], np.int32), np.array([len(x) for x in found], np.int64)
            parts.append(flat)
            begin[at], length[at] = (base + np.cumsum(n) - n)[row], n[row]
            base += len(flat)
        flat = np.concatenate(parts)
        total = np.cumsum(np.concatenate([[0], length]))
        each = np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
        out = flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])].astype(np.int64)
        out, each = self.bytes_of_others(out, each)
        return np.split(out, np.cumsum(each)[:-1])

    def encode(self, keys: list[int], texts: list[str], seed: int = 0, dropout: float = 0.0) -> list[np.ndarray]:
        """Ids of each text. ``keys``: a number for each text, from its id."""
        skip = min(int(dropout * (1 << 32)), (1 << 32) - 1)
        own = np.array([mixed((k * GOLDEN ^ seed) & MASK) for k in keys], U)
        out: list[np.ndarray] = []
        lot: list[str] = []
        size = 0
        for k, text in enumerate(texts):
            if lot and size + len(text) > LOT:
                out += self.lot(own[len(out) : k], lot, skip)
                lot, size = [], 0
            if len(text) > LOT:
                out.append(self.long(own[k : k + 1], text, skip))
            else:
                lot.append(text)
                size += len(text)
        return out + self.lot(own[len(out) :], lot, skip) if lot else out

    def long(self, key: np.ndarray, text: str, skip: int) -> np.ndarray:
        """Ids of a text that is longer than a lot: parts of it, cut at single spaces between words."""
        parts, start, place = [], 0, 0
        cuts = re.compile(r"(?<=[^ ]) (?=[^ ])")
        while start < len(text):
            found = cuts.search(text, start + LOT)
            part = text[start : found.start()] if found else text[start:]
            parts += self.lot(key, [part], skip, place)
            place += int(self.words([part])[1][0])
            start = found.end() if found else len(text)
        return np.concatenate(parts)

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes: those of the pieces, without the space that encoding puts in front."""
        return b"".join(map(self.raw.__getitem__, ids))[1:]


@lru_cache(2)
def merge_coder(model: str) -> MergeCoder:
    return MergeCoder(model)


def _keys(column: pa.Array) -> list[int]:
    return [zlib.crc32(str(v).encode()) for v in column.to_pylist()]


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """(id, n_bytes, ids array<int>) for every row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merge_coder(model)
        for b in batches:
            raw = b.column(1).to_pylist()
            ids = coder.encode(_keys(b.column(0)), [t.decode("utf-8", "replace") for t in raw], seed, dropout)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, "n_bytes", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), utf8(text_col).alias("b")).mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes long, ids array<int>")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of ids; null ids give the empty text. An id column named text comes out as kept_text."""
    bounded_batches(df.sparkSession)
    name = apart(id_col, ["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merge_coder(model)
        for b in batches:
            texts = [coder.decode(x).decode("utf-8", "replace") if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[name, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("i"), F.col(ids_col).alias("x")).mapInArrow(run, f"`{name}` {kind}, text string")


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """(id, n_bytes, n_tokens, ids_sha256, decoded_sha256, lossless): each text encoded, and decoded from those ids, in one pass. ids_sha256 is over little-endian unsigned 32-bit ids."""
    bounded_batches(df.sparkSession)
    names = [id_col, "n_bytes", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merge_coder(model)
        for b in batches:
            raw = b.column(1).to_pylist()
            ids = coder.encode(_keys(b.column(0)), [t.decode("utf-8", "replace") for t in raw], seed, dropout)
            back = [coder.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(t).hexdigest() for t in back]), pa.array([x == y for x, y in zip(raw, back)], pa.bool_())], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), utf8(text_col).alias("b")).mapInArrow(lean(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
