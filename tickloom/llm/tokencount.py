"""Token counts by overlap resynchronisation.

A text up to ``chunk`` characters is encoded in one call. A longer one is cut into overlapping chunks, each encoded with character offsets, and neighbours are spliced at a boundary that both encodings have and that is proven stable; where the overlap has none, it is widened.

The proof comes from the vocabulary: byte-pair merging only ever produces pieces of the vocabulary, so no token can span two neighbouring characters that stand next to each other inside no piece. The text on either side of such a pair is encoded alike whatever stands on the other side. (The marker of a word's beginning counts as the space it stands for.)

Null text: empty, no tokens. Rows are handled one by one: repeated rows repeat, null ids stay, other columns aren't read. A text without any stable boundary is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8

CHUNK = 16_384
OVERLAP = 256


class PieceCounter:
    """Encodes with a sentencepiece model; ``pairs`` holds the character pairs that some piece joins."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pairs: set[str] = set()
        for i in range(self.sp.get_piece_size()):
            if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i)):
                piece = self.sp.id_to_piece(i).replace("▁", " ")
                self.pairs.update(a + b for a, b in zip(piece, piece[1:]))
        joined = set("".join(self.pairs))
        self.lead = next(c for c in "\n\t\x01\x02\x03" if c not in joined)
        self.lead_tokens = len(self.sp.encode(self.lead))
        # Splicing needs a model that leaves texts as they are but for the marker in front.
        self.exact = all(self.sp.normalize(x) == "▁" + x.replace(" ", "▁") for x in ("a  b", " a ", "ﬁé\n\tz"))

    def stable(self, text: str, at: int) -> bool:
        """Whether no token can span the boundary before ``text[at]``."""
        return 0 < at < len(text) and text[at - 1 : at + 1].replace("▁", " ") not in self.pairs

    def encoded(self, text: str, start: int, end: int):
        """The pieces of ``text[start:end]`` with byte offsets, and how many of them (and bytes) come from the lead.

        Inside a text, the marker that the library puts in front must not change the part's first token: ``lead``, a character that no piece joins to another, goes between them.
        """
        if start == 0:
            return self.sp.encode(text[:end], return_type="proto").pieces, 0, 0
        return self.sp.encode(self.lead + text[start:end], return_type="proto").pieces, self.lead_tokens, len(self.lead)

    def ends(self, pieces, size: int, text: str, begin: int, end: int) -> dict[int, int]:
        """Character position of each token's end inside ``text[begin:end]``, the tail of what was encoded -> tokens up to there. ``size``: bytes of what was encoded."""
        place, first = {}, size - len(text[begin:end].encode())
        if text[begin:end].isascii():
            place = {first + k: begin + k for k in range(end - begin + 1)}
        else:
            at = first
            for k in range(begin, end):
                place[at] = k
                at += len(text[k].encode())
            place[at] = end
        out, n = {}, len(pieces)
        while n and (e := pieces[n - 1].end) >= first:
            if e in place and (n == len(pieces) or pieces[n].end > e):
                out[place[e]] = n
            n -= 1
        return out

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk or not self.exact:
            return len(self.sp.encode(text))
        return sum(n for _, n in self.parts(text, chunk, overlap))

    def parts(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
        """(first character, tokens) of the spliced parts, which cover the text without gaps.

        A chunk's tokens count from the splice with the one before to the splice with the next. A chunk's last tokens may be wrong, and so may the first ones of the next chunk, which begins ``overlap`` characters before this one's end; the splice is the last boundary inside the overlap that both have and that is stable.
        """
        out, start, end = [], 0, min(len(text), chunk)
        while end < len(text):
            pieces, lead, lead_bytes = self.encoded(text, start, end)
            size, wide, cut = lead_bytes + len(text[start:end].encode()), overlap, -1
            while cut < 0:
                begin = max(start + 1, end - wide)
                left = self.ends(pieces, size, text, begin, end)
                stop = min(len(text), end + overlap)
                other = self.sp.encode(text[begin:stop], return_type="proto").pieces
                right = self.ends(other, len(text[begin:stop].encode()), text, begin, stop)
                cut = max((x for x in left if x in right and begin < x < end and self.stable(text, x)), default=-1)
                if cut < 0 and begin == start + 1:
                    break
                wide *= 2  # alignment failed: a wider overlap
            if cut < 0:
                end = min(len(text), start + 2 * (end - start))  # no boundary in all of the chunk: one twice as long
                continue
            out.append((start, left[cut] - lead))
            start, end = cut, min(len(text), cut + chunk)
        pieces, lead, _ = self.encoded(text, start, end)
        return [*out, (start, len(pieces) - lead)]


@lru_cache(4)
def counter(model: str) -> PieceCounter:
    return PieceCounter(model)


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_parts) for every row. ``model``: a file that the executors have."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            raw = b.column(1).to_pylist()
            texts = [x.decode("utf-8", "replace") for x in raw]
            parts = [1 if len(t) <= chunk or not c.exact else 0 for t in texts]
            whole = c.sp.encode([t for t, p in zip(texts, parts) if p], num_threads=1)
            counts, at = [], 0
            for k, t in enumerate(texts):
                if parts[k]:
                    counts.append(len(whole[at]))
                    at += 1
                else:
                    spliced = c.parts(t, chunk, overlap)
                    parts[k] = len(spliced)
                    counts.append(sum(n for _, n in spliced))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(parts, pa.int32())], names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_parts"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), utf8(text_col).alias("b")).mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean, n_parts int")
