"""Repeated passages in a set of byte strings: block-wise Burrows-Wheeler transforms of shards, merged by interleave refinement.

The alphabet is the blocks of ``BLOCK`` bytes, taken at every position and ordered by a hash; a window of ``WIDTH`` bytes is ``WIDTH / BLOCK`` symbols. A shard's transform lists, in the order of its sorted suffixes, the symbol before each suffix. Merging keeps only an interleave: which shard the next suffix comes from. Each pass reads the interleave in order, takes the next symbol of the shard it names, and deals the shard's number into that symbol's bucket; after k passes the interleave is right to k symbols, and neighbours whose symbols and former intervals agree share k symbols. A border between intervals stays where it is in all further passes, so the pass in which it appears tells the common prefix of the suffixes at it. After ``WIDTH / BLOCK`` passes, runs of common prefixes of that many symbols are the repeated windows. No suffix of a shard is sorted again.
"""

from __future__ import annotations

import numpy as np

WIDTH, BLOCK = 100, 20


def mix32(h: np.ndarray) -> np.ndarray:
    h = h * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(15))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of the ``size`` bytes from each position (len(data) - size + 1 of them), by doubling."""
    h = mix32(data.astype(np.uint32) + np.uint32(0x9E3779B9))
    done, parts, at = 1, [], 0
    while done <= size:
        if size & done:
            parts.append((h, at))
            at += done
        if 2 * done > size:
            break
        h = mix32(h[:-done] * np.uint32(0xC2B2AE35) + (h[done:] ^ np.uint32(done * 0x27D4EB2F & 0xFFFFFFFF)))
        done *= 2
    n = len(data) - size + 1
    out = None
    for part, at in parts:
        piece = part[at : at + n]
        out = piece.copy() if out is None else mix32(out * np.uint32(0xC2B2AE35) + (piece ^ np.uint32(0x165667B1)))
    return out


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """Stable sorting permutation of unsigned 32-bit symbols, by two passes over 16 bits each (which numpy sorts by counting)."""
    low = np.argsort((symbols & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    return low[np.argsort((symbols[low] >> np.uint32(16)).astype(np.uint16), kind="stable")]


class Shard:
    """One text's suffixes in full order. ``order``: their positions; ``before``: the symbol in front of each (the transform); ``has``: whether there is one."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        short = min(n, BLOCK)  # suffixes of a block or less: they sort before the others of their symbol, by position, and equal none
        start = np.concatenate([np.arange(n - short, n), np.arange(n - short)])
        order = start[stable_order(symbols[start])]
        new, is_short = np.ones(n, bool), order >= n - short
        new[1:] = (symbols[order][1:] != symbols[order][:-1]) | is_short[1:] | is_short[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step = BLOCK
        while not new.all():
            key = rank << np.int64(32)
            key[: n - step] |= rank[step:]
            order = np.argsort(key)
            sorted_key = key[order]
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            rank[order] = np.cumsum(new)
            step *= 2
        self.order = order.astype(np.int32)
        self.has = self.order >= BLOCK
        self.before = symbols[np.maximum(self.order - BLOCK, 0)]
        #: No suffix deals out those of a block or less; they open their buckets.
        self.last = symbols[n - short :]
        self.n = n


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common): in merged order, each suffix's shard and how many symbols it shares with the suffix before it, ``WIDTH / BLOCK`` at most."""
    sizes = np.array([s.n for s in shards])
    kind = np.uint8 if len(shards) < 256 else np.uint16
    z = np.repeat(np.arange(len(shards), dtype=kind), sizes)
    interval, common = np.zeros(len(z), np.int64), np.full(len(z), WIDTH // BLOCK, np.int8)
    every = np.concatenate([s.before for s in shards])
    has = np.concatenate([s.has for s in shards])
    tail_symbols = np.concatenate([s.last for s in shards])
    tail_z = np.repeat(np.arange(len(shards), dtype=kind), [len(s.last) for s in shards])
    for turn in range(WIDTH // BLOCK):
        taken = np.argsort(z, kind="stable")  # where each shard's suffixes lie, in its own order
        symbols, there = np.empty(len(z), np.uint32), np.empty(len(z), bool)
        symbols[taken], there[taken] = every, has
        # Short suffixes first: they sort before all others of their bucket.
        s = np.concatenate([tail_symbols, symbols[there]])
        zz = np.concatenate([tail_z, z[there]])
        was = np.concatenate([np.full(len(tail_z), -1), interval[there]])
        to = stable_order(s)
        z, s, was = zz[to], s[to], was[to]
        new = np.empty(len(z), bool)
        new[:1] = True
        new[1:] = (s[1:] != s[:-1]) | (was[1:] != was[:-1]) | (was[1:] < 0)
        interval = np.cumsum(new)
        common[new & (common > turn)] = turn
    return z, common


def repeated(regions: list[bytes], place: np.ndarray, shard_bytes: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``WIDTH`` bytes that also begin at a smaller place. ``regions``: byte strings; ``place``: sort keys, (region, 3) of which (document, 0, first byte), unique in total. Returns (region, offset) of each."""
    if not regions:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(r) for r in regions])
    shard_of = (np.cumsum(lengths) - 1) // shard_bytes
    shard_of = np.unique(shard_of, return_inverse=True)[1]
    starts = np.searchsorted(shard_of, np.arange(shard_of[-1] + 2))
    shards, base, datas = [], [], []
    for a, b in zip(starts[:-1], starts[1:]):
        data = np.frombuffer(b"".join(regions[a:b]) + b"\0" * BLOCK, np.uint8)  # no window reaches a shard's last block
        padded = np.concatenate([data, np.zeros(BLOCK - 1, np.uint8)])
        shards.append(Shard(gram_hashes(padded, BLOCK)))
        datas.append(data)
        base.append(len(data))
    z, common = merge(shards)
    interval = np.cumsum(common < WIDTH // BLOCK)
    offset = np.cumsum(base) - base
    position = np.empty(len(z), np.int64)
    position[np.argsort(z, kind="stable")] = np.concatenate([s.order + o for s, o in zip(shards, offset)])
    del shards
    room = lengths.copy()
    room[starts[1:] - 1] += BLOCK
    first = np.cumsum(room) - room
    owner = np.repeat(np.arange(len(regions)), room)[position]
    inside = position - first[owner]
    valid = inside + WIDTH <= lengths[owner]
    position, interval, owner, inside = position[valid], interval[valid], owner[valid], inside[valid]
    if not len(position):
        return owner, inside
    many = np.empty(len(interval), bool)  # in an interval of two or more
    many[:] = False
    same = interval[1:] == interval[:-1]
    many[1:] |= same
    many[:-1] |= same
    position, interval, owner, inside = position[many], interval[many], owner[many], inside[many]
    if not len(position):
        return owner, inside
    heads = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    # A window's own place, as one number: its region's rank among the (document, version), then its byte.
    documents = np.unique(place[:, :2], axis=0, return_inverse=True)[1].reshape(-1)
    byte = place[owner, 2] + inside
    key = documents[owner].astype(np.int64) * (int(byte.max()) + 1) + byte
    least = np.minimum.reduceat(key, heads)
    group = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(key)]])))
    is_first = key == least[group]
    # Symbols are hashes: what is taken for equal is compared byte by byte with the window it repeats.
    data = np.concatenate([*datas, np.zeros(WIDTH, np.uint8)])
    model = np.zeros(len(heads), np.int64)
    model[group[is_first]] = position[is_first]
    again = np.flatnonzero(~is_first)
    right = np.ones(len(again), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    for at in range(0, len(again), 50_000):
        some = again[at : at + 50_000]
        right[at : at + 50_000] = (windows[position[some]] == windows[model[group[some]]]).all(1)
    wrong = np.unique(group[again[~right]])
    flagged = again[right]
    if len(wrong):  # two windows of one hash: those intervals are told apart by their bytes
        extra = []
        flagged = flagged[~np.isin(group[flagged], wrong)]
        for g in wrong.tolist():
            members = np.flatnonzero(group == g)
            seen: set[bytes] = set()
            for m in members[np.argsort(key[members], kind="stable")].tolist():
                w = windows[position[m]].tobytes()
                if w in seen:
                    extra.append(m)
                seen.add(w)
        flagged = np.concatenate([flagged, np.array(extra, np.int64)])
    return owner[flagged], inside[flagged]
