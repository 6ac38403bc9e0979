"""Parts that need no cluster: round trips and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import chat, licenses, media, mergedrop, packing, passages, pivots, shingles, suffixes, tokencount, toxicity
from tickloom.llm.queries import tokenizer_path


def test_suffixes_against_brute_force():
    random.seed(3)
    for _ in range(12):
        base = [bytes(random.choices(b"abc", k=300)) for _ in range(3)]
        regions, place = [], []
        for k in range(random.randint(1, 40)):
            b, i = random.choice(base), random.randint(0, 150)
            r = bytearray(b[i : i + random.randint(100, 150)])
            if random.random() < 0.5:
                r[random.randrange(len(r))] = random.choice(b"abc")
            regions.append(bytes(r))
            place.append((random.randint(0, 5), 0, 1000 * k))
        own, at = suffixes.repeated(regions, np.array(place), shard_bytes=random.choice([300, 1000, 1 << 19]))
        seen, want = set(), set()
        for _, _, r, o in sorted((place[r][:2], place[r][2] + o, r, o) for r, x in enumerate(regions) for o in range(len(x) - 99)):
            w = regions[r][o : o + 100]
            if w in seen:
                want.add((r, o))
            seen.add(w)
        assert set(zip(own.tolist(), at.tolist())) == want
    assert len(suffixes.repeated([], np.zeros((0, 3), np.int64))[0]) == 0


def test_merge_equals_sorting():
    rng = np.random.default_rng(1)
    shards = [rng.integers(0, 2, n).astype(np.uint8) for n in (150, 170, 130)]
    shards[1] = np.concatenate([shards[0][:120], shards[1]])
    symbols = [suffixes.gram_hashes(np.concatenate([x, np.zeros(suffixes.BLOCK - 1, np.uint8)]), suffixes.BLOCK) for x in shards]
    built = [suffixes.Shard(s) for s in symbols]
    z, common = suffixes.merge(built)
    taken, got = [0] * 3, []
    for j in z.tolist():
        got.append((j, int(built[j].order[taken[j]])))
        taken[j] += 1
    key = lambda j, p: [int(x) for x in symbols[j][p :: suffixes.BLOCK][:5]]
    keys = [key(j, p) for j, p in got]
    assert keys == sorted(key(j, p) for j in range(3) for p in range(len(symbols[j])))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert all(common[k] == shared(keys[k - 1], keys[k]) for k in range(1, len(keys)) if len(keys[k - 1]) == len(keys[k]) == 5)
    assert max(common) == 5 and passages.BUCKET_BYTES >= 4 * passages.SHARD  # several shards in a bucket


def test_windows_sent_on():
    random.seed(9)
    base = bytes(random.choices(b"abc", k=400))
    texts = [base[i : i + random.randint(90, 160)] for i in (random.randrange(240) for _ in range(60))]
    doc = np.array([random.randrange(20) for _ in texts])
    start = np.arange(len(texts)) * 1000
    own, inside, key, sent = passages.distinct_windows(doc, np.zeros(len(texts), np.int64), start, texts)
    rows = sorted((doc[o], start[o] + i, texts[o][i : i + 100], k, s) for o, i, k, s in zip(own.tolist(), inside.tolist(), key.tolist(), sent.tolist()))
    assert len(rows) == sum(max(0, len(t) - 99) for t in texts)
    seen = {}
    for _, _, w, k, s in rows:
        assert s == (w not in seen) and seen.setdefault(w, k) == k
    assert all(len(x) == 0 for x in passages.distinct_windows(doc[:0], doc[:0], doc[:0], []))


def test_regions_hold_every_window_once():
    random.seed(5)
    texts = [bytes(random.choices(b"ab ", k=n)) for n in (0, 99, 100, 101, 350, 1000)] + [b"x" * 300]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    first, end, anchor, region = passages.regions_of(data, ends)
    windows = sorted(w for a, b in zip(first.tolist(), end.tolist()) for w in range(a, b - 99))
    want = [s + k for s, t in zip(ends - [len(t) for t in texts], texts) for k in range(len(t) - 99)]
    assert windows == sorted(want)
    assert passages.whole_characters("aéé".encode(), [(2, 4)]) == []
    assert passages.whole_characters("aéé".encode(), [(1, 4)]) == [(1, 3)]


@pytest.fixture(scope="module")
def counter():
    return tokencount.counter(tokenizer_path("piece_bpe_32k.model"))


def test_token_counts_with_small_chunks(counter):
    random.seed(2)
    parts = [*" \n\tabé中😀", "  ", "the ", "ing", "<s>", "▁", "%%", "-"]
    for _ in range(400):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 300)))
        assert counter.count(text, random.randint(10, 60), random.randint(1, 20)) == len(counter.sp.encode(text)), text
    assert counter.count("") == 0
    assert counter.count("ab" * 3000, 500, 10) == len(counter.sp.encode("ab" * 3000))
    spans = counter.parts("word and more words " * 200, 300, 20)
    assert spans[0][0] == 0 and len(spans) > 5


def plain_agenda(coder, key, text, seed, dropout):
    """Ids word by word, by the plain agenda, with the keys that the operator documents."""
    skip = min(int(dropout * (1 << 32)), (1 << 32) - 1)
    own, out = mergedrop.mixed((key * mergedrop.GOLDEN ^ seed) & mergedrop.MASK), []
    for place, word in enumerate(mergedrop.SPACES.findall(" " + text) if text else []):
        for s in coder.segment(word, mergedrop.mixed(own + place * mergedrop.GOLDEN & mergedrop.MASK), skip):
            out += [s] if s < coder.other else [int(coder.byte_ids[b]) for b in chr(s - coder.other).encode()]
    return out


def test_merge_dropout(monkeypatch):
    coder = mergedrop.merge_coder(tokenizer_path("piece_bpe_32k.model"))
    sp = tokencount.counter(tokenizer_path("piece_bpe_32k.model")).sp
    random.seed(4)
    texts = ["".join(random.choice([*" \n\tabé中st.,9<>😀", "  ", " the", "ing"]) for _ in range(random.randint(0, 80))) for _ in range(300)] + ["", " ", "  ", "   a  ", "a▁b ▁", "x" * 400, "ing" * 30]
    keys = list(range(len(texts)))
    plain = coder.encode(keys, texts)
    assert all(a.tolist() == sp.encode(t) for a, t in zip(plain, texts) if "▁" not in t)
    for dropout in (0.0, 0.1, 0.3, 1.0):
        got = coder.encode(keys, texts, 7, dropout)
        assert all(a.tolist() == plain_agenda(coder, k, t, 7, dropout) for k, a, t in zip(keys, got, texts))
        assert all(coder.decode(a.tolist()) == t.encode() for a, t in zip(got, texts))
    other = coder.encode(keys, texts, 8, 0.3)
    one = coder.encode(keys, texts, 7, 0.3)
    assert any(a.tolist() != b.tolist() for a, b in zip(one, other)) and any(len(a) > len(b) for a, b in zip(one, plain))
    # A frequent word gets far more segmentations than a handful, and lots and parts don't matter.
    word, times = " understanding", 3000
    many = coder.encode([1], [(word * times)[1:]], 5, 0.3)[0].tolist()
    kinds, at = set(), 0
    for n in range(times):
        own = plain_agenda(coder, 1, (word * (n + 1))[1:], 5, 0.3)[at:] if n < 3 else None
        end, text = at, b""
        while len(text) < len(word):
            text += coder.raw[many[end]]
            end += 1
        assert own is None or own == many[at:end]
        kinds.add(tuple(many[at:end]))
        at = end
    assert at == len(many) and len(kinds) > 20
    long = " ".join(texts)
    whole = coder.encode([5], [long], 1, 0.2)[0].tolist()
    monkeypatch.setattr(mergedrop, "LOT", 300)
    assert coder.encode([5], [long], 1, 0.2)[0].tolist() == whole


def test_byte_tokens_and_packing():
    tok = packing.byte_tokens(tokenizer_path("byte_bpe_50k.json"))
    random.seed(6)
    texts = ["".join(random.choice([*" \n\tabé中'st.,9<|>", "<|endoftext|>", " the", "'re", "　"]) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    assert tok.coder is not None  # the file is a plain byte-level BPE
    texts += ["", "ab" * 50_000, "\n" * 20_000 + "x", " " * (packing.BLANK - 1) + "z", "x" + "　" * packing.BLANK + "y", " \n" * 3000 + "<|endoftext|>", "".join(map(chr, range(0x20, 0x2000))), "漢字" * 20_000]
    assert all(a.tolist() == tok.whole(t) for a, t in zip(tok.encode(texts), texts))
    histogram = {n: random.randint(1, 50) for n in random.sample(range(1, 1025), 300)} | {1024: 7}
    patterns = packing.pack_histogram(histogram, 1024)
    placed = Counter()
    for p, n in patterns:
        assert sum(p) <= 1024
        for length in p:
            placed[length] += n
    assert dict(placed) == histogram
    total, padding = sum(k * n for k, n in histogram.items()), sum((1024 - sum(p)) * n for p, n in patterns)
    assert padding < 0.02 * total
    assert packing.pack_histogram({}, 1024) == []
    slots = packing.places(patterns)
    for length, n in histogram.items():
        own = sorted((a, b) for k, a, b, _, _ in slots if k == length)
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))


def test_matroska():
    rng = np.random.default_rng(3)
    for n in (64, 512, 513 * 8, 70_000, 300_032):
        samples = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        m = media.mux(samples)
        p = media.parse(m)
        assert not p.error and b"".join(m[a : a + k] for _, _, a, k, *_ in p.packets) == samples
        assert p.tracks[1]["codec"] == "A_PCM/INT/LIT" and p.tracks[1]["bits"] == 8
        stamps = [x[1] for x in p.packets]
        assert stamps == sorted(stamps) and len(p.cues) == math.ceil(n / (512 * 8 * 16))
    assert media.parse(b"").error and media.parse(b"\x1a\x45\xdf\xa3\xff").packets == []
    m = media.mux(b"a" * 5000)
    assert media.parse(m[:-300]).error
    assert media.payload_of(b"") == b"\0" * 64 and len(media.payload_of(b"x" * 64)) == 64 and len(media.payload_of(b"x" * 65)) == 128


def test_matroska_lacings_and_unknown_sizes():
    E, u = media._element, media._uint
    frames = [b"a" * 300, b"b" * 10, b"c" * 700]
    xiph = b"\x02" + b"\xff\x2d" + b"\x0a" + b"".join(frames)
    kind, ebml = media._lace(frames)
    assert kind == media.EBML_LACING
    block = lambda flags, data: b"\x81\x00\x05" + bytes([flags]) + data
    head = E(media.EBML, E(media.DOC_TYPE, b"webm"))
    cluster = lambda t, body: media._id(media.CLUSTER) + b"\xff" + u(media.TIMESTAMP, t) + body
    data = head + media._id(media.SEGMENT) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + cluster(10, E(media.SIMPLE_BLOCK, block(0x02, xiph))) + cluster(20, E(media.BLOCK_GROUP, E(media.BLOCK, block(0x06, ebml)))) + cluster(30, E(media.SIMPLE_BLOCK, block(0x80, b"z")))
    p = media.parse(data)
    assert not p.error and [data[a : a + k] for _, _, a, k, *_ in p.packets] == frames * 2 + [b"z"]
    assert [x[1] // 1_000_000 for x in p.packets] == [15] * 3 + [25] * 3 + [35]


def test_matroska_damaged():
    nested = media._element(media.EBML, b"") + (media._id(media.SEGMENT) + b"\x01\xff\xff\xff\xff\xff\xff\xff") * 3000
    assert "deep" in media.parse(nested).error
    E, u = media._element, media._uint
    block = E(media.SIMPLE_BLOCK, b"\x81\x00\x00\x80x")
    late = E(media.EBML, b"") + E(media.SEGMENT, E(media.CLUSTER, u(media.TIMESTAMP, 1) + block + E(media.TIMESTAMP, b"\xff" * 8) + block))
    p = media.parse(late)
    assert len(p.packets) == 1 and "timestamp" in p.error
    rng = random.Random(8)
    whole = media.mux(bytes(rng.randrange(256) for _ in range(9000)))
    for n in range(10_000):
        b = bytearray(whole[: rng.choice([len(whole), rng.randrange(len(whole))])])
        for _ in range(rng.randint(1, 4)):
            if b:
                b[rng.choice([rng.randrange(len(b)), rng.randrange(min(len(b), 300))])] = rng.randrange(256)
        p = media.parse(bytes(b))
        assert isinstance(media.features(bytes(b), p), str)
        assert all(-(2**63) <= x[1] < 2**63 and 0 <= x[2] <= x[2] + x[3] <= len(b) for x in p.packets)


def test_matroska_block_groups():
    E, u = media._element, media._uint
    block = lambda t: E(media.BLOCK, b"\x81" + t.to_bytes(2, "big") + b"\x00x")
    group = lambda *parts: E(media.BLOCK_GROUP, b"".join(parts))
    cluster = E(media.CLUSTER, u(media.TIMESTAMP, 0) + group(block(0), u(media.BLOCK_DURATION, 40)) + group(E(media.REFERENCE_BLOCK, b"\xd8"), block(40), u(media.BLOCK_DURATION, 20)) + group(block(60)))
    p = media.parse(E(media.EBML, b"") + E(media.SEGMENT, cluster))
    assert not p.error and [(x[1], x[4], x[6]) for x in p.packets] == [(0, True, 40_000_000), (40_000_000, False, 20_000_000), (60_000_000, True, None)]


def test_chat_spans_and_rewriting():
    turns = [("user", "hi ### x </turn>\\"), ("assistant", ""), ("a: b", "\n"), ("assistant", "\\### Assistant: </turn> ok")]
    r, out = chat.Renderer(chat.MARKED), []
    for role, text in turns:
        t = r.add(role, text)
        assert not t.rewrites and chat.MARKED.read(t.span) == (role, text)
        assert chat.unescape(t.span[t.inside[0] : t.inside[1]]) == text
        out.append(t.span)
    assert "".join(out) == chat.render_marked([{"role": a, "text": b} for a, b in turns])
    short = chat.Renderer(chat.MARKED, 2)
    assert [short.add(a, b).span for a, b in turns] == out
    counted = chat.Template(lambda ms: f"{len(ms)} turns\n" + chat.render_marked(ms), chat.unescape, chat.read_marked)
    r = chat.Renderer(counted)
    assert [r.add("u", "x").rewrites for _ in range(3)] == [True, True, True]


def test_chat_whole_prefixes():
    render = lambda ms: "".join(f"[{k}] {m['text']}\n" for k, m in enumerate(ms, 1))
    r = chat.Renderer(chat.Template(render, str, lambda s: ("", s)))
    assert [r.add("u", "x").span for _ in range(140)] == [f"[{k}] x\n" for k in range(1, 141)]
    cut = chat.Renderer(chat.Template(render, str, lambda s: ("", s)), 64)
    with pytest.raises(ValueError, match="whole prefixes"):
        for _ in range(65):
            cut.add("u", "x")
    # A template that reads the first message rewrites nothing, one that reads their number does, at any length.
    first = chat.Renderer(chat.Template(lambda ms: "".join(m["text"] + ms[0]["role"] for m in ms), str, lambda s: ("", s)))
    assert [first.add(f"r{k}", "x").span for k in range(100)] == ["xr0"] * 100
    many = chat.Renderer(chat.Template(lambda ms: ("long " if len(ms) > 70 else "") + "".join(m["text"] for m in ms), str, lambda s: ("", s)))
    assert [k for k in range(100) if many.add("u", "x").rewrites] == [70]
    # The last turn carries a mark: each turn takes it off the one before.
    r = chat.Renderer(chat.Template(lambda ms: "".join(m["text"] + ";" for m in ms) + ("!" if ms else ""), str, lambda s: ("", s)))
    turns = [r.add("u", "ab") for _ in range(3)]
    assert [(t.span, t.rewrites, t.lost) for t in turns] == [("ab;!", False, 0), ("ab;!", True, 1), ("ab;!", True, 1)]


def test_toxicity_learns_subwords():
    random.seed(1)
    words = ["".join(random.choice(["ka", "lo", "mi", "tu", "re", "so"]) for _ in range(random.randint(1, 4))) for _ in range(300)]
    texts, y = [], []
    for k in range(400):
        own = random.choices(words, k=60)
        if k % 4 == 0:
            own[random.randrange(60)] = random.choice(["blockhead", "nitwit", "scoundrel"])
        texts.append(" ".join(own))
        y.append(int(k % 4 == 0))
    model = toxicity.train([toxicity.bag(t) for t in texts], np.array(y), epochs=40)
    score = lambda t: toxicity.scores(model, [t])[0]
    plain = " ".join(random.choices(words, k=60))
    assert score(plain + " blockhead") > 0.5 > score(plain)
    assert score(plain + " bl0ckhead") > score(plain) and score(plain + " scoundrels!") > 0.3
    assert score(plain + ' "BLOCKHEAD"! \u3000—') == pytest.approx(score(plain + " blockhead"), abs=1e-12)
    assert 0 <= score("") == score(" \n -- ?") <= 1
    assert toxicity.train([], np.zeros(0, int)).score(0, 0) == 0.5
    assert toxicity.train([toxicity.bag("a")], np.array([1])).score(0, 0) > 0.99


def test_toxicity_features_by_hand(monkeypatch):
    """Lots and parts against one word at a time."""
    random.seed(2)
    texts = ["", "a", "Äpfel und Birnen, (don't) – 12.5 % \n\t ok", "x" * 300, "éé ééé. ÉÉ!", "名前 です"] + [" ".join("".join(random.choices("abcdé.", k=random.randint(1, 9))) for _ in range(random.randint(0, 60))) for _ in range(80)]

    def plain(text):
        out = Counter()
        for w in text.lower().split():
            w = w.strip(toxicity.EDGE)
            if any(map(str.isalnum, w)):
                m = f"<{w}>"
                out.update([m] + [m[i : i + n] for n in toxicity.NGRAMS for i in range(len(m) - n + 1) if n < len(m)])
        return out

    rng = np.random.default_rng(3)
    for t in texts:
        ids, counts = toxicity.bag(t)
        want = Counter()
        for part, n in plain(t).items():
            want[zlib.crc32(part.encode()) % toxicity.BUCKETS] += n
        assert dict(zip(ids.tolist(), counts.tolist())) == want
    model = toxicity.Model(rng.normal(size=1 << 12), 0.1)
    want = toxicity.scores(model, texts)
    for t, s in zip(texts, want):
        ids, counts = toxicity.bag(t, 1 << 12)
        assert s == pytest.approx(model.score(float(model.weights[ids] @ counts), int(counts.sum())))
    monkeypatch.setattr(toxicity, "LOT", 50)
    monkeypatch.setattr(toxicity, "PART", 7)
    assert toxicity.scores(model, texts) == pytest.approx(want)
    long = " ".join(texts)
    assert toxicity.parts_of(long) != [long] and toxicity.scores(model, [long])[0] == pytest.approx(model.score(sum(float(model.weights[i] @ c) for i, c in (toxicity.bag(t, 1 << 12) for t in texts)), sum(int(toxicity.bag(t, 1 << 12)[1].sum()) for t in texts)))


def test_jaccard_parts():
    a = shingles.shingle_set("a b c d e f g")
    assert len(a) == 3 and len(shingles.shingle_set("")) == 0 and len(shingles.shingle_set("x y")) == 1
    assert not np.isin(shingles.shingle_set("a b"), shingles.shingle_set("a b c")).any()
    assert shingles.runs_for(0.99999, 0.8, 3) >= shingles.runs_for(0.99, 0.8, 3) > 0
    random.seed(2)
    base = [str(random.random()) for _ in range(200)]
    near = base[:100] + ["new"] + base[101:]
    x, y = shingles.shingle_set(" ".join(base)), shingles.shingle_set(" ".join(near))
    agree = (shingles.sketch(x) == shingles.sketch(y)).mean()
    assert abs(agree - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.2
    far = np.array([10], np.int64)
    links, root = shingles.compared(10, np.zeros(3, int), True, [x, y, shingles.shingle_set("q w e r t")], np.array([1, 3, 1]), [far] * 3, 0.8)
    assert links.tolist() == [3, 1, 0] and root.tolist() == [0, 0, 2]
    links, _ = shingles.compared(10, np.zeros(2, int), True, [x, y], np.array([1, 1]), [np.array([4, 10])] * 2, 0.8)
    assert links.tolist() == [0, 0]  # they meet in node 4 already


def test_license_filter_is_exact():
    w = licenses.Weights()
    by = Counter()
    for k, _, word, x in w.vectors:
        if word not in w.needed:
            by[k] += x * x
    assert all(v < licenses.LEAST**2 for v in by.values())


def test_local_forest():
    got = pivots.local_forest(5, np.array([0, 3]), np.array([1, 1]), np.array([9, 5, 7, 1, 2]))
    assert got.tolist() == [3, 3, 2, 3, 4]


def test_held_out_rule():
    assert zlib.crc32(b"5") % 4 in range(4)
