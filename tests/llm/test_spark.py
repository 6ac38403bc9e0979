"""The operators on small tables: brute force, nulls, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, licenses, media, mergedrop, packing, passages, pivots, shingles, tokencount, toxicity
from tickloom.llm.graph import components
from tickloom.llm.queries import PLANTED, tokenizer_path

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "né", "xi"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    passage = prose(rng, 40)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(5)]
    long = prose(rng, 100).split()
    for k in range(4):
        own = list(long)
        own[10 * k] = "changed"
        texts.append(" ".join(own))
    return [*texts, texts[3], texts[3], None, "", "é" * 120, "é" * 150, "one", "one"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}", 0 if t is None else len(t), "clash", 1.5) for k, t in enumerate(corpus())]
    rows.append((None, "a text without an id", "en", "src0", 3, "clash", 1.5))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, bucket string, score double").repartition(3).cache()


def removed_by_brute_force(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(w)
        out[i] = (len(b), sum(mark), hashlib.sha256(bytes(c for c, m in zip(b, mark) if not m)).hexdigest())
    return out


@pytest.mark.parametrize(("frequent", "often"), [(passages.FREQUENT, passages.OFTEN), (1, passages.OFTEN), (passages.FREQUENT, 1), (passages.FREQUENT, 0), (1, 0)])
def test_passages(docs, frequent, often):
    got = passages.repeated_spans(docs, frequent=frequent, often=often).collect()
    want = removed_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(got) == docs.count()
    for r in got:
        n = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], n, r["kept_sha256"]) == want[r["doc_id"]]


def test_passages_removed_from_rows(docs):
    out = passages.without_repeats(docs, keep=tuple(docs.columns))
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert 40 not in rows or rows[40]["text"] != corpus()[40]
    assert rows[0]["text"] == corpus()[0] and rows[0]["n_chars"] == len(corpus()[0])
    assert rows[41]["text"] is None and rows[42]["text"] == ""
    for r in rows.values():
        assert (r["n_chars"] or 0) == len(r["text"] or "") and (r["lang"], r["bucket"], r["score"]) == ("en", "clash", 1.5)
    assert passages.without_repeats(docs.limit(0), keep=tuple(docs.columns)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def test_shingle_join(docs):
    rows = [(r["doc_id"], (r["text"] or "").split()) for r in docs.collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in rows}
    want = {i: sum(1 for j in sets if j != i and jaccard(sets[i], sets[j]) >= 0.8) for i in sets}
    for limit, block in ((256, 1500), (2, 2)):
        got = {r["doc_id"]: r for r in shingles.join(docs, limit=limit, block=block).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == want
        assert got[39]["class_id"] == got[3]["class_id"] == 3 and got[39]["copy_of"] == 3 and not got[39]["kept"]
        assert got[41]["class_id"] == 41 and got[42]["class_id"] == 42  # empty texts link with nothing
    assert shingles.join(docs.limit(0)).count() == 0


def test_shingle_join_without_ids_and_with_shared_ids(docs, spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c = (prose(rng, 60) for _ in range(3))
    # Null ids must not join a's group with b's, nor may the two texts of id 5; c's group has no id at all.
    rows = [(1, a), (None, a + " tail"), (2, b), (None, b + " tail"), (5, a + " end"), (5, b + " end"), (None, c), (None, c + " tail"), (None, c), (9, None), (9, "")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in shingles.join(df).collect()), key=str)
    want = [(1, 1, 2, True), (None, 1, 2, False), (2, 2, 2, True), (None, 2, 2, False), (5, 1, 2, False), (5, 2, 2, False), (9, 9, 0, True), (9, 9, 0, True)]
    ours = [r for r in got if r[1] is not None]
    assert ours == sorted(want, key=str)
    alone = [r for r in got if r[1] is None]
    # One text of c's group is kept; if it is the one that comes twice, both of its rows are.
    assert [r[:3] for r in alone] == [(None, None, 2)] * 3 and sum(r[3] for r in alone) in (1, 2)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
    # Null text is the empty text, so the rows of id 9 are one row twice.
    assert len(kept) == 4 and {(1, a), (2, b)} <= set(kept) and sorted(i for i, _ in kept if i) == [1, 2, 9]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    rows += [(100 + k, [float(x) for x in base[0] + rng.normal(scale=0.08, size=16)]) for k in range(25)]
    rows += [(200 + k, rows[5][1]) for k in range(6)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [1.0, None] + [0.0] * 14), (305, rows[5][1][:8])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    x = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v)}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if len(a) == len(b) else 0
    want = {i: sum(1 for j in x if j != i and cos(x[i], x[j]) >= 0.95) if i in x else 0 for i, _ in rows}
    for block in (2000, 3):
        got = {r["vec_id"]: r for r in pivots.near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows)
        agree = sum(got[i]["n_links"] for i in want) / sum(want.values())
        assert 0.97 <= agree <= 1 and all(got[i]["n_links"] <= want[i] for i in want)
        assert got[203]["component_id"] == 5 and got[203]["n_links"] == 6 and got[300]["component_id"] == 300 and got[302]["kept"]
    floats = {r["vec_id"]: r for r in pivots.near_duplicates(df.withColumn("embedding", F.col("embedding").cast("array<float>"))).collect()}
    assert all(floats[i]["component_id"] == got[i]["component_id"] for i in got)
    assert pivots.near_duplicates(df.limit(0)).count() == 0
    one = pivots.near_duplicates(df.where("vec_id = 1")).collect()
    assert one[0]["n_links"] == 0 and one[0]["component_id"] == 1


def test_embeddings_without_ids_and_of_any_size(spark):
    rng = np.random.default_rng(4)
    a, b, c, d = (rng.normal(size=8) for _ in range(4))
    near = lambda v: v + rng.normal(scale=0.01, size=8)
    rows = [(1, a), (None, near(a)), (2, near(a)), (3, b * 1e-200), (4, near(b) * 1e200), (None, near(b)), (7, c), (7, near(b)), (None, d), (None, near(d)), (8, near(c) * 5e-324 * 1e20)]
    df = spark.createDataFrame([(i, [float(x) for x in v], "k") for i, v in rows], "vec_id long, embedding array<double>, key string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (None, 2, 1, False), (2, 2, 1, False), (3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False), (7, 1, 7, True), (7, 3, 3, False), (None, 1, None, True), (None, 1, None, True), (8, 1, 7, False)]
    assert got == sorted(want, key=str)


def test_embeddings_recall(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6000, 32))
    x = np.concatenate([base, np.repeat(base[:300], 3, axis=0) + rng.normal(scale=0.25, size=(900, 32)) * rng.random((900, 1)), base[0] + rng.normal(scale=0.1, size=(300, 32))])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    for block in (2000, 100):
        got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(df, block=block).collect()}
        assert all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.999 * want.sum() > 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (7, 7)] + [(200, 300 + k) for k in range(40)]
    df = spark.createDataFrame(chain, "a long, b long")
    for one_task in (10**6, 0):
        got = {r["node"]: r["component"] for r in components(df, one_task).collect()}
        assert {got[k] for k in range(31)} == {0} and got[101] == 100 and got[339] == 200
    pairs = df.select(*(F.struct((-F.col(c)).alias("x"), F.col(c).alias("y")).alias(c) for c in "ab"))
    for one_task in (10**6, 0):
        got = {r["node"]["y"]: r["component"]["y"] for r in components(pairs, one_task).collect()}
        assert {got[k] for k in range(31)} == {30} and got[100] == 101 and got[200] == 339
    assert components(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    ids = list(range(1, 400))
    random.Random(11).shuffle(ids)
    rising = [(1000 + k, 1001 + k) for k in range(199)] + [(1199, 999)]  # the least node at the far end
    edges = list(zip(ids, ids[1:])) + rising
    for one_task in (0, 10**6):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
        assert {got[k] for k in ids} == {1} and {got[k] for k in range(999, 1200)} == {999}


def test_row_local_operators(docs):
    model, bpe = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")
    rows = {r["doc_id"]: (r["text"] or "") for r in docs.collect()}
    sp, tok = tokencount.counter(model).sp, packing.byte_tokens(bpe)
    for r in tokencount.token_counts(docs, model, limit=50, chunk=100, overlap=8).collect():
        t = rows[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 50)
    m = media.media_digest(media.to_media(docs, "doc_id", "text")).collect()
    for r in m:
        p = media.payload_of(rows[r["doc_id"]].encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.packet_table(media.to_media(docs, "doc_id", "text"), "doc_id", "media").count() >= len(rows)
    assert all(r["lossless"] for r in mergedrop.round_trip(docs, model, seed=3, dropout=0.3).collect())
    enc = mergedrop.encode(docs, model, seed=3, dropout=0.3)
    assert {r["doc_id"]: r["text"] for r in mergedrop.decode(enc, model).collect()} == rows
    empty = docs.limit(0)
    for df in (tokencount.token_counts(empty, model), media.media_digest(media.to_media(empty, "doc_id", "text")), mergedrop.round_trip(empty, model), packing.pack_documents(empty, bpe)):
        assert df.count() == 0


def test_packing(docs):
    bpe = tokenizer_path("byte_bpe_50k.json")
    tok = packing.byte_tokens(bpe)
    got = packing.pack_documents(docs, bpe, max_len=64, keep_ids=True).collect()
    want = {r["doc_id"]: [*tok.whole(r["text"] or ""), 0] for r in docs.collect()}
    for i, ids in want.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in own for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in own)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 64
    whole = packing.sequences(packing.pack_documents(docs, bpe, max_len=64, keep_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole) and len(whole) == len(seqs)


def test_chat(spark):
    rows = [(1, 1, "assistant", "two", 9), (1, 0, "user", "one", 9), (-7, 0, "user", PLANTED, 9), (-7, 1, "assistant", PLANTED, 9), (3, 0, None, None, 9), (None, 0, "user", "x", 9), (1, 1, "assistant", "two", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int")
    got = {r["conv_id"]: r for r in chat.conversation_digest(chat.format_turns(df)).collect()}
    assert got[-7]["loss_chars"] == len(PLANTED) and got[-7]["loss_sha256"] == hashlib.sha256(PLANTED.encode()).hexdigest()
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{PLANTED}\nassistant\n{PLANTED}\n".encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[3]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[None]["n_turns"] == 1
    assert chat.conversation_digest(chat.format_turns(df.limit(0))).count() == 0


def test_chat_places_of_rewritten_turns(spark):
    marked = chat.Template(lambda ms: "".join(m["text"] + ";" for m in ms) + ("!" if ms else ""), str, lambda s: ("", s))
    df = spark.createDataFrame([(1, k, "u", "ab") for k in range(3)], "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(df, marked)
    assert [(r["begin"], r["end"]) for r in turns.collect()] == [(0, 4), (3, 7), (6, 10)]
    d = chat.conversation_digest(turns, marked).collect()[0]
    assert (d["n_turns"], d["formatted_chars"], d["rewrites_history"], d["turns_sha256"], d["loss_chars"], d["loss_sha256"]) == (3, 10, True, None, None, None)


def test_licenses(spark):
    mit = "Released under the MIT License."
    rows = [("a/LICENSE", mit), ("a/b/x.txt", "words\nand words"), ("a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."), ("a/b/c/y.txt", None), ("z.txt", "nothing"), ("a/b/c/z.txt", "lots of words here\n" + mit), (None, ""), ("a/b/x.txt", "words\nand words")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "path string, text string, dir string, line int")
    got = {r["path"]: (r["license"], r["origin"], r["licence_dir"], r["line"]) for r in licenses.scan(df, keep=("line",)).collect()}
    assert got["a/b/x.txt"] == ("Apache-2.0", "inherited", "a/b", 1) and got["a/b/c/y.txt"][0] == "Apache-2.0"
    assert got["a/LICENSE"][:2] == ("MIT", "header") and got["a/b/c/z.txt"][:2] == ("MIT", "header")
    assert got["z.txt"][0] is None and got[""][0] is None
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0


def test_paths_of_documents(spark):
    df = spark.createDataFrame([(0, "s", "en"), (50, "s", "en"), (20, "s", None), (121, "s", "en"), (None, None, None)], "doc_id long, source string, lang string")
    assert [r[0] for r in df.select(licenses.document_path()).collect()] == ["s/LICENSE.0", "s/LICENSE.50", "s/_/LICENSE.20", "s/en/1/121.txt", "_/_/_/_.txt"]


def test_stored_tables_go(spark):
    from tickloom.llm.common import drop_stored, shared_dir, stored

    one = stored(spark.range(5), "one")
    assert one.count() == 5 and all("/tickloom-one-" in f and f.startswith(shared_dir(spark).removeprefix("file://")[:5]) or "/tickloom-one-" in f for f in one.inputFiles())
    drop_stored(one)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        one.collect()


def test_licenses_over_lines_and_inside_them(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice."
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os"
    texts = {
        "Apache-2.0": ["/* Licensed under the Apache License,\n * Version 2.0 */", "Apache License\nVersion 2.0, January 2004\nand terms"],
        "GPL-3.0": [gpl, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"],
        "MPL-2.0": ["Mozilla Public License Version 2.0"],
        "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
        "BSD-2-Clause": ["Copyright 2020\n\n" + bsd],
        "BSD-3-Clause": [bsd + "\n\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission."],
        "ISC": ["Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED AS IS"],
        "MIT": ["# SPDX-License-Identifier: MIT\nx = 1", "Copyright (c) 2020 Some Company. All rights reserved. Licensed under the MIT License. See LICENSE in the project root for details."],
        None: ["the license of this software is free, version 2 of the public words\nwas released by a person"],
    }
    rows = [(f"{k}-{n}/{i}.txt", t) for k, (n, ts) in enumerate(texts.items()) for i, t in enumerate(ts)]
    want = {f"{k}-{n}/{i}.txt": n for k, (n, ts) in enumerate(texts.items()) for i in range(len(ts))}
    assert {r["path"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()} == want


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(k, None if k == 3 else int(k % 5 == 0)) for k in range(40)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample=30)
    got = toxicity.score(docs, model, keep=("bucket",)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["bucket"] == "clash" for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert toxicity.fit(docs, labels.limit(0)).score(0, 0) == 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    """On the driver's small tables, where they are: labels that were never learned are told apart."""
    from pathlib import Path

    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no driver tables here")
    documents, labels = (spark.read.parquet(str(folder / f"{t}.parquet")) for t in ("documents", "labels"))
    model = toxicity.fit(documents, labels)
    rows = toxicity.score(documents, model).join(labels, "doc_id").where("held_out and toxic is not null").select("score", "predicted", "toxic").collect()
    bad, good = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    better = sum((a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in bad for b in good) / (len(bad) * len(good))
    assert better > 0.9 and sum(r["predicted"] for r in bad) > 0.7 * len(bad) and sum(r["predicted"] for r in good) < 0.2 * len(good)


def test_texts_that_share_an_id(spark):
    """Rows of one id with different texts: one of them comes first, and the other loses what both have; equal rows fare alike."""
    rng = random.Random(8)
    passage, a, b = prose(rng, 60), prose(rng, 10), prose(rng, 12)
    rows = [(5, f"{a} {passage}"), (5, f"{passage} {b}"), (5, f"{passage} {b}"), (6, passage), (None, passage), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in passages.digest(df).collect()]
    n = len(passage.encode())
    five = {(size, gone) for i, size, gone in got if i == 5}
    first, second = (len(t.encode()) for _, t in rows[:2])
    assert sorted(gone > 0 for _, gone in five) == [False, True] and {size for size, _ in five} == {first, second}
    assert all(n <= gone <= n + 2 for _, gone in five if gone)
    assert [r for r in got if r[0] in (6, None)] == [r for r in got if r[0] in (6, None) and r[2] == n] and len(got) == 6


def test_clashing_and_null_inputs(spark):
    ids = spark.createDataFrame([(1, [5, 300]), (2, None), (None, [])], "text long, ids array<int>")
    back = mergedrop.decode(ids, tokenizer_path("piece_bpe_32k.model"), id_col="text")
    assert back.columns == ["kept_text", "text"] and {r["kept_text"]: r["text"] for r in back.collect()}[2] == ""
    files = spark.createDataFrame([(1, bytearray(media.mux(b"a" * 900))), (2, None), (None, bytearray(b"junk"))], "track long, media binary")
    packets = media.packet_table(files, "track", "media")
    assert packets.columns[0] == "kept_track" and {r["kept_track"] for r in packets.collect()} == {1} and sum(r["size"] for r in packets.collect()) == 900
    digest = media.media_digest(files.withColumn("n_bytes", F.lit(0)), "track").collect()
    assert len(digest) == 3 and {r["payload_bytes"] for r in digest} == {0, 900}
    fitted = toxicity.train([toxicity.bag("bad words"), toxicity.bag("good ones")], np.array([1, 0]))
    rows = spark.createDataFrame([(1, "x", 7)], "doc_id long, text string, score int")
    out = toxicity.score(rows, fitted, keep=("score", "text"))
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "kept_score", "text"] and out.collect()[0]["kept_score"] == 7


def test_chat_digest_against_rows(spark):
    """Random conversations: what is read back from spans is what went in."""
    rng = random.Random(12)
    bits = ["\\", "#", "### ", "<", "</turn>", "\n", ": ", "assistant", "é", "😀", " ", "ok", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 12)))])) for c in range(60) for t in range(rng.randint(1, 90 if c < 3 else 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat.conversation_digest(chat.format_turns(df)).collect()}
    for c in range(60):
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        learned = "".join(t for r, t in own if r == "assistant")
        d = got[c]
        assert d["n_turns"] == len(own) and d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (d["loss_chars"], d["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest()) and not d["rewrites_history"]
        assert d["formatted_chars"] == len(chat.render_marked([{"role": r, "text": t} for r, t in own]))


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = prose(rng, 400_000) + "x" * 300_000 + " " + "é" * 100_000 + "\n" * 2000 + "z"
    rows = [(1, long), (2, "short"), (3, long[:1_000_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts, sizes = dict(rows), {i: len(t.encode()) for i, t in rows}
    model, bpe = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")
    sp, tok = tokencount.counter(model).sp, packing.byte_tokens(bpe)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(df, model).collect()} == {i: (sizes[i], len(sp.encode(t))) for i, t in texts.items()}
    assert all(r["lossless"] for r in mergedrop.round_trip(df, model, seed=2, dropout=0.1).collect())
    packed = packing.pack_documents(df, bpe).collect()
    assert {i: max(r["doc_tokens"] for r in packed if r["doc_id"] == i) for i in texts} == {i: len(tok.whole(t)) + 1 for i, t in texts.items()}
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in texts} == {i: len(tok.whole(t)) + 1 for i, t in texts.items()}
    media_rows = {r["doc_id"]: r for r in media.media_digest(media.to_media(df, "doc_id", "text")).collect()}
    assert all(media_rows[i]["payload_sha256"] == hashlib.sha256(media.payload_of(t.encode())).hexdigest() for i, t in texts.items())
    removed = {r["doc_id"]: r["n_removed"] for r in passages.digest(df).collect()}
    assert removed[3] == sizes[3] and removed[2] == 0
    joined = {r["doc_id"]: r["class_id"] for r in shingles.join(df.unionByName(df.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))).collect()}
    assert joined == {1: 1, 2: 2, 3: 3, 9: 1}
    fitted = toxicity.train([toxicity.bag("bad words"), toxicity.bag("good ones")], np.array([1, 0]))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(df, fitted).collect())
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    d = chat.conversation_digest(chat.format_turns(turns)).collect()[0]
    assert d["loss_chars"] == len(long) and d["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_pipeline(docs, spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path / "sf")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*columns).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k == 7)) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    own = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "passages", "packing"]
    sizes = [own.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, own, sf)
        assert out.columns == columns
        out.write.parquet(f"{sf}/stage{k}")
        own = spark.read.parquet(f"{sf}/stage{k}")
        sizes.append(own.count())
    assert sizes[1] >= sizes[2] >= sizes[3] > 20
    assert {3} == {r["doc_id"] for r in own.where("doc_id in (3, 39, 40)").collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == sizes[3]


def test_pipeline_against_brute_force(docs, spark, tmp_path):
    """Every stage on its own input: scores one text at a time, all pairs of shingle sets, every window, the library's ids."""
    import corpus_pipeline

    sf = str(tmp_path / "sf")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.where("doc_id is not null").select(*columns).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 == 1)) for k in range(30)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    own = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in own.collect()}

    model = toxicity.fit(own, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if toxicity.scores(model, [t or ""])[0] < 0.3}

    def after(k):
        out = corpus_pipeline.STAGES[k][1](spark, own, sf)
        out.write.parquet(f"{sf}/brute{k}")
        return spark.read.parquet(f"{sf}/brute{k}")

    own = after(0)
    assert {r["doc_id"]: r["text"] for r in own.collect()} == rows and 20 < len(rows)

    words = {i: (t or "").split() for i, t in rows.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    group = {i: i for i in rows}
    for _ in rows:
        for i in rows:
            for j in rows:
                if i < j and jaccard(sets[i], sets[j]) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
    rows = {i: t for i, t in rows.items() if group[i] == i}
    own = after(1)
    assert {r["doc_id"]: r["text"] for r in own.collect()} == rows

    seen, want = set(), {}
    for i, t in sorted(rows.items()):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                mark[at : at + 100] = b"\1" * 100
            seen.add(raw[at : at + 100])
        spans, at = [], 0
        while (a := mark.find(1, at)) >= 0:
            at = mark.find(0, a) if mark.find(0, a) >= 0 else len(mark)
            spans.append((a, at))
        cut = passages.whole_characters(raw, spans)
        left = b"".join(raw[x:y] for x, y in zip([0, *(e for _, e in cut)], [*(a for a, _ in cut), len(raw)]))
        if left or not raw:
            want[i] = None if t is None else left.decode()
    own = after(2)
    assert {r["doc_id"]: r["text"] for r in own.collect()} == want and any(want[i] != rows[i] for i in want)

    tok = packing.byte_tokens(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.whole(t or ""), 0], "<u4") for i, t in want.items()}
    packed = corpus_pipeline.STAGES[3][1](spark, own, sf).collect()
    for i, x in ids.items():
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in packed if r["doc_id"] == i)
        assert mine == [(a, len(x[a : a + n]), zlib.crc32(x[a : a + n].tobytes())) for a, n, _ in mine] and sum(n for _, n, _ in mine) == len(x)
    filled = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024 and len(packed) == sum(-(-len(x) // 1024) for x in ids.values())
