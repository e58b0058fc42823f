"""Small tests of the operators against brute force, round trips and the libraries."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lariat.llm import byte_bpe, chat, jaccard, licenses, neardup, packing, piece_counts, quality, sharding, toxicity
from lariat.llm.common import SPAN, numbered, word_hashes

ODD = ["", " ", None, "a", "a b", "\n\n", "x" * 5000, "word " * 3000, "é ü 漢字 😀", "the same text here again", "the same text here again", "a\x00b\x1c c　d", "<|endoftext|> <s>", "tabs\t and  spaces \n here"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, ties, null and repeated ids, and extra columns with names that operators use."""
    rows = [(i, t, "rank", i, "x") for i, t in enumerate(ODD)] + [(None, "no id at all", None, None, None), (3, "a", "again", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, rank string, _text long, n_words string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "mit", "license", "apache", "cc", "by", "gnu", "general", "public", "Licensed", "under", "2.0", "###", "\n", "été"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_numbered_is_gapless(spark):
    df = spark.range(1000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5).alias("k"), "id")
    got = numbered(df, ["k"], [F.col("id")]).groupBy("k").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r["r"] == list(range(len(r["r"]))) for r in got)


def test_word_hashes_do_not_depend_on_runs():
    rng = random.Random(9)
    some = ["".join(rng.choice("abCé") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["x" * SPAN, "x" * (SPAN + 1), "y" * 3 * SPAN]
    text = "".join(rng.choice(some[:300] if rng.random() < 0.999 else some) + rng.choice([" ", "\n\t "]) for _ in range(60_000)).encode()
    words = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    hashes, start, end = word_hashes(text)
    assert [text[a:b] for a, b in zip(start, end)] == words
    assert len(set(zip(hashes.tolist(), words))) == len(set(words)) == len(set(hashes.tolist()))
    assert np.array_equal(word_hashes(text, lower=True)[0], word_hashes(re.sub(rb"[A-Z]", lambda m: m.group().lower(), text))[0])
    assert all(word_hashes(w)[0].tolist() == [h] for h, w in set(zip(hashes.tolist(), words)))


@pytest.mark.parametrize("n, kinds", [(0, 1), (1, 1), (2, 1), (9, 3), (2000, 700)])
def test_counted_tokens(n, kinds):
    tokens = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint64)
    every, count = np.unique(tokens, return_counts=True)
    got = jaccard.counted_tokens(tokens.copy(), True)
    assert np.array_equal(got[0], every) and np.array_equal(got[1], count)
    got = jaccard.counted_tokens(tokens.copy(), False)
    assert np.array_equal(got[0], every[count > 1]) and np.array_equal(got[1], count[count > 1])


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    plain = ["ba", "lo", "mi", "ter", "san", "ko", "re", "du"]
    word = lambda: "".join(rng.choice(plain) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 80))]
        if i % 3 == 0:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["grumpfish", "snorkwit", "blatherskite"]))
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(data, data, learn=F.col("_id") % 4 != 2)
    got = data.select("doc_id", "toxic", toxicity.score(model)("text").alias("s")).where("doc_id % 4 = 2").collect()
    assert np.mean([(r["s"] >= 0.3) == (r["toxic"] == 1) for r in got]) > 0.95
    assert toxicity.score_texts(["grumpfissh grrumpfish ba lo"], model)[0] > toxicity.score_texts(["ba lo mi ter"], model)[0]
    odd = docs.select(toxicity.score(model)("text").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in odd)
    assert toxicity.fit(empty, data.limit(0)).scale == 0


def test_toxicity_trains_outside_the_driver(spark):
    rng = random.Random(5)
    data = spark.createDataFrame([(i, " ".join(rng.choice(["ba", "lomi", "tersan", f"w{rng.randrange(5000)}", "du" if i % 3 else "grumpfish"]) for _ in range(400)), int(i % 3 == 0)) for i in range(200)], "doc_id long, text string, toxic int")
    tracemalloc.start()
    try:
        model = toxicity.fit(data, data)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.scale != 0 and peak < 4e6


@pytest.mark.parametrize("n", [0, 1, 23, 24, 1000])
def test_sharding_law(spark, n):
    got = sharding.shard(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 24).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert len(got) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_odd(docs):
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        t = ODD[r["doc_id"]] if r["doc_id"] is not None and r["doc_id"] != 3 else None
        if t:
            assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()))


def test_byte_bpe_matches_ranks():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.codec(path, P.PATTERN)
    rng = random.Random(5)
    pool = [chr(c) for c in range(1, 0x400)] + list(" \n\t \x1c") * 60 + list("abcde'-") * 40 + ["漢", "😀", "　", "İ"]
    odd = [t or "" for t in ODD] + ["".join(rng.choice(pool) * rng.choice([1, 1, 1, 9]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for t, ids in zip(odd, codec.encode_batch(odd)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == reference.encode_ordinary(t)
        assert codec.decode_bytes(ids) == t.encode() and codec.decode(ids) == t and "".join(codec.pieces_of(ids)) == t
        assert (again := codec.encode(t))[0] == ids and all(t.encode()[a:b] == codec.bytes_of[i] for i, (a, b) in zip(*again))


def test_rank_tokenizer_matches_library():
    from tokenizers import Tokenizer

    model = byte_bpe.rank_tokenizer(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in [t or "" for t in ODD] + texts(random.Random(2), 50):
        assert model.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_piece_counts_match_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    odd = [t or "" for t in ODD] + ["".join(rng.choice("abcde ▁\n-=0123漢\U0001f600é") * rng.choice([1, 1, 2, 30]) for _ in range(60)) for _ in range(300)]
    assert piece_counts.vocabulary(P.path("piece_bpe_32k.model")).counts(odd) == [len(x) for x in sp.encode(odd)]
    assert piece_counts.token_counts(docs, P.path("piece_bpe_32k.model")).count() == docs.count()
    assert piece_counts.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_piece_models_of_other_settings_are_refused():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).serialized_model_proto()
    piece_counts.check_settings(model)
    # A later message is the one that holds: a normalizer that removes extra spaces; a trainer without byte fallback.
    for more, name in ((b"\x1a\x02\x20\x01", "extra spaces"), (b"\x12\x05\x18\x02\x98\x02\x00", "byte fallback")):
        with pytest.raises(ValueError, match=name):
            piece_counts.check_settings(model + more)


def test_chat_round_trip(spark):
    hard = ["", None, "\\### Assistant: </turn> ok", "\\b\\h\\t", "####", "</turn></part>", "a</tur", "n>\n### user: x", "\\\\"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "x: y\n", None]), rng.choice(hard)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == own
        assert got[c]["loss_text"] == "".join(t for r, t in own if r == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def brute_components(n, linked):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def test_neardup_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    x = [base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.02, 0.05, 0.09]) for _ in range(260)]
    rows = [(i, [float(np.float32(c)) for c in v], int(rng.integers(3)) if i % 40 else None) for i, v in enumerate(x)]
    rows += [(260, None, 1), (261, [0.0] * 16, 1), (262, [float("nan")] * 16, 1), (263, [None] * 16, 1), (264, [1.0, 2.0], 1), (265, [2.0, 4.0], 1), (266, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1))
    unit = [None if u is None else np.frombuffer(u) for u in neardup.unit_vectors(pa.array([r[1] for r in rows], pa.list_(pa.float64())))]
    linked = lambda a, b: rows[a][2] is not None and rows[a][2] == rows[b][2] and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98
    comp = brute_components(len(rows), linked)
    for part in (2048, 20):
        got = {r["vec_id"]: r for r in neardup.near_duplicates(df, 0.98, part).collect()}
        assert len(got) == len(rows)
        for i in range(len(rows)):
            assert got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i)
            assert got[i]["n_links"] == sum(linked(*sorted((i, j))) for j in range(len(rows)) if j != i)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_neardup_prunes_pairs_of_nodes(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 24)), 20, axis=0) + rng.normal(size=(600, 24)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    classes = spark.createDataFrame([(0, 24 * 8, i, 1, v.tobytes()) for i, v in enumerate(x)], "_label int, width int, rep long, size long, unit binary")
    theta = float(np.sqrt(0.04))
    members, levels = neardup._divided(classes, 40, theta)
    held = {r["rep"]: r["node"] for r in members.collect()}
    pairs = {(r["node"], r["node2"]) for r in neardup._near_nodes(levels, theta).collect()}
    nodes = sorted(set(held.values()))
    assert len(held) == 600 and len(nodes) > 5 and len(pairs) < len(nodes) * (len(nodes) + 1) / 4
    for i, j in zip(*np.nonzero(x @ x.T >= 0.98)):
        assert tuple(sorted((held[i], held[j]))) in pairs


@pytest.mark.parametrize("noise,seed", [(0.0, 0), (0.02, 1), (0.035, 2), (0.2, 3)])
def test_dual_traversal_against_all_pairs(noise, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 24))
    x = centres[np.minimum(rng.geometric(0.15, 900), 39)] + rng.normal(size=(900, 24)) * noise * rng.random((900, 1)) * 5
    x = np.unique(np.concatenate([x, rng.normal(size=(300, 24))]), axis=0)
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    weight = rng.integers(1, 5, len(x))
    theta = np.sqrt(0.04)
    hit = x @ x.T >= 0.98
    np.fill_diagonal(hit, False)
    whole, half = neardup.CoverTree(x, theta), len(x) // 2
    n, m, i, j = neardup.dual_links(whole, whole, 0.98, weight, weight)
    assert (n + m == hit @ weight).all() and hit[i, j].all()
    parts = [(neardup.CoverTree.from_bytes(y, neardup.CoverTree(y, theta).to_bytes()), w) for y, w in ((x[:half], weight[:half]), (x[half:], weight[half:]))]
    n, m, i, j = neardup.dual_links(parts[0][0], parts[1][0], 0.98, parts[0][1], parts[1][1])
    assert (n == hit[:half, half:] @ parts[0 + 1][1]).all() and (m == hit[half:, :half] @ parts[0][1]).all() and hit[i, half + j].all()
    for tree in (whole, parts[0][0]):
        for node in range(len(tree.centre)):
            rows = tree.order[tree.first[node] : tree.last[node]]
            assert tree.centre[node] in rows and np.linalg.norm(tree.x[rows] - tree.x[tree.centre[node]], axis=1).max() <= tree.cover[node] + 1e-7
            assert (tree.children[node] == 0) == (tree.cover[node] <= theta)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard_against_all_pairs(spark, k, num):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 150))] for _ in range(25)]
    rows = []
    for i in range(240):
        w = list(base[rng.randrange(25)] if rng.random() < 0.5 else base[0] if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(30)])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(240 + i, t) for i, t in enumerate(ODD)]
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = brute_components(len(rows), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("x"))
    got = {r["doc_id"]: r for r in jaccard.similar_components(df, k, num, 100).collect()}
    assert [got[i]["component_id"] for i in range(len(rows))] == comp
    assert [got[i]["n_shingles"] for i in range(len(rows))] == [len(s) for s in sets]


def test_jaccard_frequent_signatures_are_complete():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(6, 300))
        universe = np.sort(rng.integers(1, 2**63, n + 60).astype(np.uint64))
        often = universe[rng.random(len(universe)) < rng.choice([0.5, 0.9, 1])]
        rank = rng.permutation(len(often))
        x = np.sort(rng.choice(universe, n, replace=False))
        y = np.unique(np.concatenate([np.delete(x, rng.choice(n, int(rng.integers(0, 1 + n // 12)), replace=False)), rng.choice(universe, int(rng.integers(0, 1 + n // 20)))]))
        inter = len(np.intersect1d(x, y))
        if 100 * inter >= 85 * (len(x) + len(y) - inter) and len(np.setxor1d(x, y)):
            assert len(np.intersect1d(jaccard.signatures(x, often, rank, 85, 100)[0], jaccard.signatures(y, often, rank, 85, 100)[0]))


@pytest.mark.parametrize("n", [20, 60])
def test_jaccard_at_a_half_for_few_and_many(spark, n):
    """A token of more than 32 documents is frequent; one that is all that two sets share must link them then too."""
    df = spark.createDataFrame([(i, f"a b x{i}" if i else "a b") for i in range(n)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.similar_components(df, 2, 1, 2).collect()} == {0}


def test_jaccard_does_not_depend_on_what_is_counted(spark, monkeypatch):
    """Which tokens pass for frequent changes the candidates and never the components."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 60))] for _ in range(6)]
    rows = []
    for i in range(160):
        w = list(base[rng.randrange(6)])
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    comp = brute_components(len(rows), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for whole, gathered in ((1 << 19, 5_000_000), (0, 5_000_000), (0, 500)):
        monkeypatch.setattr(jaccard, "WHOLE", whole)
        monkeypatch.setattr(jaccard, "GATHERED", gathered)
        assert [r["component_id"] for r in sorted(jaccard.similar_components(df).collect())] == comp


def test_jaccard_odd_ids(spark, docs, empty):
    got = jaccard.similar_components(docs).collect()
    assert len(got) == docs.count() and all((r["component_id"] is None) == (r["doc_id"] is None) for r in got)
    assert jaccard.similar_components(empty).count() == 0


def test_packing(spark, docs, empty):
    paths = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(9)
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t * rng.choice([1, 1, 40])) for i, t in enumerate(texts(rng, 80))], "doc_id long, text string"))
    got = packing.pack(packing.pieces(df, *paths), 1024).collect()
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in filled.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(filled) <= 1.02 * total / 1024 + 1
    model = byte_bpe.rank_tokenizer(*paths)
    whole = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append(r)
    for i, t in df.collect():
        if i is not None and i != 3:
            ids = np.append(model.encode(t or ""), 2).astype("<u4")
            own = sorted(whole[i], key=lambda r: r["piece"])
            assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:])
            assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    assert packing.pack(packing.pieces(empty, *paths)).count() == 0


def test_quality_counts_and_rules(spark, docs):
    rng = random.Random(10)
    for t in [t or "" for t in ODD] + texts(rng, 60) + ["a b c d e " * 3 + "x\nx\n \ny"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)} if len(w) < 500 else None
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        got = dict(zip(quality.COUNTS, quality.text_counts(t.encode())))
        assert (got["n_words"], got["word_chars"], got["n_dup_lines"]) == (len(w), sum(map(len, w)), dup)
        assert not w or got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert cover is None or got["n_repeat_words"] == len(cover)
    x = np.abs(np.random.default_rng(0).normal(size=(2000, len(quality.RATIOS))))
    bad = (x[:, 2] > 1.2) | ((x[:, 6] > 1) & (x[:, 7] > 1.1))
    rules = quality.learn(x, bad)
    hit = np.any([quality._holds(r, {k: x[:, i] for i, k in enumerate(quality.RATIOS)}, len(x)) for r in rules], 0)
    assert (hit == bad).mean() > 0.97 and quality.learn(x, bad & False) == []
    stats = quality.statistics(docs)
    assert stats.withColumn("kept", quality.verdict(rules)).count() == docs.count()


def test_licenses(docs, empty, spark):
    rows = [(i, t) for i, t in enumerate([t or "" for t in ODD] + texts(random.Random(11), 150) + ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0", "mit license mit license x", "Under the terms of the GNU Lesser General Public License, version 2.1"])]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        at = [(j, label) for phrase, label in licenses.BASE for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert all(0 <= d["at"] and d["at"] + d["n"] <= len(w) for d in r["detections"])
    n = len(rows)
    assert (got[n - 4]["labels"], got[n - 3]["labels"], got[n - 2]["labels"], got[n - 1]["labels"]) == ("cc-by,cc-by-nc", "apache-2.0", "mit", "lgpl")
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0
    assert len({rule for _, _, rule, _ in licenses.NOTICES}) == len(licenses.NOTICES)


BODIES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"),
    ("Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl,gpl-2.0"),
    ("released under affero gpl 3", "agpl"),
    ("you can redistribute it under the same terms as Perl itself", "perl"),
    ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("the permission to enter the garden, in ordinary software prose", ""),
]


def test_license_bodies(spark):
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BODIES)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(BODIES))] == [label for _, label in BODIES]


def test_license_priority_and_containment(spark):
    """Detections against the rules tried one by one, and then against each other."""
    rng = random.Random(15)
    parts = [t for t, _ in BODIES] + ["MIT License", "Apache License 2.0", "GNU GPL v3", "licensed under the MIT license", "CC BY-SA 4.0", "SPDX-License-Identifier: GPL-2.0-only", "plain words here", "GNU Lesser General Public License", "zlib license", "public domain"]
    said = [". ".join(rng.sample(parts, rng.randint(1, 5))) for _ in range(60)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()}
    for i, text in enumerate(said):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        line = " " + " ".join(words) + " "
        hits = [(line[: m.start()].count(" ") - 1, m[0].count(" ") + 1, place, label, weight) for place, (label, _, rule, weight) in enumerate(licenses.rules()) for m in re.finditer(rule, line)]
        kept = [d for d in hits if not any(o[0] <= d[0] and o[0] + o[1] >= d[0] + d[1] and (o[1] > d[1] or o[1] == d[1] and o[2] < d[2]) for o in hits)]
        assert sorted((d["at"], d["n"], d["label"]) for d in got[i]["detections"]) == sorted((a, n, label) for a, n, _, label, _ in kept)
        assert set(got[i]["labels"].split(",")) - {""} == {label for *_, label, _ in kept} | set(got[i]["base_labels"].split(",")) - {""}
        assert got[i]["score"] == max([w for *_, w in kept] + [0.6 if got[i]["n_base"] else 0.0])


def sampled(rng, parsed):
    """A text that a parsed regular expression matches, at random; looks around are left out."""
    out = ""
    for op, x in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(x)
        elif name == "IN":
            kind, y = rng.choice(x)
            out += chr(y if str(kind) == "LITERAL" else rng.randint(*y))
        elif name == "BRANCH":
            out += sampled(rng, rng.choice(x[1]))
        elif name == "SUBPATTERN":
            out += sampled(rng, x[3])
        elif name == "MAX_REPEAT":
            out += "".join(sampled(rng, x[2]) for _ in range(rng.randint(x[0], min(x[1], 4))))
        else:
            assert name in ("ASSERT", "ASSERT_NOT")
    return out


@pytest.fixture(scope="module")
def statements():
    """(label, keyword, weight, text): texts made of one rule's form alone, several for each rule."""
    rng = random.Random(12)
    return [(label, key, weight, sampled(rng, re._parser.parse(rule))) for label, key, rule, weight in licenses.rules() for _ in range(6)]


def test_license_rules_hold_their_keywords(spark, statements):
    assert not [(label, key, t) for label, key, _, t in statements if key not in f" {t} "]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, x[3]) for i, x in enumerate(statements) if x[3].startswith("spdx")], "doc_id long, text string")).collect()}
    assert len(got) == 6 * len(licenses.FAMILIES)
    # A phrase that always counts, as "cc by", may add its own label.
    assert not [(statements[i], r["labels"], r["score"]) for i, r in got.items() if set(r["labels"].split(",")) - {""} != {statements[i][0], *r["base_labels"].split(",")} - {""} or r["score"] != 1.0]


def test_license_gate_loses_nothing(spark, statements, monkeypatch):
    said = ["Released under the BSD 3-Clause.", "distributed under the MIT", "available under zlib", "under the terms of ISC", "covered by NCSA", "provided under PostgreSQL", "commit to it", "plain words"]
    df = spark.createDataFrame(list(enumerate(said + texts(random.Random(13), 100) + [x[3] for x in statements if not x[3].startswith("spdx")][::3])), "doc_id long, text string")
    gated = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [(gated[i]["labels"], gated[i]["score"]) for i in range(len(said))] == [("bsd-3-clause", 0.95), ("mit", 0.9), ("zlib", 0.95), ("isc", 0.9), ("ncsa", 0.9), ("postgresql", 0.95), ("", 0.0), ("", 0.0)]
    assert not [(label, t) for label, _, _, t in statements if not any(s in f" {t} " for s in licenses.GATE)]
    monkeypatch.setattr(licenses, "GATE", [""])
    assert gated == {r["doc_id"]: r for r in licenses.scan(df).collect()}


def fewest(items, capacity):
    """Sequences needed, from all subsets: the fewest, and the least in the last one."""
    best = [(1, 0)]
    for m in range(1, 1 << len(items)):
        over = lambda k, r, x: (k, r + x) if r + x <= capacity else (k + 1, x)
        best.append(min(over(*best[m ^ 1 << i], x) for i, x in enumerate(items) if m >> i & 1))
    return best[-1][0]


def used(runs):
    return sum(n for _, n in runs)


def test_packing_plan_is_searched():
    # One bin of look-ahead takes a sequence more for each of these.
    for items in ([15, 23, 24, 26, 27, 29, 31, 39, 42, 44, 48, 50], [21, 22, 27, 29, 29, 29, 35, 37, 39, 42, 44, 44, 49, 49]):
        assert used(packing.plan({x: items.count(x) for x in items}, 100)) == -(-sum(items) // 100)
    rng = random.Random(14)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        items = [rng.randint(1 + capacity // rng.choice([5, 10, 100]), rng.choice([capacity // 2, capacity])) for _ in range(rng.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        runs = packing.plan(counts, capacity)
        assert sorted(x for f, n in runs for x in f * n) == sorted(items) and all(sum(f) <= capacity for f, _ in runs)
        assert packing._bound([counts.get(x, 0) for x in range(capacity + 1)], capacity) <= fewest(items, capacity) == used(runs)
    assert used(packing.plan({1: 2000}, 1024)) == 2 and packing.plan({}, 1024) == []


def test_packing_dominance():
    left = [0] * 11
    left[2], left[3], left[5] = 2, 1, 1
    some = 1 << 2 | 1 << 3 | 1 << 5
    assert packing._dominated((3, 2), 0, left, some)  # 5 in the place of both
    assert packing._dominated((2,), 1, left, some)  # 3 in the place of 2
    assert packing._dominated((5,), 2, left, some)  # 2 can be added
    assert not packing._dominated((5,), 1, left, some) and not packing._dominated((2, 2), 0, left, some)
