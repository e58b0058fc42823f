"""Every query of this subpackage by its name: on the smallest tables, on odd rows, and on empty tables."""

import glob
import hashlib
import os
import re
import shutil
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lariat.llm import packing, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries.queries() if n != "pipeline"]
ODD = ["", None, " ", "a", "x" * 3000, "word " * 2000, "é ü 漢字 😀", "the same text here again", "the same text here again", "Licensed under the MIT license.", "<|endoftext|> <s> ### Assistant:", "tabs\t and\n\nlines \n lines \n"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables of odd rows: nulls in every column, ties, repeated ids and columns with names that operators use."""
    path = tmp_path_factory.mktemp("odd")
    for f in glob.glob(f"{SF}/*.parquet"):
        shutil.copy(f, path)
    n = len(ODD)
    pq.write_table(pa.table({"doc_id": pa.array([*range(n), None, 3], pa.int64()), "text": [*ODD, "no id", "a"], "lang": pa.nulls(n + 2, pa.string()), "rank": ["r"] * (n + 2), "_counts": [1] * (n + 2), "digest": ["d"] * (n + 2)}), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([0, 1, 2, None, 3, 3], pa.int64()), "quality": pa.array([0, 1, None, 1, 0, 0], pa.int64()), "toxic": pa.array([0, 1, 1, 0, None, 0], pa.int64())}), path / "labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([0, 1, 2, 3, 4, None, 5], pa.int64()), "embedding": pa.array([[1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [1, 0], []], pa.list_(pa.float32())), "label": pa.array([1, 1, 1, 1, 1, 1, None], pa.int32()), "size": [1] * 7}), path / "embeddings.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([1, 1, None, 2], pa.int64()), "turn": pa.array([1, 0, 0, None], pa.int64()), "role": ["assistant", "user", None, "x: \n"], "text": [None, "", "</turn>", "### "]}), path / "conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    path = tmp_path_factory.mktemp("nothing")
    for f in glob.glob(f"{SF}/*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), path / os.path.basename(f))
    return str(path)


def rows_of(path, name):
    return pq.read_table(f"{path}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, nothing, name):
    assert queries.queries()[name](spark, nothing).count() == (1 if name == "op5_chat" else 0)


def test_empty_pipeline(spark, nothing):
    assert queries.queries()["pipeline"](spark, nothing).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd(spark, odd, name):
    got = queries.queries()[name](spark, odd).collect()
    if name == "op5_chat":
        assert {r["conv_id"]: r["n_turns"] for r in got} == {1: 2, None: 1, 2: 1, -7: 2}
    elif name == "op6_neardup":
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {0: (1, 0, True), 1: (1, 0, False), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), None: (0, None, True)}
    elif name == "op8_packing":
        assert sum(r["piece"] == 0 for r in got) == len(ODD) + 2
    else:
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"]) for r in rows_of(odd, "documents"))


def test_odd_pipeline(spark, odd):
    assert queries.queries()["pipeline"](spark, odd).columns


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, path)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(want.select(*columns).fetchall())


def test_op1_learns_from_rows_not_held_out(spark):
    got = queries.op1_toxicity(spark, SF).collect()
    assert len(got) == len(rows_of(SF, "documents"))
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op1_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in rows_of(path, "labels")}
    held = [r for r in queries.op1_toxicity(spark, path).collect() if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    caught, clean = ([r["predicted"] for r in held if toxic[r["doc_id"]] == c] for c in (1, 0))
    # There are some 70 toxic texts to learn from here; at present 19 of 24 held-out ones are caught.
    assert np.mean(caught) > 0.7 and np.mean(clean) < 0.05


def test_toxicity_of_batches_without_a_word(spark):
    model = toxicity.Model(np.zeros(1 << 15, np.float32), -2.0, 1.0, 3, 2)
    score = 1 / (1 + np.exp(2))
    assert np.allclose(toxicity.score_texts([""], model), score) and np.allclose(toxicity.score_texts(["x" * 400_000, "", "a"], model), score)
    one = spark.createDataFrame([(None,), ("",), ("a",)], "text string").repartition(3)
    assert np.allclose([r[0] for r in one.select(toxicity.score(model)("text")).collect()], score)


def test_op2_columns(spark):
    docs = {r["doc_id"]: r["text"] for r in rows_of(SF, "documents")}
    for r in queries.op2_sharding(spark, SF).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_sharding_follows_from_the_keys(spark):
    """The same shards and slots however the table is split, also where many rows are equal."""
    rows = [(i % 1500 if i % 3 else 7, f"t{i % 5}" if i % 3 else "t") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = [sorted(tuple(r) for r in sharding.shard(docs.repartition(n), 24).select("doc_id", "size", "text_crc32", "shard", "slot").collect()) for n in (3, 13)]
    assert placed[0] == placed[1] and len(placed[0]) == 6000
    sharding.RUN, run = 100, sharding.RUN
    try:
        assert placed[0] == sorted(tuple(r) for r in sharding.shard(docs, 24).select("doc_id", "size", "text_crc32", "shard", "slot").collect())
    finally:
        sharding.RUN = run


def test_sharding_walks_the_ring(spark):
    """Against keys placed one by one: first every arc into its own shard, then what is over, clockwise."""
    n, shards = 2000, 7
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.range(n).selectExpr("id AS doc_id", "'t' AS text"), shards).collect()}
    key = {r[0]: r[1] for r in spark.range(n).selectExpr("id", "xxhash64(id)").collect()}
    at, owner = sharding.ring(shards, 64)
    arc = {i: int(np.searchsorted(at, k)) % len(at) for i, k in key.items()}
    own = np.bincount([owner[a] for a in arc.values()], minlength=shards)
    room = np.full(shards, n // shards)
    room[np.argsort(-own, kind="stable")[: n % shards]] += 1
    # Arc 0 also has the keys beyond the last node, which are the larger ones.
    over, want = [], {}
    for i in sorted(key, key=lambda i: (arc[i], key[i])):
        s = owner[arc[i]]
        if room[s]:
            want[i], room[s] = s, room[s] - 1
        else:
            over.append(i)
    for i in over:
        step = arc[i]
        while not room[owner[step]]:
            step = (step + 1) % len(at)
        want[i] = owner[step]
        room[owner[step]] -= 1
    assert got == want


def test_sharding_moves_few_keys(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "'t' AS text")
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.shard(docs, n).collect()} for n in (24, 25))
    moved = [i for i in before if before[i] != after[i]]
    assert len(moved) < 2.5 * 8000 / 25 and sum(after[i] != 24 for i in moved) < 0.05 * 8000


def test_op3_and_op4_against_the_libraries(spark):
    import base64

    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    byte_bpe = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = {r["doc_id"]: r["text"] or "" for r in rows_of("/root/testdata/sf0.01", "documents")}
    for r in queries.op3_byte_bpe(spark, "/root/testdata/sf0.01").collect():
        ids = np.array(byte_bpe.encode_ordinary(docs[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())
    for r in queries.op4_token_counts(spark, "/root/testdata/sf0.01").collect():
        n = len(pieces.encode(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 4096)


def test_op8_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = rows_of("/root/testdata/sf0.01", "documents")
    ids = {r["doc_id"]: np.array([*x.ids, 2], "<u4") for r, x in zip(docs, library.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False))}
    got = queries.op8_packing(spark, "/root/testdata/sf0.01").collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    counts = {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    decreasing = sum(n for _, n in packing._best_fit([counts.get(x, 0) for x in range(1025)], 1024))
    assert -(-sum(map(len, ids.values())) // 1024) <= len({r["sequence_id"] for r in got}) <= decreasing


def test_packing_is_no_worse_than_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(25):
        lengths = rng.integers(150, 601, int(rng.integers(20, 121))).tolist()
        rooms: list[int] = []
        for x in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= x]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(1024 - x)
        runs = packing.plan({x: lengths.count(x) for x in lengths}, 1024)
        assert sorted(x for f, n in runs for x in f * n) == sorted(lengths) and sum(n for _, n in runs) <= len(rooms)
    assert sum(n for _, n in packing.plan({1: 5000}, 1024)) == 5 and sum(n for _, n in packing.plan({700: 3, 1: 5000}, 1024)) == 7


def test_op9_counts_and_verdict(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in rows_of("/root/testdata/sf0.01", "documents")}
    quality = {r["doc_id"]: r["quality"] for r in rows_of("/root/testdata/sf0.01", "labels")}
    right = []
    for r in queries.op9_quality(spark, "/root/testdata/sf0.01").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["base_failed"] == (len(words) < 10 or 100 * r["n_repeat_words"] > 20 * len(words)) and not (r["base_failed"] and r["kept"])
        if quality.get(r["doc_id"]) is not None and not r["base_failed"]:
            right.append(r["kept"] == (quality[r["doc_id"]] == 1))
    assert np.mean(right) > 0.85


def test_op10_base_columns(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in rows_of("/root/testdata/sf0.01", "documents")}
    phrases = [("gnu general public license".split(), "gpl"), ("apache license".split(), "apache"), ("cc by".split(), "cc-by"), ("mit license".split(), "mit")]
    for r in queries.op10_licenses(spark, "/root/testdata/sf0.01").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]]))
        at = [(j, label) for p, label in phrases for j in range(len(w)) if w[j : j + len(p)] == p]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
