"""Reads whose names tell how they align, by the small annotation of test_graph."""

import pytest
from pyspark.sql import functions as F

from lariat.operators import align as A
from lariat.operators import graph as G
from tests.test_graph import GENOME, built  # noqa: F401

READS = [
    ("1S10M%11,20%exon1", "NGCGGATTACA", "#BBBBBBBBBB"),
    ("1S9M%54,62%exon3def", "NCTATGCTAG", "#BBBBBBBBB"),
    ("1S15M%51,65%alt3-exon3-alt5", "NCCTCTATGCTAGTTC", "#BBBBBBBBBBBBBBB"),
    ("11M10N10M%10,40%exon1-exon2", "NGCGGATTACAGCATTAGAAG", "#BBBBBBBBBBBBBBBBBBBB"),
    ("5M10N6M%16,36%exon1trunc-exon2trunc", "TTACAGCATTN", "BBBBBBBBBB#"),
    ("10M33N9M1S%11,62%exon1-exon3def", "GCGGATTACACTATGCTAGN", "BBBBBBBBBBBBBBBBBBB#"),
    ("10M33N9M%11,62%exon1-exon3def:rc", "CTAGCATAGTGTAATCCGC", "BBBBBBBBBBBBBBBBBBB"),
    ("10M55N10M1S%11,85%exon1-exon4full", "GCGGATTACATTAGACAAGAN", "BBBBBBBBBBBBBBBBBBBB#"),
    ("11M55N4M%10,78%exon1-exon4_4bp", "NGCGGATTACATTAG", "#IIIIIIIIIIIIII"),
    ("2M55N10M%19,85%exon1_2bp-exon4:rc", "TCTTGTCTAATG", "IIIIIIIIIIII"),
]
SMALL = A.Settings(mismatches=1, kmer=2, tries=4, tolerance=4, least_quality=4, seed=5, buffer=1, step=2, pair_range=1000)


@pytest.fixture(scope="module")
def index(spark, kept, built):  # noqa: F811
    offsets = kept(G.gene_offsets(built["seqs"]))
    return kept(A.seed_index(offsets, SMALL)), A.broadcast_graphs(built["nodes"], offsets, SMALL)


def frame(spark, reads):
    rows = [(n, s.replace("N", "C"), [ord(c) - 33 for c in q]) for n, s, q in reads]
    return spark.createDataFrame(rows, "read_id string, seq string, quality array<int>")


def test_reads_align_as_named(spark, built, index):  # noqa: F811
    got = {r["read_id"]: r["alignments"] for r in A.align(frame(spark, READS), *index, SMALL).collect()}
    coords = {(r["gene"], r["node"]): r for r in built["nodes"].collect()}
    assert set(got) == {n for n, _, _ in READS}
    for name, seq, _ in READS:
        found = got[name]
        scores = [sum(n["matches"] - n["doubt"] for n in a["path"]) / len(seq) for a in found]
        assert max(scores) - min(scores) <= 0.05 + 1e-6
        best = found[scores.index(max(scores))]
        assert best["forward"] == (":rc" not in name) and len(best["path"]) == len(name.split("-"))
        node = coords[best["gene"], best["path"][0]["node"]]
        assert node["coord"] + best["offset"] - node["offset"] == int(name.split("%")[1].split(",")[0])


def test_seeds(spark, built, index):  # noqa: F811
    assert A.seed_places(20, [40] * 20, SMALL) == [1, 3, 5, 7] and A.seed_places(20, [40] * 20, SMALL, False) == [14, 12, 10, 8]
    assert A.seed_places(20, [2] + [40] * 19, SMALL) == [2, 4, 6, 8] and A.seed_places(4, [40] * 4, SMALL) == []
    rows = {r["seed"]: r["hits"] for r in index[0].collect()}
    seqs = {r["gene"]: r["seq"] for r in built["seqs"].collect()}
    for seed, hits in rows.items():
        assert sorted((h["gene"], h["at"]) for h in hits) == sorted((g, i + 1) for g, s in seqs.items() for i in range(len(s) - 4) if s[i : i + 5] == seed) and len(hits) <= 4


def test_pairs(spark, index):
    rows = [("p", "GCGGATTACAGCATTAGAAG", A.reverse_complement("CTATGCTAGTTAGACAAG")), ("q", A.reverse_complement("CTATGCTAGTTAGACAAG"), "GCGGATTACAGCATTAGAAG"), ("far", "GCGGATTACAGCATTAGAAG", "GGGGGGGGGGGGGGGGGG")]
    pairs = spark.createDataFrame([(n, s, [40] * len(s), m, [40] * len(m)) for n, s, m in rows], "read_id string, seq string, quality array<int>, mate_seq string, mate_quality array<int>")
    got = {r["read_id"]: r for r in A.align_pairs(pairs, *index, SMALL).collect()}
    assert set(got) == {"p", "q"}
    assert [n["node"] for n in got["p"]["first"][0]["path"]] == [1, 3] and [n["node"] for n in got["p"]["second"][0]["path"]] == [5, 7]
    assert got["p"]["first"][0]["forward"] and not got["q"]["first"][0]["forward"] and [n["node"] for n in got["q"]["first"][0]["path"]] == [5, 7]


def test_best_and_length(spark, index):
    aligned = A.align(frame(spark, READS), *index, SMALL)
    assert all(r["s"] >= 0.5 for r in aligned.select((A.score(A.best_alignment(F.col("alignments"))["path"]) / F.col("length")).alias("s")).collect())
    row = A.mean_read_length(aligned).first()
    assert (row["mapped"], row["read_length"]) == (10, sum(len(s) for _, s, _ in READS) // 10)


def test_reads_from_transcripts_align(spark, built, index):  # noqa: F811
    """Every stretch of 20 bases of a spliced transcript comes back on that transcript's nodes."""
    assert len(GENOME) == 200
    spliced = {"def": [(1, 15), (3, 10), (5, 9), (7, 10)], "apa_alt5": [(1, 15), (3, 10), (5, 9), (6, 3), (7, 10), (8, 5)]}
    seq = {r["gene"]: r["seq"] for r in built["seqs"].collect()}["one"]
    offset = {r["node"]: r["offset"] for r in built["nodes"].where("gene = 'one'").collect()}
    reads = []
    for name, nodes in spliced.items():
        base = "".join(seq[offset[n] - 1 : offset[n] - 1 + k] for n, k in nodes)
        reads += [(f"{name}:{i}", base[i : i + 20], "I" * 20) for i in range(len(base) - 19)]
    got = {r["read_id"]: r["alignments"] for r in A.align(frame(spark, reads), *index, SMALL).collect()}
    whole = [any(a["gene"] == "one" and sum(n["matches"] for n in a["path"]) >= 18 for a in got.get(name, [])) for name, _, _ in reads]
    # With k-mers of two bases a wrong splice may match as long as the right one and end a walk.
    assert sum(whole) >= 0.8 * len(reads)
