"""Annotation, graph, sequences and k-mers of a small annotation whose results are known."""

import gzip
import struct


import pytest
from pyspark.sql import functions as F

from lariat.operators import graph as G
from lariat.operators import transcripts as T
from lariat.sources import alignments, text

#: (gene, transcript, strand, exons)
ANNOTATION = [
    ("one", "def", "+", [(6, 20), (31, 40), (54, 62), (76, 85)]),
    ("one", "int1_alt3", "+", [(6, 40), (51, 62), (76, 85)]),
    ("one", "apa_alt5", "+", [(6, 20), (31, 40), (54, 65), (76, 90)]),
    ("single", "ex1_single", "+", [(11, 20)]),
    ("single_rev", "single_rev", "-", [(11, 20)]),
    ("kissing", "def_kiss", "-", [(11, 20), (21, 30)]),
    ("kissing", "ret_kiss", "-", [(11, 30)]),
]
FORWARD = "AAAAA" + "TTATT" + "GCGGATTACA" + "T" * 10 + "GCATTAGAAG" + "G" * 10 + "CCT" + "CTATGCTAG" + "TTC" + "C" * 10 + "TTAGACAAGA" + "AATAA" + "A" * 10
GENOME = FORWARD + FORWARD[::-1].translate(str.maketrans("ACGT", "TGCA"))


def gtf_lines(rows=ANNOTATION, extra=""):
    return ["# comment"] + [f'chr0\tx\texon\t{a}\t{b}\t.\t{s}\t.\tgene_id "{g}"; transcript_id "{t}";{extra}' for g, t, s, exons in rows for a, b in exons]


@pytest.fixture(scope="module")
def built(spark, kept, tmp_path_factory):
    path = tmp_path_factory.mktemp("graph")
    (path / "a.gtf").write_text("\n".join(gtf_lines()) + "\n")
    (path / "g.fa").write_text(">chr0 test\n" + "\n".join(GENOME[i : i + 60] for i in range(0, len(GENOME), 60)) + "\n>chr9\nACGT\n")
    exons = kept(T.one_chromosome(text.gtf(spark, str(path / "a.gtf"))))
    tx = kept(T.transcripts(exons))
    genes = kept(T.genes(tx))
    nodes = kept(G.nodes(genes, T.distinct_exons(exons)))
    pieces = kept(text.fasta(spark, str(path / "g.fa"), genes.select("chrom")))
    seqs = kept(G.gene_sequences(G.node_sequences(nodes, genes, pieces, 16)))
    return {"exons": exons, "tx": tx, "genes": genes, "nodes": nodes, "seqs": seqs, "pieces": pieces, "paths": kept(G.annotated_paths(nodes, genes, tx))}


def test_nodes(built):
    got = [tuple(r) for r in built["nodes"].where("gene = 'one'").orderBy("node").select("node", "coord", "length", "edge_in", "edge_out", "offset").collect()]
    assert got == [(1, 6, 15, "SL", "LL", 1), (2, 21, 10, "LL", "RR", 16), (3, 31, 10, "RR", "LR", 26), (4, 51, 3, "LR", "RR", 36), (5, 54, 9, "RR", "LL", 39), (6, 63, 3, "LL", "LR", 48), (7, 76, 10, "LR", "RS", 51), (8, 86, 5, "RS", "RS", 61)]


def test_sequences_and_paths(built):
    seqs = {r["gene"]: r["seq"] for r in built["seqs"].collect()}
    assert seqs == {"one": FORWARD[5:40] + FORWARD[50:65] + FORWARD[75:90], "single": "GCGGATTACA", "single_rev": "TGTAATCCGC", "kissing": "AAAAAAAAAATGTAATCCGC"}
    paths = {r["transcript"]: r["nodes"] for r in built["paths"].collect()}
    assert (paths["def"], paths["int1_alt3"], paths["apa_alt5"]) == ([1, 3, 5, 7], [1, 2, 3, 4, 5, 7], [1, 3, 5, 6, 7, 8])
    assert {r["transcript"]: r["length"] for r in G.isoform_lengths(built["paths"], built["nodes"]).where("gene = 'one'").collect()} == {"def": 44, "int1_alt3": 57, "apa_alt5": 52}
    per_node = G.node_sequences(built["nodes"], built["genes"], built["pieces"]).groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "seq"))), lambda n: n["seq"]).alias("seqs"))
    spliced = {r[0]: r[1] for r in built["paths"].join(per_node, "gene").select("transcript", G.path_sequence(F.col("nodes"), F.col("seqs"))).collect()}
    assert spliced["def"] == "".join(FORWARD[a - 1 : b] for a, b in ANNOTATION[0][3]) and spliced["def_kiss"] == seqs["kissing"]


def test_kmer_edges(built):
    rows = G.kmer_edges(built["nodes"], built["seqs"], 2).collect()
    assert {r["kmer"] for r in rows if r["side"] == "left"} == {"CA", "AG", "TC", "AA"} and {r["kmer"] for r in rows if r["side"] == "right"} == {"GC", "CC", "CT", "TT", "TG"}
    joined = {(r["gene"], r["left"], r["right"]) for r in G.joined_edges(G.kmer_edges(built["nodes"], built["seqs"], 2)).where("left_kmer = 'CA' and right_kmer = 'GC'").collect()}
    assert ("one", 2, 3) in joined


def test_gene_offsets_and_exons(built):
    at = {r["gene"]: r["at"] for r in G.gene_offsets(built["seqs"]).collect()}
    assert at == {"kissing": 0, "one": 20, "single": 85, "single_rev": 95}
    assert {r["gene"]: r["at"] for r in G.isoform_offsets(built["paths"]).collect()} == {"kissing": 0, "one": 2, "single": 5, "single_rev": 6}
    found = {(r["first"], r["last"]): r["annotated"] for r in G.potential_exons(built["nodes"], built["paths"]).where("gene = 'one'").collect()}
    assert found[1, 1] and found[1, 3] and found[4, 5] and not found[4, 6] and (1, 4) not in found


def test_expected_gc(spark):
    got = spark.createDataFrame([("GC" * 30,), ("AT" * 30,), ("ACG",)], "seq string").select(G.expected_gc(F.col("seq"))).collect()
    assert got[0][0][19] == 1 and got[1][0][0] == 1 and sum(got[2][0]) == 0 and all(len(r[0]) == 20 for r in got)


def test_annotation_is_checked(spark, tmp_path):
    path = tmp_path / "b.gtf.gz"
    path.write_bytes(gzip.compress("\n".join(gtf_lines([*ANNOTATION[:2], ANNOTATION[0]])).encode()))
    with pytest.raises(Exception, match="side by side"):
        text.gtf(spark, str(path)).collect()
    (tmp_path / "c.gtf").write_text("\n".join(gtf_lines(extra=' transcript_support_level "4";')))
    with pytest.warns(UserWarning, match="support level"):
        assert text.gtf(spark, str(tmp_path / "c.gtf")).count() == 16
    assert text.gtf(spark, str(tmp_path / "c.gtf"), True).count() == 0
    with pytest.raises(ValueError, match="GTF"):
        text.refflat(spark, "x")


def bam_bytes(reads):
    """A small BAM file of (name, flag, pos, cigar as (n, op number), seq)."""
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr0\0" + struct.pack("<i", 200)
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    for name, flag, pos, cigar, seq in reads:
        raw = name.encode() + b"\0"
        packed = bytes((code[seq[i]] << 4) | (code[seq[i + 1]] if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(raw), 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + raw + struct.pack(f"<{len(cigar)}I", *((n << 4) | op for n, op in cigar)) + packed + b"\xff" * len(seq)
        out += struct.pack("<i", len(body)) + body
    half = len(out) // 2
    return b"".join(gzip.compress(x) for x in (out[:half], out[half:], b""))


def test_novel_sites(spark, built, tmp_path):
    reads = [("a", 0, 36, [(10, 0), (5, 3), (5, 0)], "A" * 15), ("b", 0, 37, [(9, 0), (5, 3), (6, 0)], "C" * 15), ("c", 16, 36, [(10, 0), (8, 3), (5, 0)], "G" * 15), ("d", 0, 12, [(3, 0), (4, 3), (4, 0)], "T" * 7), ("e", 0, 33, [(6, 0)], "ACGTAC")]
    (tmp_path / "r.bam").write_bytes(bam_bytes(reads))
    lines = ["@HD\tVN:1.0"] + [f"{n}\t{f}\tchr0\t{p}\t60\t{''.join(f'{k}{'MIDNSHP=X'[o]}' for k, o in c)}\t*\t0\t0\t{s}\t*" for n, f, p, c, s in reads]
    (tmp_path / "r.sam").write_text("\n".join(lines))
    a, b = alignments.bam(spark, str(tmp_path / "r.bam")), alignments.sam(spark, str(tmp_path / "r.sam"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {(r["name"], r["donor"], r["acceptor"]) for r in alignments.introns(b).collect()} == {("a", 45, 51), ("b", 45, 51), ("c", 45, 54), ("d", 14, 19)}
    for one_known in (False, True):
        novel = T.novel_sites(b, built["genes"], 2, one_known)
        one = T.genes(built["tx"], novel).where("gene = 'one'").first()
        assert (one["don"], one["acc"], one["noveldon"], one["novelacc"]) == ([20, 40, 45, 62, 65], [31, 51, 54, 76], [45], [])
    assert {r["gene"]: r["reads"] for r in T.exon_counts(b, built["genes"], built["exons"]).collect()}["one"] == 5
    graph = G.nodes(T.genes(built["tx"], T.novel_sites(b, built["genes"], 2)), T.distinct_exons(built["exons"]))
    assert (41, 5, "LL", "LR") in {tuple(r) for r in graph.where("gene = 'one'").select("coord", "length", "edge_in", "edge_out").collect()}


def test_split_files(spark, tmp_path):
    """Files that Spark cuts into many splits read as they do whole."""
    n = 400
    (tmp_path / "r.fastq").write_text("".join(f"@r{i} x\n{'ACGT' * (1 + i % 9)}N\n+\n{'@' * (4 + 4 * (i % 9))}!\n" for i in range(n)))
    (tmp_path / "g.fa").write_text("".join(f">c{i} y\n" + "".join("ACGTACGTAC"[: 1 + (i + j) % 10] + "\n" for j in range(1 + 7 * i % 40)) for i in range(60)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        reads = {r["read_id"]: (r["seq"], r["quality"]) for r in text.fastq(spark, str(tmp_path / "r.fastq")).collect()}
        assert reads == {f"r{i}": ("ACGT" * (1 + i % 9) + "A", [31] * (4 + 4 * (i % 9)) + [0]) for i in range(n)}
        whole = {r["name"]: r["seq"] for r in text.sequences(text.fasta(spark, str(tmp_path / "g.fa"))).collect()}
        assert whole == {f"c{i}": "".join("ACGTACGTAC"[: 1 + (i + j) % 10] for j in range(1 + 7 * i % 40)) for i in range(60)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_tables(spark, tmp_path):
    (tmp_path / "x.tpm").write_text("Isoform TpM\nt1\t3.5 7\nt2 0.0\n")
    assert {tuple(r) for r in text.tpm_file(spark, str(tmp_path / "x.tpm")).collect()} == {("t1", 3.5), ("t2", 0.0)}
    for name in ("a1.psi.gz", "a2.psi", "b1.psi"):
        (tmp_path / name).write_bytes(b"")
    assert [p.rsplit("/", 1)[1] for p in text.files(spark, "a", str(tmp_path))] == ["a1.psi.gz", "a2.psi"] and text.files(spark, "p,q") == ["p", "q"]
    assert text.is_gzipped("x.gz") and not text.is_gzipped("x") and text.absolute("/a/../b") == "/b"
