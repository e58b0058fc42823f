"""Counting, classes, abundance, several places, events, result lines and simulation on fixtures with known results."""

import glob
import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lariat.operators import align as A
from lariat.operators import bias as B
from lariat.operators import events as E
from lariat.operators import graph as G
from lariat.operators import posterior as P
from lariat.operators import quant as Q
from lariat.operators import simulate as S
from lariat.operators import transcripts as T
from lariat.sinks import sam, tables
from lariat.sources import text
from lariat.streaming import counts as stream
from tests.test_align import READS, SMALL, frame, index  # noqa: F401
from tests.test_graph import built  # noqa: F401

EDGES = {(1, 2): 616, (1, 3): 4, (2, 3): 569, (2, 4): 20, (3, 4): 629, (3, 6): 1, (3, 10): 3, (4, 5): 1, (4, 6): 664, (5, 6): 5, (6, 7): 789, (7, 8): 790, (8, 9): 2, (8, 10): 606, (9, 10): 15}
PATHS = "gene string, path array<int>"


def test_paths_of_a_graph():
    got = E.maximal_paths(list(EDGES))
    want = {(1, 2, 3, 4, 5, 6, 7, 8, 9, 10), (1, 3, 4, 5, 6, 7, 8, 9, 10), (1, 2, 4, 5, 6, 7, 8, 9, 10), (1, 2, 3, 6, 7, 8, 9, 10), (1, 3, 6, 7, 8, 9, 10), (1, 2, 3, 10), (1, 3, 10), (1, 2, 3, 4, 6, 7, 8, 9, 10), (1, 3, 4, 6, 7, 8, 9, 10), (1, 2, 4, 6, 7, 8, 9, 10)}
    want |= {tuple(x for x in p if x != 9) for p in want}
    assert set(got) == want and len(got) == 18
    many = [(i, j) for i in range(14) for j in range(i + 1, 14)]
    assert len(E.maximal_paths(many)) <= 1024 and E.maximal_paths(many, 50) == E.maximal_paths(many[::-1], 50) and E.maximal_paths([]) == []
    for edges in ([(1, 2)], [(1, 2), (3, 4)], [(1, 3), (2, 3), (3, 4), (3, 5)]):
        for p in E.maximal_paths(edges):
            assert not any(e[1] == p[0] or e[0] == p[-1] for e in edges) and set(zip(p, p[1:])) <= set(edges)


def test_containment(spark):
    rows = [([1], [1]), ([1], [2]), ([2], [2, 3]), ([1], [2, 3]), ([2, 3], [1, 2, 3]), ([2, 1], [1, 2, 3]), ([1, 2, 3], [1, 2])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    assert [r[0] for r in df.select(Q.is_part(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True, False, False]
    annotated = spark.createDataFrame([("g", "t", [1, 2, 5, 6])], "gene string, transcript string, nodes array<int>")
    asked = [[1, 2], [2, 5], [5, 6], [1, 3], [1, 6], [1, 7], [1, 2, 3], [1, 2, 5], [5], [3]]
    keyed = spark.createDataFrame([(i, "g", p, None) for i, p in enumerate(asked)], "key int, gene string, path array<int>, mate array<int>")
    assert sorted(r["key"] for r in Q.compatible(keyed, annotated).collect()) == [0, 1, 2, 7, 8]


def test_counts(spark):
    paths = spark.createDataFrame([("g", p) for p in ([1], [1], [1, 2], [2, 1], [2, 2], [1, 2, 5], [1, 2, 5], [])], PATHS)
    got = {(r["kind"], tuple(r["path"])): r["n"] for r in Q.count(paths).collect()}
    assert got == {("node", (1,)): 2, ("edge", (1, 2)): 1, ("circ", (2, 1)): 1, ("circ", (2, 2)): 1, ("long", (1, 2, 5)): 2}
    flat = {(r["kind"], tuple(r["path"])): r["n"] for r in Q.decomposed(Q.count(paths)).collect()}
    assert flat == {("node", (1,)): 2, ("edge", (1, 2)): 3, ("edge", (2, 5)): 2, ("circ", (2, 1)): 1, ("circ", (2, 2)): 1}
    pairs = [([1], [1]), ([1], [1, 2]), ([1, 2, 3], [2, 3]), ([1, 2], [3, 4]), ([1, 2], [2, 3]), ([1], [3])]
    counted = Q.count_pairs(spark.createDataFrame([("g", a, b) for a, b in pairs], PATHS + ", mate array<int>"))
    got = {(r["kind"], tuple(r["path"]), tuple(r["mate"] or ())): r["n"] for r in counted.collect()}
    assert got == {("node", (1,), ()): 1, ("edge", (1, 2), ()): 1, ("long", (1, 2, 3), ()): 1, ("pair", (1, 2), (3, 4)): 1, ("pair", (1, 2), (2, 3)): 1, ("pair", (1,), (3,)): 1}
    flat = {(r["kind"], tuple(r["path"])): r["n"] for r in Q.decomposed(counted).collect()}
    assert flat == {("node", (1,)): 2, ("node", (3,)): 1, ("edge", (1, 2)): 4, ("edge", (2, 3)): 2, ("edge", (3, 4)): 1}
    assert Q.count_pairs(spark.createDataFrame([("g", [1, 2, 3], [2])], PATHS + ", mate array<int>"), drop_long=True).count() == 0
    assert Q.added(counted, counted).agg(F.sum("n")).first()[0] == 12


def slow_expectation(unique, lengths, classes, read_length, digits, most):
    """The rule of abundances, class by class."""
    count, done = list(unique), [False] * len(classes)
    share = [[1 / len(m)] * len(m) for m, _ in classes]

    def rated(c):
        rate = [x / max(n - read_length, 1) for x, n in zip(c, lengths)]
        return [round(r * 1e6 / max(sum(rate), 1), digits) for r in rate]

    tpm, before, it = rated(count), None, 1
    while tpm != before and it < most:
        now, before = list(count), tpm
        for i, (members, n) in enumerate(classes):
            if done[i]:
                continue
            if it > 1:
                total = sum(tpm[m] for m in members)
                new = [round(tpm[m] / total, 4) if total else 0.0 for m in members]
                done[i] = total == 0 or new == share[i]
                share[i] = new
            for m, s in zip(members, share[i]):
                now[m] += s * n
                if done[i]:
                    count[m] += s * n
        tpm = rated(now)
        it += 1
    return tpm, it


def test_expectation():
    rng = random.Random(1)
    for _ in range(20):
        k = rng.randint(2, 8)
        lengths, unique = [rng.randint(60, 900) for _ in range(k)], [float(rng.randint(0, 30)) for _ in range(k)]
        classes = [(sorted(rng.sample(range(k), rng.randint(2, k))), float(rng.randint(1, 50))) for _ in range(rng.randint(0, 6))]
        member, of = [m for c, _ in classes for m in c], [i for i, (c, _) in enumerate(classes) for _ in c]
        tpm, count, it = Q.expectation(np.array(unique), np.array(lengths, float), np.array(member, int), np.array(of, int), np.array([n for _, n in classes]), 50, 1, 3000)
        want, rounds = slow_expectation(unique, lengths, classes, 50, 1, 3000)
        assert it == rounds and np.allclose(tpm, want, atol=0.11)
        assert abs(count.sum() - sum(unique) - sum(n for _, n in classes)) < 0.01 * max(1, sum(n for _, n in classes))


@pytest.fixture(scope="module")
def counted(spark, kept, built, index):  # noqa: F811
    aligned = kept(A.align(frame(spark, READS), *index, SMALL))
    return aligned, kept(Q.added(Q.count(Q.single_paths(aligned))))


def test_abundance(spark, kept, built, counted):  # noqa: F811
    aligned, _ = counted
    best = A.best_alignment(F.col("alignments"))
    counts = kept(Q.count(aligned.select(best["gene"].alias("gene"), Q.nodes_of(best).alias("path"), F.lit(100.0).alias("value"))))
    lengths = G.isoform_lengths(built["paths"], built["nodes"])
    classes = kept(Q.classes(counts, built["paths"]))
    assert 0 < classes.agg(F.sum("n")).first()[0] <= 100 * aligned.count()
    tx = Q.abundance(lengths, classes, 20, 1)
    rows = tx.collect()
    assert len(rows) == 7 and abs(sum(r["tpm"] for r in rows) - 1e6) < 1
    assert abs(Q.gene_abundance(tx).agg(F.sum("tpm")).first()[0] - 1e6) < 1
    named = Q.with_names(lengths.select(F.col("transcript").alias("name")), spark.createDataFrame([("def", 2.5)], "name string, tpm double"))
    assert {r["name"]: r["tpm"] for r in named.collect()}["def"] == 2.5 and named.where("tpm = 0").count() == 6


def test_several_places(spark, built):  # noqa: F811
    place = lambda *p: ("one", list(p), None)
    multi = spark.createDataFrame([([place(1, 2), place(1)], 10.0), ([place(1, 7), ("single", [1], None)], 4.0)], "places array<struct<gene:string,path:array<int>,mate:array<int>>>, n double")
    classes = {len(r["transcripts"]): r for r in Q.multi_classes(multi, built["paths"]).collect()}
    assert [t["transcript"] for t in classes[3]["transcripts"]] == ["apa_alt5", "def", "int1_alt3"] and classes[3]["whole"] and not classes[0]["whole"]
    even = built["paths"].select("gene", "transcript", F.when(F.col("gene") == "one", 1.0).otherwise(9.0).alias("tpm"), F.lit(0.0).alias("count"))
    got = {(r["gene"], r["kind"], tuple(r["path"])): r["n"] for r in Q.assigned(Q.multi_classes(multi, built["paths"]), built["paths"], even).collect()}
    assert abs(got["one", "node", (1,)] - 7.5) < 1e-3 and abs(got["one", "edge", (1, 2)] - 2.5) < 1e-3
    # The other class isn't annotated in all places: genes' abundances 3 and 9 deal it.
    assert abs(got["one", "edge", (1, 7)] - 1) < 1e-9 and abs(got["single", "node", (1,)] - 3) < 1e-9


def brute_shares(inclusion, exclusion, used):
    """Expectation and maximization over two lists of paths, edge by edge."""
    every = [*inclusion, *exclusion]
    steps = [set(zip(p, p[1:])) for p in every]
    sizes = [sum(e in s for e in used) for s in steps]
    alone, shared = [0.0] * len(every), {}
    for e, n in used.items():
        at = [i for i, s in enumerate(steps) if e in s]
        if len(at) == 1:
            alone[at[0]] += n
        elif at:
            shared[tuple(at)] = shared.get(tuple(at), 0) + n
    psi = None
    for it in range(1500):
        total = list(alone)
        for at, n in shared.items():
            w = [1.0 if it == 0 else psi[i] for i in at]
            for i, x in zip(at, w):
                total[i] += n * x / sum(w)
        rate = [t / s for t, s in zip(total, sizes)]
        new = [float(f"{r / sum(rate):.4g}") for r in rate]
        if new == psi:
            break
        psi = new
    return psi


def test_spliced_event():
    e = E.spliced(2, "CE", {(1, 2): 10.0, (2, 3): 14.0, (1, 3): 6.0})
    assert [p for p, _ in e.inclusion] == [(1, 2, 3)] and [p for p, _ in e.exclusion] == [(1, 3)] and abs(e.psi - 12 / 18) < 1e-3 and e.total == 30
    assert E.spliced(2, "CE", {(1, 2): 1.0}).psi is None and E.spliced(2, "AD", {(1, 2): 1.0}).psi == 1 and E.spliced(2, "CE", {(1, 3): 1.0}).psi == 0 and E.spliced(2, "CE", {}).psi is None
    # Node 4: edges that touch it or pass over it, and those that join them further out.
    e = E.spliced(4, "CE", {k: float(v) for k, v in EDGES.items()})
    used = {k: v for k, v in EDGES.items() if k in {(2, 4), (3, 4), (4, 6), (3, 6), (3, 10), (1, 2), (1, 3), (2, 3)} or k[0] >= 5}
    strong = {k for k, v in EDGES.items() if k[0] <= 4 <= k[1] and v / 790 >= 0.02}
    assert strong == {(2, 4), (3, 4), (4, 6)} and e.psi == 1.0 and not e.solved
    edges = {(1, 2): 60.0, (2, 3): 50.0, (2, 4): 20.0, (3, 4): 45.0, (4, 5): 62.0, (1, 5): 9.0, (2, 5): 3.0}
    e = E.spliced(3, "CE", edges)
    want = brute_shares([p for p, _ in e.inclusion], [p for p, _ in e.exclusion], {k: v for k, v in edges.items() if k[0] <= 3 <= k[1]} | {(1, 2): 60.0, (4, 5): 62.0})
    assert np.allclose([x for _, x in (*e.inclusion, *e.exclusion)], want, rtol=1e-3) and abs(e.psi - sum(want[: len(e.inclusion)])) < 1e-3 and used


def test_tandem_ends():
    motifs = ["NA", "TE", "TE"]
    used, found, total = E.tandem(2, motifs, {1: 10.0, 2: 4.0, 3: 2.0}, {(1, 2): 6.0, (2, 3): 3.0}, {1: 200.0, 2: 100.0, 3: 100.0}, 50)
    assert used == [1, 2, 3] and [p for _, p, _ in found] == [(1,), (1, 2), (1, 2, 3)] and total == 25 and abs(sum(x for *_, x in found) - 1) < 1e-3
    used, found, _ = E.tandem(1, ["TS", "TS", "CE"], {1: 1.0, 2: 2.0, 3: 9.0}, {}, {1: 100.0, 2: 100.0, 3: 100.0}, 50)
    assert used == [1, 2, 3] and {n: p for n, p, _ in found} == {3: (3,), 2: (2, 3), 1: (1, 2, 3)}
    assert {n: p for n, p, _ in E.tandem(1, ["TS", "TS", "CE"], {1: 1.0, 2: 2.0, 3: 9.0}, {}, {1: 100.0, 2: 100.0, 3: 100.0}, 50, True)[1]} == {1: (3,), 2: (2, 3), 3: (1, 2, 3)}
    assert E.tandem(2, motifs, {1: 1.0}, {}, {1: 1.0, 2: 1.0, 3: 1.0}, 50)[1] == []


def test_events_and_result_lines(spark, kept, built, counted, tmp_path):  # noqa: F811
    _, counts = counted
    flat = Q.added(Q.decomposed(counts), spark.createDataFrame([("one", "circ", [5, 3], None, 2.0)], "gene string, kind string, path array<int>, mate array<int>, n double"))
    flat = kept(flat)
    rows = kept(E.inclusion(built["nodes"], flat, 20, circles=True))
    lines = [r["value"] for r in tables.psi_lines(rows, built["nodes"], built["genes"]).orderBy("gene", "node").collect()]
    assert lines and all(len(x.split("\t")) == 14 for x in lines) and len(tables.PSI_HEADER.split("\t")) == 14
    circle = next(x.split("\t") for x in lines if x.split("\t")[4] == "BS")
    assert circle[:3] == ["one", "5-3", "chr0:62-31"]
    tables.write(tables.psi_lines(rows, built["nodes"], built["genes"]), str(tmp_path / "x.psi"), tables.PSI_HEADER, ["gene", "node"])
    got = text.psi_file(spark, str(tmp_path / "x.psi"))
    assert got.count() == len(lines) and sorted("\t".join(("NA" if v is None else str(v)) for v in r[:5]) for r in got.collect()) == sorted("\t".join(x.split("\t")[:5]) for x in lines)
    for f in glob.glob(str(tmp_path / "x.psi/*.gz")):
        assert gzip.open(f).read().startswith(b"Gene\t")
    found = Q.junctions(flat, built["nodes"], built["genes"], built["paths"])
    assert {(r["l"], r["r"]): (r["donor"], r["acceptor"], r["class"]) for r in found.collect()}[1, 3] == (20, 31, "ALT_ANNO")
    assert all(len(r["value"].split("\t")) == 6 for r in tables.junction_lines(found).collect())
    stats = Q.mapping_statistics(flat, built["paths"], 10, 10, 0, 15)
    said = [r["value"] for r in tables.statistics_lines(stats, "index", "v").orderBy("line").collect()]
    assert "Mapped_Percent\t100.0%" in said and len(said) == 22 and sum(x.startswith("#") for x in said) == 5
    exons = tables.exon_lines(G.potential_exons(built["nodes"], built["paths"]), built["genes"])
    assert "one\tchr0:51-62:+\t4,5\tY" in {r["value"] for r in exons.collect()}


def test_sam(spark, built, counted):  # noqa: F811
    aligned, _ = counted
    reads = frame(spark, READS)
    rows = {}
    for r in sam.sam_lines(reads, aligned, built["nodes"], built["genes"]).collect():
        f = r["value"].split("\t")
        if int(f[1]) & 0x100 == 0:
            rows[f[0]] = f
    for name, seq, _ in READS:
        f = rows[name]
        assert len(f) == 11 and f[2] == "chr0" and len(f[9]) == len(f[10]) == len(seq)
        if f[1] in ("0",):  # genes of the forward strand
            assert f[5] == name.split("%")[0] and int(f[3]) == int(name.split("%")[1].split(",")[0])
    assert sum(f[1] == "0" for f in rows.values()) >= 8
    assert [r["value"] for r in sam.header_lines(built["nodes"], built["genes"]).orderBy("place").collect()] == ["@HD\tVN:1.0\tSO:unsorted", "@SQ\tSN:chr0\tLN:10086"]


def test_index_round_trip(spark, built, tmp_path):  # noqa: F811
    tables.save_index(str(tmp_path), nodes=built["nodes"], paths=built["paths"])
    got = tables.load_index(spark, str(tmp_path), "nodes", "paths")
    assert sorted(map(tuple, got["nodes"].collect())) == sorted(map(tuple, built["nodes"].collect())) and got["paths"].count() == 7


def test_difference(spark, tmp_path):
    line = lambda psi, n, k: f"g\t2\tc:1-9\t+\tCE\t{psi}\t0.1\t0,1\t{n}\tK{k}\t0.5\tNA\tNA\tNA"
    for name, rows in {"a1": [line(0.9, 40, 1)], "a2": [line(0.8, 60, 2)], "b1": [line(0.2, 50, 1)], "b2": [line("NA", "NA", 3), line(0.1, 2, 9)]}.items():
        (tmp_path / f"{name}.psi").write_text("\n".join([tables.PSI_HEADER, *rows, "g\t1-1\tc:1-1\t+\tBS\t0.5\t0\t0,1\t9\tNA\tNA\tNA\tNA\tNA"]) + "\n")
    a, b = (P.replicates(text.psi_file(spark, [f"{tmp_path}/{s}{i}.psi" for i in (1, 2)])) for s in "ab")
    r = P.compared(a, b).collect()
    assert len(r) == 1 and abs(r[0]["psi_a"] - (37 / 42 + 49 / 62) / 2) < 1e-4 and abs(r[0]["psi_b"] - 11 / 52) < 1e-4 and r[0]["probability"] > 0.99 and r[0]["complexity"] == 2
    assert len(tables.diff_lines(P.compared(a, b)).first()["value"].split("\t")) == len(tables.DIFF_HEADER.split("\t")) and P.compared(a, b, least_samples=2).count() == 0


def test_bias(spark, kept):
    rng = random.Random(3)
    reads = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(60))) for i in range(400)], "read_id int, seq string")
    weights = kept(B.primer_weights(reads))
    seen = {r["hexamer"] for r in weights.collect()}
    assert seen == {r["seq"][i : i + 6] for r in reads.collect() for i in (0, 1)}
    value = {r["hexamer"]: r["weight"] for r in weights.collect()}
    for r in B.primer_adjusted(reads, weights).limit(20).collect():
        assert abs(r["value"] - (value[r["seq"][:6]] + value[r["seq"][1:7]]) / 2) < 1e-9
    bins = reads.limit(5).select("seq", B.gc_bins(F.col("seq")).alias("b")).collect()
    assert all(r["b"] == [int(((r["seq"][4:54].count("G") + r["seq"][4:54].count("C")) / 50) // 0.05) + 1] for r in bins)
    w = {r["bin"]: r["weight"] for r in B.gc_weights(reads, spark.createDataFrame([([0.05] * 20, 1.0)], "expected array<double>, tpm double")).collect()}
    counts = spark.createDataFrame([("g", "node", [1], None, 8.0), ("g", "node", [2], None, 5.0)], "gene string, kind string, path array<int>, mate array<int>, n double")
    some = next(iter(w))
    seen = spark.createDataFrame([("g", "node", [1], None, some, 4)], "gene string, kind string, path array<int>, mate array<int>, bin int, k int")
    weights = spark.createDataFrame(list(w.items()), "bin int, weight double")
    got = {r["path"][0]: r["n"] for r in B.gc_adjusted(counts, seen, weights, ["gene", "kind", "path", "mate"]).collect()}
    assert abs(got[1] - 8 * w[some]) < 1e-9 and got[2] == 5


def test_simulation(spark, kept, built, tmp_path):  # noqa: F811
    edges = ["SL", "LL", "RR", "LR", "RR", "LL", "LR", "RS", "RS"]
    for path in S.paths(edges):
        assert S.valid(path, edges) and edges[path[0] - 1] in ("SL", "LS") and edges[path[-1]] in ("SR", "RS")
    assert [1, 3, 5, 7] in S.paths(edges) and [1, 2, 3, 4, 5, 7] in S.paths(edges) and [1, 3, 5, 6, 7, 8] in S.paths(edges) and S.skipping(edges, {2}) == [1, 3, 4, 5, 6]
    tx = kept(S.combinatorial(built["nodes"].where("gene = 'one'")))
    assert {tuple(r["nodes"]) for r in tx.collect()} == {tuple(p) for p in S.paths(edges)}
    lines = sorted(r["value"] for r in S.gtf_lines(tx, built["nodes"], built["genes"]).collect())
    (tmp_path / "s.gtf").write_text("\n".join(r["value"] for r in S.gtf_lines(tx, built["nodes"], built["genes"]).orderBy("transcript", "start").collect()))
    back = {r["transcript"]: r for r in T.transcripts(text.gtf(spark, str(tmp_path / "s.gtf"))).collect()}
    assert (back["one_1-3-5-7"]["acc"], back["one_1-3-5-7"]["don"]) == ([6, 31, 54, 76], [20, 40, 62, 85]) and lines
    seqs = G.node_sequences(built["nodes"], built["genes"], built["pieces"])
    fasta = {r["transcript"]: r["value"] for r in S.fasta_lines(tx, seqs).collect()}
    assert fasta["one_1-3-5-7"].split("\n")[1] == "TTATTGCGGATTACAGCATTAGAAGCTATGCTAGTTAGACAAGA"
    some = S.random_skips(built["nodes"], seed=4)
    assert sorted(map(tuple, some.select("transcript").collect())) == sorted(map(tuple, S.random_skips(built["nodes"], seed=4).select("transcript").collect())) and some.select("gene").distinct().count() == 4
    assert S.possible_counts(tx).first()["isoforms"] == tx.count() and S.first_genes(built["nodes"], 1, 1).select("gene").distinct().collect()[0][0] == "one" and S.sampled_genes(built["nodes"], 2).select("gene").distinct().count() == 2


def test_truth(spark, built):  # noqa: F811
    tpm = spark.createDataFrame([("one", "def", 1.0), ("one", "int1_alt3", 2.0), ("one", "apa_alt5", 5.0)], "gene string, transcript string, tpm double")
    got = {r["node"]: r["psi"] for r in E.truth(built["nodes"], built["paths"], tpm).collect()}
    assert abs(got[4] - 2 / 8) < 1e-9 and abs(got[6] - 5 / 8) < 1e-9 and 1 not in got


def test_streaming_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"gene":"g","read":"a","path":[1,2,3],"at":"2024-01-01T00:01:00Z"}\n{"gene":"g","read":"b","path":[1,2],"at":"2024-01-01T00:12:00Z"}\n')
    for name, counts in (("running", stream.running_edges(stream.path_stream(spark, str(folder)))), ("windowed", stream.windowed_edges(stream.path_stream(spark, str(folder))))):
        query = stream.start(counts, name, str(tmp_path / name))
        query.processAllAvailable()
        query.stop()
    assert {(r["l"], r["r"]): r["n"] for r in spark.table("running").collect()} == {(1, 2): 2, (2, 3): 1}
    assert sorted(r["n"] for r in spark.table("windowed").collect()) == [1, 1, 1]
