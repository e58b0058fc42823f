"""From annotation, genome and reads to result files and back, for simulated reads of known transcripts."""

import glob
import gzip
import random

import pytest

from lariat import programs
from lariat.sinks import tables
from tests.test_graph import gtf_lines


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    """Two genes of long exons, one on each strand; reads of their transcripts."""
    path, rng = tmp_path_factory.mktemp("world"), random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    exons = {"fore": [(101, 260), (401, 520), (701, 860)], "back": [(2101, 2300), (2501, 2620), (2801, 3000)]}
    rows = [("fore", "f1", "+", exons["fore"]), ("fore", "f2", "+", [exons["fore"][0], exons["fore"][2]]), ("back", "b1", "-", exons["back"]), ("back", "b2", "-", [exons["back"][0], exons["back"][2]])]
    (path / "a.gtf.gz").write_bytes(gzip.compress("\n".join(gtf_lines(rows)).replace("chr0", "chrA").encode() + b"\n"))
    (path / "g.fa.gz").write_bytes(gzip.compress((">chrA\n" + "\n".join(genome[i : i + 70] for i in range(0, 4000, 70)) + "\n").encode()))
    flip = str.maketrans("ACGT", "TGCA")
    spliced = {t: "".join(genome[a - 1 : b] for a, b in ex) for _, t, _, ex in rows}
    spliced = {t: s.translate(flip)[::-1] if t[0] == "b" else s for t, s in spliced.items()}

    def fastq(name, share, n=600):
        own = random.Random(name)
        records, mates = [], []
        for i in range(n):
            t = own.choice("fb") + ("1" if own.random() < share else "2")
            at = own.randrange(len(spliced[t]) - 180)
            one, two = spliced[t][at : at + 60], spliced[t][at + 120 : at + 180].translate(flip)[::-1]
            if own.random() < 0.5:
                one, two = two, one
            records.append(f"@r{i}/1\n{one}\n+\n{'I' * 60}\n")
            mates.append(f"@r{i}/2\n{two}\n+\n{'I' * 60}\n")
        (path / f"{name}_1.fastq").write_text("".join(records))
        (path / f"{name}_2.fastq.gz").write_bytes(gzip.compress("".join(mates).encode()))

    for name, share in (("a1", 0.8), ("a2", 0.8), ("b1", 0.3)):
        fastq(name, share)
    return path


def lines(folder):
    return [x for f in sorted(glob.glob(f"{folder}/*.gz")) for x in gzip.open(f, "rt").read().splitlines()]


def test_whole_way(spark, world):
    run = lambda *a: programs.main(list(map(str, a)), spark)
    run("index", "--gtf", world / "a.gtf.gz", "--fasta", world / "g.fa.gz", "-x", world / "index")
    assert "back\tchrA:2501-2620:-\t2\tY" in lines(world / "index/exons.tab.gz")
    for name in ("a1", "a2", "b1"):
        run("quant", world / f"{name}_1.fastq", "-x", world / "index", "-o", world / name, *(["--sam"] if name == "a1" else []))
    tpm = {x.split("\t")[0]: x.split("\t") for x in lines(world / "a1.isoform.tpm.gz")}
    assert abs(sum(float(v[1]) for k, v in tpm.items() if k != "Isoform") - 1e6) < 2
    for gene in "fb":
        one, two = (float(tpm[f"{gene}{i}"][1]) for i in (1, 2))
        assert 0.65 < one / (one + two) < 0.92
    stats = dict(x.split("\t") for x in lines(world / "a1.map.gz") if "\t" in x)
    assert int(stats["Total_Reads"]) == 600 and int(stats["Mapped_Reads"]) > 570 and stats["Novel_Junc_Number"] == "0"
    assert {x.split("\t")[3].split(":")[2] for x in lines(world / "a1.jnc.gz")[1:] if x[:5] != "CHROM"} <= {"CON_ANNO", "ALT_ANNO"}
    psi = {name: {tuple(x.split("\t")[:2]): x.split("\t") for x in lines(world / f"{name}.psi.gz") if x[:4] != "Gene"} for name in ("a1", "b1")}
    for gene in ("fore", "back"):
        a, b = (psi[n][gene, "2"] for n in ("a1", "b1"))
        assert a[4] == b[4] == "CE" and 0.7 < float(a[5]) < 0.92 and 0.15 < float(b[5]) < 0.45 and len(a) == 14
    run("delta", "-a", f"{world}/a1.psi.gz,{world}/a2.psi.gz", "-b", f"{world}/b1.psi.gz,", "-o", world / "ab")
    diff = {tuple(x.split("\t")[:2]): x.split("\t") for x in lines(world / "ab.diff.gz")}
    assert all(float(diff[g, "2"][7]) > 0.25 and float(diff[g, "2"][8]) > 0.99 for g in ("fore", "back"))
    sam = [x for f in sorted(glob.glob(f"{world}/a1.sam/part-*")) for x in open(f).read().splitlines()]
    assert sam[0].startswith("@HD") and sum(x[0] != "@" for x in sam) >= int(stats["Mapped_Reads"]) and all(len(x.split("\t")) == 11 for x in sam if x[0] != "@")


def test_pairs_and_bias(spark, world):
    programs.main(["quant", f"{world}/a1_1.fastq", f"{world}/a1_2.fastq.gz", "-x", f"{world}/index", "-o", f"{world}/paired", "--biascorrect", "--circ"], spark)
    stats = dict(x.split("\t") for x in lines(world / "paired.map.gz") if "\t" in x)
    assert int(stats["Mapped_Reads"]) > 550
    psi = {tuple(x.split("\t")[:2]): x.split("\t") for x in lines(world / "paired.psi.gz") if x[:4] != "Gene"}
    assert all(0.6 < float(psi[g, "2"][5]) < 0.98 for g in ("fore", "back"))


def test_simulated(spark, world):
    programs.main(["simulate", "-x", f"{world}/index", "-o", f"{world}/simul"], spark)
    names = {x[1:] for x in lines(world / "simul.fa.gz") if x[0] == ">"}
    assert {"fore_1-2-3", "fore_1-3", "back_1-2-3", "back_1-3"} <= names
    assert all(x.split("\t")[2] == "exon" for x in lines(world / "simul.gtf.gz"))
    assert tables.load_index(spark, f"{world}/index", "node")["node"].count() == 6


def test_compare_needs_both_sides(spark, tmp_path):
    with pytest.raises(ValueError, match="one side"):
        programs.compare(spark, [], ["x"], str(tmp_path))
