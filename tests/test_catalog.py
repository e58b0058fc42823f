"""Every registered query against its SQL in DuckDB on the smallest tables, and small fixtures of sources and functions."""

import glob
import gzip
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lariat.functions import beta
from lariat.functions import sequence as S
from lariat.operators import graph as G
from lariat.operators import transcripts as T
from lariat.plans import catalog
from lariat.sources import text

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    assert len(got.columns)
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        got, want = (x[columns].sort_values(columns).reset_index(drop=True).astype(object) for x in (got, want))
        assert got.where(got.notna(), None).equals(want.where(want.notna(), None))


ANNOTATION = [
    ("one", "def", "+", [(6, 20), (31, 40), (54, 62), (76, 85)]),
    ("one", "int1_alt3", "+", [(6, 40), (51, 62), (76, 85)]),
    ("one", "apa_alt5", "+", [(6, 20), (31, 40), (54, 65), (76, 90)]),
    ("single", "ex1_single", "+", [(11, 20)]),
]


def test_annotation(spark, tmp_path):
    lines = ["# comment"] + [f'chr0\tx\texon\t{a}\t{b}\t.\t{s}\t.\tgene_id "{g}"; transcript_id "{t}"; transcript_support_level "1";' for g, t, s, exons in ANNOTATION for a, b in exons] + ['chr0\tx\tCDS\t1\t2\t.\t+\t.\tgene_id "one";']
    path = tmp_path / "a.gtf.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    one = {r["gene"]: r for r in T.genes(T.transcripts(text.gtf(spark, str(path), True))).collect()}["one"]
    assert (one["don"], one["acc"]) == ([20, 40, 62, 65], [31, 51, 54, 76])


def test_sequence_files(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 x\nACGT\nacgn\n>chr2\nTT\n")
    assert {tuple(r) for r in text.sequences(text.fasta(spark, str(tmp_path / "g.fa"))).collect()} == {("chr1", "ACGTACGN"), ("chr2", "TT")}
    path = tmp_path / "r.fastq.gz"
    path.write_bytes(gzip.compress(b"@r1 a\nACNT\n+\nIIII\n@r2\nGG\n+\n!I\n"))
    assert {r["read_id"]: (r["seq"], list(r["quality"])) for r in text.fastq(spark, str(path)).collect()} == {"r1": ("ACAT", [40] * 4), "r2": ("GG", [0, 40])}


def test_expressions(spark):
    r = spark.range(1).select(S.kmer_index(F.lit("ATG")).alias("k"), S.kmer_index(F.lit("ANG")).alias("n"), S.reverse_complement(F.lit("AACG")).alias("rc"), S.complexity(F.lit(9)).alias("c"), S.shannon(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))).alias("h"), S.significant(F.lit(0.123456), 3).alias("s")).first()
    assert (r["k"], r["n"], r["rc"], r["c"], r["h"], r["s"]) == (15, None, "CGTT", 4, 1.0, 0.123)


def test_more_expressions(spark):
    seq, quality = S.reversed_record(F.lit("AACG"), F.array(*map(F.lit, (1, 2, 3, 4))))
    r = spark.range(1).select(S.kmer_number(F.lit("ATG")).alias("k"), S.kmer_number(F.lit("ANG")).alias("n"), S.two_bit(F.lit("acgn")).alias("t"), seq.alias("s"), quality.alias("q"), S.gc_bin(F.lit(15)).alias("g"), S.gc_bin(F.lit(50)).alias("h")).first()
    assert (r["k"], r["n"], r["t"], r["s"], r["q"], r["g"], r["h"]) == (14, 0, "ACGA", "CGTT", [4, 3, 2, 1], 6, 20)
    bins = [x[0] for x in spark.range(51).orderBy("id").select(S.gc_bin(F.col("id"))).collect()]
    assert bins == [int((i / 50) // 0.05) + 1 for i in range(51)]
    edges = [(G.edge_type(F.lit(a), F.lit(b), F.lit(n))) for a, b, n in ((1, 2, True), (3, 2, False), (3, 4, False), (1, 2, False))]
    assert list(spark.range(1).select(*edges, G.edge_code(F.lit("LR")), G.is_donor_edge(F.lit("LS")), G.is_acceptor_edge(F.lit("LS"))).first()) == ["RS", "LR", "LS", "SR", 4, True, False]


def test_beta_of_null(spark):
    r = spark.createDataFrame([(2.0, 3.0, 4.0, 1.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double").select(beta.probability()("a", "b", "c", "d").alias("p"), beta.probability(0.2)("a", "b", "c", "d").alias("q")).collect()
    assert r[1]["p"] is None and 0.9 < r[0]["p"] < 1 and 0 < r[0]["q"] < r[0]["p"]


def test_beta():
    assert np.allclose(beta.cdf([0.5, 0.2, 0.9], [2, 1, 5], [2, 3, 1]), [0.5, 1 - 0.8**3, 0.9**5])
    assert np.allclose(beta.cdf(beta.quantile(0.3, [3, 200], [4, 100]), [3, 200], [4, 100]), 0.3)
    assert np.allclose(beta.greater([2, 5], [2, 1], [2, 1], [2, 5]), [0.5, 1 - 1 / 252], atol=2e-3)
