"""Plans whose rows stay small and meet in no single task, and the operators behind them against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lariat.functions.partitions import dealt
from lariat.operators import graph as G
from lariat.operators import transcripts as T
from lariat.plans import catalog
from lariat.sources import text

DIR = "/root/testdata/sf0.001"


def plan_nodes(df):
    """(name, types of its columns) of every node of the optimized plan."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        yield node.nodeName(), [node.output().apply(i).dataType().typeName() for i in range(node.output().size())]


def test_windows_over_nodes_carry_no_arrays(spark):
    found = [types for name, types in plan_nodes(catalog.queries()["graph_nodes"](spark, DIR)) if name == "Window"]
    assert found and not any("array" in types for types in found)


def drawn_exons(spark, kept, genes=40, seed=1):
    """Random exons of overlapping and kissing transcripts on both strands, as rows."""
    r, rows = random.Random(seed), []
    for g in range(genes):
        for t in range(r.randint(1, 6)):
            at = r.randint(1, 15)
            for _ in range(r.randint(1, 5)):
                end = at + r.randint(0, 9)
                rows.append(("c", "+-"[g % 2], g, 10 * g + t, at, end))
                at = end + r.choice([1, 1, 2, 5, 9])
    return kept(spark.createDataFrame(rows, "chrom string, strand string, gene long, transcript long, start long, end long"))


def test_exons_as_rows_or_arrays(spark, kept):
    exons = drawn_exons(spark, kept)
    genes = kept(T.genes(T.transcripts(exons)))
    rows, arrays = (sorted(map(tuple, G.nodes(genes, x).collect())) for x in (exons, T.distinct_exons(exons)))
    assert rows and rows == arrays


def test_paths_are_the_nodes_that_begin_in_exons(spark, kept):
    exons = drawn_exons(spark, kept, seed=2)
    tx = kept(T.transcripts(exons))
    genes = kept(T.genes(tx))
    nodes = kept(G.nodes(genes, exons))
    strand, of = {r["gene"]: r["strand"] for r in genes.collect()}, {}
    for r in sorted(nodes.collect()):
        of.setdefault(r["gene"], []).append(r)
    want = {}
    for r in exons.collect():
        own = of[r["gene"]]
        twin = {a["node"] for a, b in zip(own, own[1:]) if a["coord"] == b["coord"]}
        inside = {n["node"] for n in own if r["start"] <= n["coord"] <= r["end"] and not (strand[r["gene"]] == "+" and n["node"] in twin and n["coord"] == r["start"])}
        want.setdefault(r["transcript"], set()).update(inside)
    size = {(n["gene"], n["node"]): n["length"] for own in of.values() for n in own}
    got = G.annotated_paths(nodes, genes, tx).collect()
    assert {r["transcript"]: r["nodes"] for r in got} == {t: sorted(x) for t, x in want.items() if x}
    for r in got:
        runs = [tuple(x) for x in r["runs"]]
        assert [n for a, b in runs for n in range(a, b + 1)] == r["nodes"] and all(a[1] + 1 < b[0] for a, b in zip(runs, runs[1:]))
        assert r["length"] == sum(size[r["gene"], n] for n in r["nodes"])


def test_paths_shuffle_order_lines_once(spark):
    plan = catalog.queries()["graph_paths"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_lines_are_dealt_out_once_by_read(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        plan = catalog.queries()["circ_counts"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_NUM" in plan and not [x for x in plan.split("\n") if "hashpartitioning(gene#" in x and "read#" in x]


def test_partitions_grow_with_the_table(spark):
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_orderkey")
    few, many = (dealt(lines, "l_orderkey", size=n).rdd.getNumPartitions() for n in (1 << 30, 256))
    assert few == 4 and many > 8


def test_exons_by_runs_of_paths(spark, kept):
    exons = drawn_exons(spark, kept, seed=3)
    tx = kept(T.transcripts(exons))
    genes = kept(T.genes(tx))
    nodes = kept(G.nodes(genes, exons))
    paths = kept(G.annotated_paths(nodes, genes, tx))
    of, held = {}, {}
    for r in sorted(nodes.collect()):
        of.setdefault(r["gene"], []).append(r)
    for r in paths.collect():
        held.setdefault(r["gene"], []).append(set(r["nodes"]))
    want = set()
    for g, own in of.items():
        for i, a in enumerate(own):
            for b in own[i:] if a["edge_in"] in ("LR", "RR", "SR", "LS", "SL") else []:
                if b["edge_out"] in ("LR", "LL", "SR", "LS", "RS"):
                    inside = any(p.issuperset(range(a["node"], b["node"] + 1)) for p in held.get(g, []))
                    want.add((g, a["node"], b["node"], min(a["coord"], b["coord"]), max(x["coord"] + x["length"] - 1 for x in (a, b)), inside))
                if b["edge_out"] in ("LR", "LS", "SR"):
                    break
    found = G.potential_exons(nodes, paths)
    assert sorted(map(tuple, found.select("gene", "first", "last", "low", "high", "annotated").collect())) == sorted(want)
    assert "collect_list(nodes" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_side_by_side_across_groups(spark):
    def checked(rows):
        lines = spark.createDataFrame(rows, "transcript string, file string, block long, line long")
        return text.side_by_side(lines.select("transcript", F.struct("file", "block", "line").alias("place")))

    good = [("a", "f", 0, 1), ("a", "f", 5000, 2), ("b", "f", 5000, 3), ("b", "f", 1 << 25, 4), ("c", "f", 1 << 25, 5), ("d", "g", 0, 1)]
    assert checked(good).count() == 6 and checked(good[:0]).count() == 0
    for late in [("x", "f", 0, 0), ("x", "f", 4097, 1), ("x", "f", 1 << 24, 1)]:
        with pytest.raises(Exception, match="side by side"):
            checked([*good, late, (late[0], "f", 1 << 26, 9)]).collect()
    partitions = [w for w in checked(good)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in w]
    assert len(partitions) == 3
