"""Simulated transcripts of a splice graph: all valid combinations of nodes, or random skips, as FASTA and GTF lines."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STARTS, _STOPS = ("SL", "LS"), ("SR", "RS")
_LEAVES, _LANDS = ("LS", "LR", "LL"), ("SR", "LR", "RR")


def valid(path: list[int], edges: list[str]) -> bool:
    """Whether a path (nodes from 1) goes through the graph: edges[i] stands before node i + 1.

    Neighbours must not be kept apart by an end of a transcript; other steps need a site to leave and one to reach.
    """
    return all((edges[b - 1] not in ("LS", "SR")) if b == a + 1 else (edges[a] in _LEAVES and edges[b - 1] in _LANDS) for a, b in zip(path, path[1:]))


def paths(edges: list[str], most: int = 10) -> list[list[int]]:
    """All valid paths from a first to a last node. Where ``most`` nodes or more lie between, combinations of that many
    neighbours slide along while the others all stay, so a path may come more than once; each is listed once."""
    n = len(edges) - 1
    found: dict[tuple[int, ...], None] = {}
    for a in (i for i in range(1, n + 1) if edges[i - 1] in _STARTS):
        for b in (i for i in range(1, n + 1) if edges[i] in _STOPS):
            if b - a <= 1:
                if b >= a:
                    found[tuple(range(a, b + 1))] = None
                continue
            between = range(a + 1, b)
            windows = [between] if len(between) < most else [range(at, at + most) for at in range(a + 1, b - most + 1)]
            for window in windows:
                before, after = range(a, window.start), range(window.stop, b + 1)
                for k in range(len(window) + 1):
                    for chosen in combinations(window, k):
                        path = (*before, *chosen, *after)
                        if valid(list(path), edges):
                            found[path] = None
    return [list(p) for p in found]


def skipping(edges: list[str], skip: set[int]) -> list[int]:
    """The nodes of a transcript that leaves out ``skip`` where a splice can, and with them what can't follow."""
    out, spliced, waits, n = [], False, False, len(edges) - 1
    for node in range(1, n + 1):
        if spliced and (node in skip or edges[node - 1] in _STARTS or edges[node] in _STOPS and node < n):
            waits = True
        elif not (waits and edges[node - 1] not in ("RR", "LR", "SR")):
            out.append(node)
            spliced, waits = edges[node] in _LEAVES, False
    return out


def _edges(nodes: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("node", "edge_in", "edge_out")))
    return nodes.groupBy("gene").agg(listed.alias("n")).select("gene", F.concat(F.transform("n", lambda x: x["edge_in"]), F.array(F.element_at("n", -1)["edge_out"])).alias("edges"))


def first_genes(nodes: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """The nodes of n genes by name, after ``skip`` of them."""
    return nodes.join(F.broadcast(nodes.select("gene").distinct().orderBy("gene").offset(skip).limit(n)), "gene", "left_semi")


def sampled_genes(nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The nodes of n genes, the same ones for a seed."""
    return nodes.join(F.broadcast(nodes.select("gene").distinct().orderBy(F.xxhash64("gene", F.lit(seed)), "gene").limit(n)), "gene", "left_semi")


def combinatorial(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(gene, transcript, nodes) of all valid paths; a transcript is called by its gene and nodes."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(g, f"{g}_{'-'.join(map(str, p))}", p) for g, e in pdf[["gene", "edges"]].itertuples(index=False) for p in paths(list(e), most)]
        return pd.DataFrame(rows, columns=["gene", "transcript", "nodes"])

    kind = nodes.schema["gene"].dataType.simpleString()
    return _edges(nodes).groupBy("gene").applyInPandas(one, f"gene {kind}, transcript string, nodes array<int>")


def possible_counts(transcripts: DataFrame) -> DataFrame:
    """One row: isoforms and distinct junctions of simulated transcripts."""
    step = F.explode(F.when(F.size("nodes") > 1, F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.slice("nodes", i, 2))))
    return transcripts.agg(F.count(F.lit(1)).alias("isoforms")).join(F.broadcast(transcripts.select("gene", step.alias("s")).distinct().agg(F.count(F.lit(1)).alias("junctions"))))


def random_skips(nodes: DataFrame, most: int = 8, seed: int = 0) -> DataFrame:
    """(gene, transcript, nodes): each gene whole, and with all combinations left out of a stretch of nodes drawn by seed."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, tuple] = {}
        for gene, edges, key in pdf[["gene", "edges", "key"]].itertuples(index=False):
            edges, rng = list(edges), np.random.default_rng([seed, key & (1 << 63) - 1])
            n = len(edges) - 1
            k = int(rng.integers(1, max(1, min(most, n - 2)) + 1))
            skips: list[tuple[int, ...]] = [()]
            if n > 2:
                at = int(rng.integers(1, max(1, n - k) + 1))
                skips += [c for i in range(1, k + 1) for c in combinations(range(at, at + k), i)]
            for s in skips:
                p = skipping(edges, set(s))
                rows.setdefault(f"{gene}_K{k}_{'-'.join(map(str, p))}", (gene, p))
        return pd.DataFrame([(g, name, p) for name, (g, p) in rows.items()], columns=["gene", "transcript", "nodes"])

    kind = nodes.schema["gene"].dataType.simpleString()
    return _edges(nodes).withColumn("key", F.xxhash64("gene")).groupBy("gene").applyInPandas(one, f"gene {kind}, transcript string, nodes array<int>")


def fasta_lines(transcripts: DataFrame, node_seqs: DataFrame) -> DataFrame:
    """(transcript, value): a header and the sequence of a transcript's nodes; node_seqs: (gene, node, seq)."""
    each = transcripts.select("gene", "transcript", F.posexplode("nodes").alias("i", "node")).join(node_seqs, ["gene", "node"])
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "seq"))), lambda x: x["seq"]), "")
    return each.groupBy("gene", "transcript").agg(seq.alias("seq")).select("transcript", F.concat(F.lit(">"), "transcript", F.lit("\n"), "seq").alias("value"))


def exon_runs(transcripts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gene, transcript, start, end): a transcript's nodes, merged where they lie side by side on the chromosome."""
    each = transcripts.select("gene", "transcript", F.posexplode("nodes").alias("i", "node")).join(nodes.select("gene", "node", "coord", (F.col("coord") + F.col("length") - 1).alias("end")), ["gene", "node"])
    order = Window.partitionBy("gene", "transcript").orderBy("i")
    before, past = F.lag("coord").over(order), F.lag("end").over(order)
    begins = F.when((F.col("coord") == past + 1) | (F.col("end") + 1 == before), 0).otherwise(1)
    runs = each.withColumn("_new", begins).withColumn("run", F.sum("_new").over(order))
    return runs.groupBy("gene", "transcript", "run").agg(F.min("coord").alias("start"), F.max("end").alias("end")).drop("run")


def gtf_lines(transcripts: DataFrame, nodes: DataFrame, genes: DataFrame, source: str = "lariat") -> DataFrame:
    """(transcript, start, value): an exon line of a GTF file for each run of nodes."""
    rows = exon_runs(transcripts, nodes).join(genes.select("gene", "chrom", "strand"), "gene")
    attrs: Column = F.concat(F.lit('gene_id "'), F.col("gene").cast("string"), F.lit('"; transcript_id "'), "transcript", F.lit('";'))
    return rows.select("transcript", "start", F.concat_ws("\t", "chrom", F.lit(source), F.lit("exon"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attrs).alias("value"))
