"""Counting of read paths: nodes, steps between nodes, long paths, and what is drawn from the counts.

Tables are DataFrames: hits(gene, read, node), edges(gene, l, r, n). Every aggregate has partial results before its
shuffle, and the keys are (gene, node), so no gene gathers in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.functions.sequence import complexity, is_connecting, is_spanning


def paths(hits: DataFrame) -> DataFrame:
    """(gene, read, path): a read's distinct nodes in order."""
    return hits.groupBy("gene", "read").agg(F.array_sort(F.collect_set("node")).alias("path"))


def node_counts(paths: DataFrame) -> DataFrame:
    """Reads that lie within one node."""
    return paths.where(F.size("path") == 1).groupBy("gene", F.col("path")[0].alias("node")).agg(F.count(F.lit(1)).alias("n"))


def edge_counts(paths: DataFrame) -> DataFrame:
    """Reads over each step of consecutive nodes, long paths by each of their steps."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("l"), F.element_at("path", i + 1).alias("r")))
    return paths.where(F.size("path") > 1).select("gene", F.explode(steps).alias("s")).groupBy("gene", "s.l", "s.r").agg(F.count(F.lit(1)).alias("n"))


def long_path_counts(paths: DataFrame) -> DataFrame:
    """Reads over each path of three nodes or more."""
    return paths.where(F.size("path") > 2).groupBy("gene", F.array_join("path", "-").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def back_steps(placed: DataFrame) -> DataFrame:
    """Steps to the same or an earlier node: placed(gene, read, node, at), read in the order of ``at``."""
    order = Window.partitionBy("gene", "read").orderBy("at", "node")
    return placed.withColumn("r", F.lead("node").over(order)).where("node >= r").groupBy("gene", F.col("node").alias("l"), "r").agg(F.count(F.lit(1)).alias("n"))


def minor_steps_dropped(edges: DataFrame, least: float = 0.02) -> DataFrame:
    """Steps of at least a fiftieth of their gene's largest count."""
    top = edges.groupBy("gene").agg(F.max("n").alias("top"))
    return edges.join(top, "gene").where(F.col("n") >= F.col("top") * least).drop("top")


def node_psi(edges: DataFrame) -> DataFrame:
    """Inclusion of each node: steps that end or begin there against steps that pass over it.

    Steps expand to the nodes that they touch or pass, so the interval join is an equi-aggregate on (gene, node).
    Without steps on one side the support rules decide: at least two connecting reads, or one passing read.
    """
    touched = edges.select("gene", "l", "r", "n", F.explode(F.sequence("l", "r")).alias("node"))
    ends, over = (of(F.col("l"), F.col("r"), F.col("node")) for of in (is_connecting, is_spanning))
    c = touched.groupBy("gene", "node").agg(F.sum(F.when(ends, F.col("n")).otherwise(0)).alias("inclusion"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("exclusion"), F.count_if(ends).alias("inc_steps"), F.count_if(over).alias("exc_steps"))
    inc, exc = F.col("inclusion") / F.col("inc_steps"), F.col("exclusion") / F.col("exc_steps")
    psi = F.when((F.col("inclusion") > 0) & (F.col("exclusion") > 0), F.round(inc / (inc + exc), 6)).when((F.col("exclusion") == 0) & (F.col("inclusion") >= 2), 1.0).when((F.col("inclusion") == 0) & (F.col("exclusion") >= 1), 0.0)
    return c.select("gene", "node", "inclusion", "exclusion", psi.alias("psi"), (F.col("inclusion") + F.col("exclusion")).alias("total_reads"))


def step_entropy(edges: DataFrame) -> DataFrame:
    """Per gene: complexity of its number of steps and entropy of their shares."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("gene"))
    return edges.withColumn("p", share).groupBy("gene").agg(F.count(F.lit(1)).alias("k"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy")).select("gene", complexity(F.col("k")).alias("complexity"), "entropy")


def annotated_paths(paths: DataFrame, most: int = 8) -> DataFrame:
    """(gene, tx, nodes): each gene's most read paths, which stand for its transcripts."""
    ranked = paths.groupBy("gene", "path").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("gene").orderBy(F.desc("n"), F.array_join("path", "-"))
    return ranked.withColumn("tx", F.row_number().over(order)).where(F.col("tx") <= most).select("gene", "tx", F.col("path").alias("nodes"))


def _steps(path: Column) -> Column:
    """Pairs of neighbours, as structs (l, r)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.element_at(path, i).alias("l"), F.element_at(path, i + 1).alias("r")))
    return F.when(F.size(path) > 1, pairs)


def compatible(paths: DataFrame, annotated: DataFrame) -> DataFrame:
    """(gene, class, n): for each read path the transcripts that contain it side by side, by class.

    Paths are counted first. A path's nodes or steps meet those of transcripts by equality, and a transcript contains it if
    it has them all, so no gene's paths and transcripts are a product.
    """
    counted = paths.groupBy("gene", "path").agg(F.count(F.lit(1)).alias("n"))
    alone = lambda c: F.struct(c.alias("l"), F.lit(None).cast("int").alias("r"))
    cast = lambda c: F.transform(c, lambda x: x.cast("int"))
    asked = F.when(F.size("path") > 1, _steps(cast("path"))).otherwise(F.transform(cast("path"), alone))
    asked = counted.select("gene", "path", "n", F.size(asked).alias("wanted"), F.explode(asked).alias("s"))
    given = annotated.select("gene", "tx", F.explode(F.concat(F.transform(cast("nodes"), alone), F.coalesce(_steps(cast("nodes")), F.array().cast("array<struct<l:int,r:int>>")))).alias("s"))
    same = (F.col("x.gene") == F.col("y.gene")) & (F.col("x.s.l") == F.col("y.s.l")) & F.col("x.s.r").eqNullSafe(F.col("y.s.r"))
    has = asked.alias("x").join(given.alias("y"), same).groupBy("x.gene", "path", "n", "wanted", "tx").agg(F.count(F.lit(1)).alias("k")).where("k = wanted")
    hit = has.groupBy("gene", "path", "n").agg(F.array_join(F.array_sort(F.collect_list("tx")), ",").alias("class"))
    return hit.groupBy("gene", "class").agg(F.sum("n").alias("n"))


def tpm(counts: DataFrame, read_length: int = 1) -> DataFrame:
    """counts(gene, tx, count, length) with tpm: rates scaled to a million, one digit."""
    rated = counts.withColumn("rate", F.col("count") / F.greatest(F.col("length") - read_length, F.lit(1)))
    total = rated.agg(F.greatest(F.sum("rate"), F.lit(1.0)).alias("total"))  # one row
    return rated.join(F.broadcast(total)).withColumn("tpm", F.round(1e6 * F.col("rate") / F.col("total"), 1)).drop("rate", "total")


def em_shares(classes: DataFrame, rounds: int = 20) -> DataFrame:
    """(gene, tx, count) after ``rounds`` steps of expectation and maximization over classes(gene, class, n).

    A class is a comma-joined list of transcripts. Genes are independent and their classes few, so each is solved whole in
    one Arrow pass. Abundances by lengths, with a rule to stop, are in ``quant.abundance``.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [[int(t) for t in c.split(",")] for c in pdf["class"]]
        tx = np.array(sorted({t for own in lists for t in own}))
        member = np.searchsorted(tx, [t for own in lists for t in own])
        of = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        weight, now = pdf["n"].to_numpy(float), np.ones(len(tx))
        for _ in range(rounds):
            total = np.bincount(of, now[member], len(lists))
            now = np.bincount(member, weight[of] * now[member] / total[of], len(tx))
        return pd.DataFrame({"gene": pdf["gene"].iloc[0], "tx": tx, "count": now})

    return classes.groupBy("gene").applyInPandas(solve, f"gene {classes.schema['gene'].dataType.simpleString()}, tx int, count double")


def junction_classes(edges: DataFrame, annotated: DataFrame) -> DataFrame:
    """Each step as CON_ANNO (in all transcripts around it), ALT_ANNO (in some) or ALT_UNIQ (in none).

    Transcripts that have a step are counted once for all by equality; those around it come from a gene's list of spans.
    """
    has = annotated.select("gene", F.explode(_steps(F.col("nodes"))).alias("s")).groupBy("gene", "s.l", "s.r").agg(F.count(F.lit(1)).alias("have"))
    spans = annotated.groupBy("gene").agg(F.collect_list(F.struct(F.element_at("nodes", 1).alias("a"), F.element_at("nodes", -1).alias("b"))).alias("spans"))
    around = F.size(F.filter("spans", lambda s: (s["a"] <= F.col("l")) & (s["b"] >= F.col("r"))))
    seen = edges.join(has, ["gene", "l", "r"], "left").join(spans, "gene", "left")
    return seen.select("gene", "l", "r", "n", F.when(F.col("have").isNull(), "ALT_UNIQ").when(F.col("have") == around, "CON_ANNO").otherwise("ALT_ANNO").alias("class"))


def truth_psi(tx_tpm: DataFrame, annotated: DataFrame) -> DataFrame:
    """Per inner node: tpm of transcripts with it over tpm of transcripts that reach across it."""
    whole = annotated.join(tx_tpm.select("gene", "tx", "tpm"), ["gene", "tx"])
    over = whole.select("gene", "tpm", "nodes", F.explode(F.sequence(F.element_at("nodes", 1), F.element_at("nodes", -1))).alias("node"))
    inner = (F.col("node") > F.element_at("nodes", 1)) & (F.col("node") < F.element_at("nodes", -1))
    c = over.where(inner).groupBy("gene", "node").agg(F.sum(F.when(F.array_contains("nodes", F.col("node")), F.col("tpm")).otherwise(0.0)).alias("inc"), F.sum("tpm").alias("all"))
    return c.select("gene", "node", F.when(F.col("all") > 0, F.round(F.col("inc") / F.col("all"), 4)).alias("psi"))


def mapping_stats(paths: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row: reads within nodes, reads over steps, distinct steps, and those that a transcript has."""
    body = paths.agg(F.count_if(F.size("path") == 1).alias("body_reads"), F.count_if(F.size("path") > 1).alias("junction_reads"))
    steps = junction_classes(edge_counts(paths), annotated)
    known = F.col("class") != "ALT_UNIQ"
    return body.join(F.broadcast(steps.agg(F.count(F.lit(1)).alias("junctions"), F.count_if(known).alias("annotated_junctions"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("annotated_steps"))))
