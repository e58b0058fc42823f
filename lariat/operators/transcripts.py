"""Annotation: exons to transcripts to genes, and splice sites that reads add."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.sources.alignments import introns, is_forward, right_end


def transcripts(exons: DataFrame) -> DataFrame:
    """One row per transcript: sorted starts (acc) and ends (don), its outer ends and its length."""
    return exons.groupBy("chrom", "strand", "gene", "transcript").agg(F.array_sort(F.collect_list("start")).alias("acc"), F.array_sort(F.collect_list("end")).alias("don"), F.min("start").alias("txst"), F.max("end").alias("txen"), F.sum(F.col("end") - F.col("start") + 1).alias("length"))


def one_chromosome(exons: DataFrame) -> DataFrame:
    """Exons of each gene on the chromosome of its first line in the file (column place); those on others go."""
    first = exons.groupBy("gene").agg(F.min_by("chrom", "place").alias("_chrom"))
    return exons.join(first, "gene").where(F.col("chrom") == F.col("_chrom")).drop("_chrom").select(exons.columns)


def distinct_exons(exons: DataFrame) -> DataFrame:
    """(gene, exons): each gene's exons as a sorted array of (start, end)."""
    return exons.groupBy("gene").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"))


def merged(a: Column, b: Column) -> Column:
    """The sorted union of two arrays."""
    return F.array_sort(F.array_union(a, b))


def genes(tx: DataFrame, novel: DataFrame | None = None) -> DataFrame:
    """One row per gene: splice sites without the transcripts' outer ends, the outer ends, and the mean length.

    novel: (gene, don, acc) of sites that reads add; what the annotation doesn't have of them is noveldon and novelacc.
    """
    # Sites are made distinct as rows before a gene's are put together, so that its arrays are as long as its sites.
    site = lambda kind: lambda at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.lit(None).cast("long").alias("length"))
    ends = F.array(F.struct(F.lit("txst").alias("kind"), F.col("txst").alias("at"), F.col("length").cast("long").alias("length")), site("txen")(F.col("txen")))
    rows = tx.select("chrom", "strand", "gene", F.explode(F.concat(F.transform(F.slice("don", 1, F.size("don") - 1), site("don")), F.transform(F.slice("acc", 2, F.size("acc")), site("acc")), ends)).alias("s"))
    rows = rows.groupBy("chrom", "strand", "gene", "s.kind", "s.at").agg(F.sum("s.length").alias("length"), F.count("s.length").alias("n"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("at")))).alias(kind)
    sites = rows.groupBy("chrom", "strand", "gene").agg(*[of(k) for k in ("don", "acc", "txst", "txen")], (F.sum("length") / F.sum("n")).alias("length"))
    none = F.array().cast("array<bigint>")
    if novel is None:
        sites = sites.withColumns({"noveldon": none, "novelacc": none})
    else:
        more = novel.select("gene", F.col("don").alias("_don"), F.col("acc").alias("_acc"))
        sites = sites.join(more, "gene", "left").withColumns({"_don": F.coalesce("_don", none), "_acc": F.coalesce("_acc", none)})
        sites = sites.withColumns({"noveldon": F.array_except("_don", "don"), "novelacc": F.array_except("_acc", "acc"), "don": merged(F.col("don"), F.col("_don")), "acc": merged(F.col("acc"), F.col("_acc"))}).drop("_don", "_acc")
    return sites.withColumns({"txst": F.array_except("txst", "acc"), "txen": F.array_except("txen", "don")})


def _over_genes(reads: DataFrame, annotated: DataFrame, bin_size: int) -> DataFrame:
    """reads (chrom, pos, end) with each gene whose range they overlap, by equal bins; a pair counts where the later one starts."""
    span = annotated.select("chrom", "gene", "strand", F.array_min(F.concat("txst", "acc")).alias("low"), F.array_max(F.concat("txen", "don")).alias("high"))
    bins = lambda df, a, b: df.withColumn("bin", F.explode(F.expr(f"sequence({a} div {bin_size}, {b} div {bin_size})")))
    return bins(reads, "pos", "end").join(bins(span, "low", "high"), ["chrom", "bin"]).where(f"pos <= high and end >= low and bin = greatest(pos, low) div {bin_size}").drop("bin")


def exon_counts(reads: DataFrame, annotated: DataFrame, exons: DataFrame, bin_size: int = 16_384) -> DataFrame:
    """(gene, reads, expression): reads over a gene with an end inside one of its exons, and that over its mean length less 100."""
    placed = _over_genes(reads.withColumn("end", right_end(F.col("pos"), F.col("cigar"))), annotated, bin_size).join(distinct_exons(exons), "gene")
    inside = F.exists("exons", lambda x: (x["start"] <= F.col("pos")) & (F.col("pos") <= x["end"]) | (x["start"] <= F.col("end")) & (F.col("end") <= x["end"]))
    counts = placed.where(inside).groupBy("gene").agg(F.count(F.lit(1)).alias("reads"))
    return annotated.select("gene", "length").join(counts, "gene", "left").select("gene", F.coalesce("reads", F.lit(0)).alias("reads"), (F.coalesce("reads", F.lit(0)) / (F.col("length") - 100)).alias("expression"))


def novel_sites(reads: DataFrame, annotated: DataFrame, least: int = 2, one_known: bool = False, gaps: str = "N", bin_size: int = 16_384) -> DataFrame:
    """(gene, don, acc): splice sites that at least ``least`` spliced reads on a gene's strand and in its range have.

    With one_known, a read's gap counts only if its donor or its acceptor is known by then, in the order of positions:
    annotated, or a site of a gap that counted before. Equal gaps of equal position are counted first, so a gene's
    rows are as many as its positions and gaps, however many reads it has.
    """
    spliced = introns(reads.withColumn("end", right_end(F.col("pos"), F.col("cigar"))), gaps)
    at = _over_genes(spliced, annotated, bin_size).where(is_forward(F.col("flag")) == (F.col("strand") == "+"))
    counted = at.groupBy("gene", "pos", "donor", "acceptor").agg(F.count(F.lit(1)).alias("n"))
    if one_known:
        known = annotated.select("gene", F.array_union("don", "acc").alias("known"))

        def follow(pdf: pd.DataFrame) -> pd.DataFrame:
            sites = set(pdf["known"].iloc[0])
            keep = []
            for donor, acceptor in pdf.sort_values(["pos", "donor", "acceptor"])[["donor", "acceptor"]].itertuples(index=False):
                keep.append(donor in sites or acceptor in sites)
                if keep[-1]:
                    sites.update((donor, acceptor))
            return pdf.sort_values(["pos", "donor", "acceptor"])[keep][["gene", "donor", "acceptor", "n"]]

        gene = counted.schema["gene"].dataType.simpleString()
        counted = counted.join(known, "gene").groupBy("gene").applyInPandas(follow, f"gene {gene}, donor long, acceptor long, n long")
    site = F.explode(F.array(F.struct(F.lit("don").alias("kind"), F.col("donor").alias("at")), F.struct(F.lit("acc").alias("kind"), F.col("acceptor").alias("at"))))
    counts = counted.select("gene", "n", site.alias("s")).groupBy("gene", "s.kind", "s.at").agg(F.sum("n").alias("n"))
    span = annotated.select("gene", F.array_min(F.concat("txst", "acc")).alias("low"), F.array_max(F.concat("txen", "don")).alias("high"))
    kept = counts.where(F.col("n") >= least).join(span, "gene").where("at between low and high")
    sites = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("at"))))
    return kept.groupBy("gene").agg(sites("don").alias("don"), sites("acc").alias("acc"))
