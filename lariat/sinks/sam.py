"""Alignments as SAM text; all of it expressions over nodes, which travel with an alignment as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.operators.align import score


def placed(rows: DataFrame, nodes: DataFrame, genes: DataFrame) -> DataFrame:
    """rows with an ``alignment``, and chrom, strand and ``graph``: its gene's nodes (node, offset, coord, length) in order."""
    graph = nodes.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("node", "offset", "coord", "length"))).alias("graph"))
    about = graph.join(genes.select("gene", "chrom", "strand"), "gene")
    return rows.withColumn("gene", F.col("alignment.gene")).join(about, "gene")


def cigar(alignment: Column, graph: Column, forward: Column, length: Column) -> Column:
    """Matches by node, merged where nodes lie side by side on the chromosome, introns between them, and clipped ends.

    In the direction of the chromosome: operations are turned round for genes of the reverse strand.
    """
    at = lambda n: F.element_at(graph, n["node"])
    size = lambda n: n["matches"] + n["mismatches"]
    path = alignment["path"]

    def gap(i: Column) -> Column:
        a, b = at(F.element_at(path, i)), at(F.element_at(path, i + 1))
        return F.when(forward, b["coord"] - (a["coord"] + a["length"])).otherwise(a["coord"] - (b["coord"] + b["length"]))

    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("ops"))

    def step(acc: Column, i: Column) -> Column:
        run = acc["run"] + size(F.element_at(path, i)).cast("long")
        ends = (i == F.size(path))
        intron = F.when(ends, F.lit(0).cast("long")).otherwise(gap(F.least(i, F.size(path) - 1)))
        cut = ends | (intron >= 1)
        ops = F.when(ends, F.concat(acc["ops"], F.array(F.concat(run.cast("string"), F.lit("M"))))).when(intron >= 1, F.concat(acc["ops"], F.array(F.concat(run.cast("string"), F.lit("M")), F.concat(intron.cast("string"), F.lit("N"))))).otherwise(acc["ops"])
        return F.struct(F.when(cut, F.lit(0).cast("long")).otherwise(run).alias("run"), (acc["total"] + size(F.element_at(path, i)).cast("long")).alias("total"), ops.alias("ops"))

    walked = F.aggregate(F.sequence(F.lit(1), F.size(path)), start, step)
    clipped = alignment["read_offset"] - 1
    rest = length - clipped - walked["total"]
    soft = lambda n: F.when(n > 0, F.array(F.concat(n.cast("string"), F.lit("S")))).otherwise(F.array().cast("array<string>"))
    ops = F.concat(soft(clipped), walked["ops"], soft(rest))
    return F.array_join(F.when(forward, ops).otherwise(F.reverse(ops)), "")


def position(alignment: Column, graph: Column, forward: Column) -> Column:
    """The leftmost position on the chromosome."""
    path = alignment["path"]
    first, last = F.element_at(graph, path[0]["node"]), F.element_at(graph, F.element_at(path, -1)["node"])
    used = F.element_at(path, -1)
    begin = F.when(F.size(path) == 1, alignment["offset"]).otherwise(last["offset"])
    end = begin + used["matches"] + used["mismatches"]
    return F.when(forward, first["coord"] + alignment["offset"] - first["offset"]).otherwise(last["coord"] + last["length"] - (end - last["offset"]))


def flag(forward: Column, extra: Column, mate: int | None = None) -> Column:
    """Bits: paired and properly so, which mate, the gene's reverse strand, a further place."""
    paired = 0 if mate is None else 0x3 | (0x40 if mate == 1 else 0x80)
    return F.lit(paired) + F.when(forward, 0).otherwise(0x10) + F.when(extra, 0x100).otherwise(0)


def sam_lines(reads: DataFrame, aligned: DataFrame, nodes: DataFrame, genes: DataFrame, mate: int | None = None, offset: int = 33) -> DataFrame:
    """(read_id, value): a line for each alignment, the best one with bases and qualities, others as further places.

    reads: read_id, seq, quality; aligned: of ``align`` or one side of ``align_pairs`` as alignments. Circular paths have
    no line. The mapping quality is 0 for one place and ten times their number for several.
    """
    several = F.size("alignments")
    scored = F.transform("alignments", lambda a, i: F.struct(score(a["path"]).alias("s"), (-i).alias("i")))
    best = -F.array_max(scored)["i"]
    rows = aligned.withColumn("best", best).select("read_id", "best", several.alias("several"), F.posexplode("alignments").alias("i", "alignment")).join(reads.select("read_id", "seq", "quality"), "read_id")
    rows = placed(rows, nodes, genes).where("alignment.path[size(alignment.path) - 1].node >= alignment.path[0].node")
    forward, a, extra = F.col("strand") == "+", F.col("alignment"), F.col("i") != F.col("best")
    turned = F.col("alignment.forward") != forward
    seq = F.when(turned, F.reverse(F.translate("seq", "ACGT", "TGCA"))).otherwise(F.col("seq"))
    marks = F.array_join(F.transform(F.when(turned, F.reverse("quality")).otherwise(F.col("quality")), lambda q: F.char(q + offset)), "")
    star = F.lit("*")
    fields = ["read_id", flag(forward, extra, mate).cast("string"), "chrom", position(a, F.col("graph"), forward).cast("string"), F.when(F.col("several") > 1, 10 * F.col("several")).otherwise(0).cast("string"), cigar(a, F.col("graph"), forward, F.length("seq")), star, F.lit("0"), F.lit("0"), F.when(extra, star).otherwise(seq), F.when(extra, star).otherwise(marks)]
    return rows.select("read_id", F.concat_ws("\t", *fields).alias("value"))


def header_lines(nodes: DataFrame, genes: DataFrame) -> DataFrame:
    """(place, value): @HD and a line for each chromosome, as long as its last node's coordinate and 10000."""
    longest = nodes.join(genes.select("gene", "chrom"), "gene").groupBy("chrom").agg((F.max("coord") + 10_000).alias("n"))
    sq = longest.select(F.concat(F.lit("1"), F.col("chrom")).alias("place"), F.concat(F.lit("@SQ\tSN:"), "chrom", F.lit("\tLN:"), F.col("n").cast("string")).alias("value"))
    return nodes.sparkSession.createDataFrame([("0", "@HD\tVN:1.0\tSO:unsorted")], "place string, value string").unionByName(sq)
