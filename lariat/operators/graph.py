"""Splice graphs as tables: nodes, annotated paths, sequences, k-mers at the edges, potential exons.

A gene's boundaries in order of position are rows; what a node is follows from a row and its neighbours, so the graph
is built by window functions over (gene, position), and nothing but a gene's own boundaries meets in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.functions.sequence import EDGE_KINDS, inverted, is_exon_start, is_exon_stop, is_hard, kmer_index, reverse_complement

#: Kinds of boundaries, in the order in which they come where they share a position (fixed values).
TX_END, ACCEPTOR, DONOR, TX_START = 1, 2, 3, 4
#: The start of an exon among them, before the boundaries at its position.
_EXON = 0
#: A node's left edge by the kind of its first boundary, and by those of a gap before it (fixed values).
_NODE_EDGE = {TX_END: "RS", ACCEPTOR: "RR", DONOR: "LL", TX_START: "SL"}
_GAP_EDGE = {TX_END: ["RS", "SR", "RS", "RS"], ACCEPTOR: ["RR"] * 4, DONOR: ["LL", "LR", "LL", "LS"], TX_START: ["SL"] * 4}


def edge_type(first: Column, second: Column, is_node: Column) -> Column:
    """A node's left edge on the forward strand by the kinds of two boundaries, for a node or for the gap before it."""
    table = F.create_map(*[F.lit(x) for a, edges in _GAP_EDGE.items() for b, e in enumerate(edges, 1) for x in (10 * a + b, e)])
    plain = F.create_map(*[F.lit(x) for p in _NODE_EDGE.items() for x in p])
    return F.when(is_node, plain[first]).otherwise(table[10 * first + second])


def is_donor_edge(edge: Column) -> Column:
    """Whether a boundary may be left by a splice."""
    return edge.isin("LR", "LS", "LL")


def is_acceptor_edge(edge: Column) -> Column:
    return edge.isin("LR", "SR", "RR")


def edge_code(edge: Column) -> Column:
    """The number of a boundary, from 0."""
    return F.array_position(F.array(*[F.lit(k) for k in EDGE_KINDS]), edge).cast("int") - 1


def nodes(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """(gene, node, coord, length, edge_in, edge_out, offset): a gene's nodes, from 1 in the direction of its strand.

    genes: the result of ``transcripts.genes``; exons: rows (gene, start, end), or (gene, exons) of
    ``transcripts.distinct_exons``. Between two boundaries there is a node if an exon holds both, or if a site that reads
    have added bounds it; where there isn't, the stretch is a gap and what follows it is a node again. Nodes of no length
    may stand between kissing exons. offset: a node's first base in the gene's own sequence, from 1.
    """

    def kind_of(column: str, kind: int, novel: str | None = None) -> Column:
        added = lambda v: F.array_contains(novel, v) if novel else F.lit(False)
        return F.transform(column, lambda v: F.struct(v.alias("at"), F.lit(kind).alias("kind"), F.coalesce(added(v), F.lit(False)).alias("novel"), F.lit(None).cast("long").alias("reach")))

    if "exons" in exons.columns:
        exons = exons.select("gene", F.explode("exons").alias("x")).select("gene", "x.start", "x.end")
    # Two boundaries are in an exon if the exons that begin up to the first reach the second: one number for each start.
    reach = exons.groupBy("gene", "start").agg(F.max("end").cast("long").alias("reach")).groupBy("gene").agg(F.collect_list(F.struct(F.col("start").alias("at"), F.lit(_EXON).alias("kind"), F.lit(False).alias("novel"), "reach")).alias("starts"))
    bounds = F.concat(kind_of("txen", TX_END), kind_of("acc", ACCEPTOR, "novelacc"), kind_of("don", DONOR, "noveldon"), kind_of("txst", TX_START), "starts")
    rows = genes.join(reach, "gene").select("gene", "strand", F.explode(bounds).alias("b")).select("gene", "strand", "b.at", "b.kind", "b.novel", "b.reach")
    order = Window.partitionBy("gene").orderBy("at", "kind")
    rows = rows.withColumn("reach", F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("kind") != _EXON)
    rows = rows.withColumns({"row": F.row_number().over(order), "to": F.lead("at").over(order), "to_kind": F.lead("kind").over(order), "to_novel": F.lead("novel").over(order), "from_kind": F.lag("kind").over(order)})
    held = F.coalesce(F.col("to") <= F.col("reach"), F.lit(False))
    added = (F.col("kind") == ACCEPTOR) & F.col("novel") | (F.col("to_kind") == DONOR) & F.col("to_novel")
    rows = rows.where("to is not null").withColumn("solid", held | added)
    # In a run of stretches that nothing holds, every other one is a gap.
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gap", ~F.col("solid") & ((F.col("row") - F.coalesce(F.max(F.when(F.col("solid"), F.col("row"))).over(before), F.lit(0))) % 2 == 1))
    rows = rows.withColumn("after_gap", F.coalesce(F.lag("gap").over(order), F.lit(False))).where(~F.col("gap"))
    apart = F.col("at") != F.col("to")
    first = F.col("at") + F.when(~F.col("after_gap") & F.col("kind").isin(TX_END, DONOR) & apart, 1).otherwise(0)
    last = F.col("to") - F.when(F.col("to_kind").isin(ACCEPTOR, TX_START) & apart, 1).otherwise(0)
    left = F.when(F.col("after_gap"), edge_type(F.col("from_kind"), F.col("kind"), F.lit(False))).otherwise(edge_type(F.col("kind"), F.col("kind"), F.lit(True)))
    rows = rows.select("gene", "strand", "row", first.alias("coord"), (last - first + 1).alias("length"), left.alias("left"))
    right = F.coalesce(F.lead("left").over(Window.partitionBy("gene").orderBy("row")), F.lit("RS"))
    rows = rows.withColumn("right", right)
    forward = F.col("strand") == "+"
    along = Window.partitionBy("gene").orderBy(F.when(forward, F.col("row")).otherwise(-F.col("row")))
    rows = rows.select("gene", F.row_number().over(along).alias("node"), "coord", "length", F.when(forward, F.col("left")).otherwise(inverted(F.col("right"))).alias("edge_in"), F.when(forward, F.col("right")).otherwise(inverted(F.col("left"))).alias("edge_out"))
    so_far = Window.partitionBy("gene").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0)) + 1)


def node_sequences(nodes: DataFrame, genes: DataFrame, pieces: DataFrame, bin_size: int = 4096) -> DataFrame:
    """(gene, node, seq) by an equi-join of nodes and pieces (name, start, seq) of the genome in equal bins."""
    at = nodes.join(genes.select("gene", "chrom", "strand"), "gene").select("gene", "node", "strand", F.col("chrom").alias("name"), "coord", (F.col("coord") + F.col("length") - 1).alias("end"))
    bins = lambda df, a, b: df.withColumn("bin", F.explode(F.expr(f"sequence({a} div {bin_size}, {b} div {bin_size})")))
    ranged = pieces.withColumn("stop", F.col("start") + F.length("seq") - 1)
    both = bins(at.where("end >= coord"), "coord", "end").join(bins(ranged, "start", "stop"), ["name", "bin"]).where(f"start <= end and stop >= coord and bin = greatest(start, coord) div {bin_size}")
    part = F.expr("substring(seq, cast(greatest(coord - start, 0) + 1 as int), cast(least(end, stop) - greatest(coord, start) + 1 as int))")
    found = both.groupBy("gene", "node").agg(F.array_sort(F.collect_list(F.struct("start", part.alias("part")))).alias("parts"))
    seq = F.coalesce(F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit(""))
    return at.join(found, ["gene", "node"], "left").select("gene", "node", F.when(F.col("strand") == "+", seq).otherwise(reverse_complement(seq)).alias("seq"))


def gene_sequences(node_seqs: DataFrame) -> DataFrame:
    """(gene, seq): a gene's nodes one after another."""
    return node_seqs.groupBy("gene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "seq"))), lambda n: n["seq"]), "").alias("seq"))


def path_sequence(nodes: Column, seqs: Column) -> Column:
    """The sequence of a path of node numbers over the gene's node sequences in order."""
    return F.array_join(F.transform(nodes, lambda n: F.element_at(seqs, n.cast("int"))), "")


def _node_spans(nodes: DataFrame, genes: DataFrame) -> DataFrame:
    """A row for each gene: starts and ends of its exons as sorted arrays, and the node and base at each of them.

    Nodes in order of position are counted along the starts and ends, so what lies between a start and an end is a range of
    numbers. On the forward strand a start's node is the first of the range, and its base that node's first one; an end's
    node is the last, and its base the one after it. On the other strand it is the other way round.
    """
    marked = lambda c, kind: F.transform(c, lambda v: F.struct(v.alias("at"), kind.alias("kind"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("after")))
    forward = F.col("strand") == "+"
    own = nodes.groupBy("gene").agg(F.collect_list(F.struct(F.col("coord").alias("at"), F.lit(1).alias("kind"), "offset", (F.col("offset") + F.col("length")).alias("after"))).alias("own"), F.count(F.lit(1)).alias("k"), F.max(F.col("offset") + F.col("length")).alias("total"))
    # Starts come before the nodes at their position (-1) or, where the last of those counts, after them (2); ends come after them (3).
    marks = F.concat("own", marked(F.concat("acc", "txst"), F.when(forward, 2).otherwise(-1)), marked(F.concat("don", "txen"), F.lit(3)))
    rows = genes.join(own, "gene").select("gene", "strand", "k", "total", F.explode(marks).alias("m")).select("gene", "strand", "k", "total", "m.*")
    # Along the strand's direction of numbers, nodes of one position stand in the order of their numbers.
    so_far = Window.partitionBy("gene").orderBy("at", "kind", F.when(forward, F.col("offset")).otherwise(-F.col("offset")), F.when(forward, F.col("after")).otherwise(-F.col("after"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(F.when(F.col("kind") == 1, F.col(c)), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"n": F.count(F.when(F.col("kind") == 1, 1)).over(so_far), "last_at": last("at"), "last_offset": last("offset"), "last_after": last("after")}).where("kind != 1")
    # Of two nodes that begin where an exon does, one has no length; on the forward strand the later one counts.
    there = F.coalesce(F.col("last_at") == F.col("at"), F.lit(False))
    node = F.when(F.col("kind") == -1, F.col("k") - F.col("n")).when(F.col("kind") == 2, F.col("n") + F.when(there, 0).otherwise(1)).otherwise(F.when(forward, F.col("n")).otherwise(F.col("k") + 1 - F.col("n")))
    base = F.when(F.col("kind") == -1, F.coalesce("last_offset", "total")).when(F.col("kind") == 2, F.when(there, F.col("last_offset")).otherwise(F.coalesce("last_after", F.lit(1)))).otherwise(F.when(forward, F.coalesce("last_after", F.lit(1))).otherwise(F.coalesce("last_offset", "total")))
    rows = rows.select("gene", "strand", (F.col("kind") == 3).alias("end"), "at", node.cast("int").alias("node"), base.alias("base"))
    of = lambda c, end: F.collect_list(F.when(F.col("end") == end, F.col(c)))
    return rows.groupBy("gene", "strand").agg(of("at", False).alias("starts"), of("node", False).alias("start_node"), of("base", False).alias("start_base"), of("at", True).alias("ends"), of("node", True).alias("end_node"), of("base", True).alias("end_base"))


def annotated_paths(nodes: DataFrame, genes: DataFrame, tx: DataFrame) -> DataFrame:
    """(gene, transcript, nodes, runs, length): the sorted nodes of each transcript, those that begin in one of its exons.

    runs: the same as longest runs of consecutive nodes (first, last), in order; length: bases of all of them. An exon's
    nodes are looked up by its start and its end, so no gene's exons and nodes are a product.
    """
    spans = tx.select("gene", "transcript", F.explode(F.arrays_zip("acc", "don")).alias("x")).select("gene", "transcript", F.col("x.acc").alias("start"), F.col("x.don").alias("end"))
    met = spans.join(_node_spans(nodes, genes).hint("shuffle_hash"), "gene")
    at = lambda c, found, of: F.element_at(c, F.array_position(found, F.col(of)).cast("int"))
    for c in ("node", "base"):
        met = met.withColumns({f"_s{c}": at(f"start_{c}", "starts", "start"), f"_e{c}": at(f"end_{c}", "ends", "end")})
    forward = F.col("strand") == "+"
    side = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    ranges = met.select("gene", "transcript", side("_snode", "_enode").alias("first"), side("_enode", "_snode").alias("last"), side("_sbase", "_ebase").alias("base"), side("_ebase", "_sbase").alias("after")).where("first <= last")
    found = ranges.groupBy("gene", "transcript").agg(F.sort_array(F.collect_list(F.struct("first", "last", "base", "after"))).alias("r"))
    # First and last nodes both grow along a transcript's exons, so a run begins where the range before ends short of it.
    r = lambda i: F.element_at("r", i)
    begins = F.filter("r", lambda x, i: F.when(i == 0, True).otherwise(x["first"] > r(F.greatest(i, F.lit(1)))["last"] + 1))
    stops = F.filter("r", lambda x, i: F.when(i == F.size("r") - 1, True).otherwise(r(F.least(i + 2, F.size("r")))["first"] > x["last"] + 1))
    found = found.select("gene", "transcript", F.zip_with(begins, stops, lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last"), (b["after"] - a["base"]).alias("bases"))).alias("r"))
    runs = F.transform("r", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    return found.select("gene", "transcript", F.flatten(F.transform("r", lambda x: F.sequence(x["first"], x["last"]))).alias("nodes"), runs.alias("runs"), F.aggregate("r", F.lit(0).cast("long"), lambda n, x: n + x["bases"]).alias("length"))


def isoform_lengths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gene, transcript, length): bases of the nodes of a path."""
    return paths.select("gene", "transcript", F.explode("nodes").alias("node")).join(nodes.select("gene", "node", "length"), ["gene", "node"]).groupBy("gene", "transcript").agg(F.sum("length").alias("length"))


def kmer_edges(nodes: DataFrame, gene_seqs: DataFrame, k: int) -> DataFrame:
    """(side, kmer, code, gene, node): the k bases before each boundary that a splice may leave, and after each it may reach.

    A k-mer that reaches over the gene's sequence or holds anything but A, C, G, T has no row.
    """
    at = nodes.select("gene", "node", "offset", "edge_in").join(gene_seqs, "gene")
    left = at.where(is_donor_edge(F.col("edge_in")) & (F.col("offset") > k)).select(F.lit("left").alias("side"), F.expr(f"substring(seq, cast(offset - {k} as int), {k})").alias("kmer"), "gene", "node")
    right = at.where(is_acceptor_edge(F.col("edge_in")) & (F.col("offset") + k - 1 <= F.length("seq"))).select(F.lit("right").alias("side"), F.expr(f"substring(seq, cast(offset as int), {k})").alias("kmer"), "gene", "node")
    return left.unionByName(right).withColumn("code", kmer_index(F.col("kmer"))).where("code is not null").select("side", "kmer", "code", "gene", "node")


def joined_edges(edges: DataFrame, zipped: bool = False) -> DataFrame:
    """(left_kmer, right_kmer, gene, left, right): nodes of one gene that a pair of k-mers may join.

    zipped: of a gene's nodes only the first few are joined, as many as the shorter of both lists has.
    """
    place = F.row_number().over(Window.partitionBy("kmer", "gene").orderBy("node"))
    a = edges.where("side = 'left'").select(F.col("kmer").alias("left_kmer"), "gene", F.col("node").alias("left"), place.alias("i"))
    b = edges.where("side = 'right'").select(F.col("kmer").alias("right_kmer"), "gene", F.col("node").alias("right"), place.alias("j"))
    both = a.join(b, "gene")
    return (both.where("i = j") if zipped else both).drop("i", "j").select("left_kmer", "right_kmer", "gene", "left", "right")


def gene_offsets(gene_seqs: DataFrame) -> DataFrame:
    """(gene, seq, at): where each gene begins in all genes' sequence one after another, from 0, in order of name.

    Only names and lengths are sorted in one place: a row for each gene.
    """
    at = F.coalesce(F.sum("n").over(Window.orderBy("gene").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return gene_seqs.join(gene_seqs.select("gene", F.length("seq").cast("long").alias("n")).select("gene", at.alias("at")), "gene")


def isoform_offsets(paths: DataFrame) -> DataFrame:
    """(gene, at): how many transcripts the genes before have, by name; a row for each gene."""
    counts = paths.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("gene", F.coalesce(F.sum("n").over(Window.orderBy("gene").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))


def potential_exons(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(gene, first, last, low, high, annotated): runs of nodes from an exon start to each stop up to the next hard edge.

    paths: the result of ``annotated_paths``. Nodes up to one hard edge have it in common, so a start's stops are those
    that come after it there.
    """
    order = Window.partitionBy("gene").orderBy("node")
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    reach = F.coalesce(F.min(F.when(is_hard(F.col("edge_out")), F.col("node"))).over(ahead), F.max("node").over(Window.partitionBy("gene")))
    # A run of nodes is in a path if a longest run of one begins up to its first node and ends at its last or beyond.
    whole = paths.select("gene", F.explode("runs").alias("x")).groupBy("gene", "x.first").agg(F.max("x.last").alias("last")).groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("first", "last"))).alias("whole"))
    met = nodes.join(whole.hint("shuffle_hash"), "gene", "left").select("gene", "node", "coord", (F.col("coord") + F.col("length") - 1).alias("end"), "edge_in", "edge_out", F.try_element_at("whole", F.col("node")).alias("whole"))
    met = met.withColumns({"reach": reach, "whole": F.max("whole").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    stops = F.collect_list(F.when(is_exon_stop(F.col("edge_out")), F.struct(F.col("node").alias("last"), F.col("coord").alias("c2"), F.col("end").alias("e2"))))
    begin = met.withColumn("stops", stops.over(Window.partitionBy("gene", "reach").orderBy("node").rowsBetween(Window.currentRow, Window.unboundedFollowing))).where(is_exon_start(F.col("edge_in")))
    found = begin.select("gene", F.col("node").alias("first"), "coord", "end", "whole", F.explode("stops").alias("x")).select("gene", "first", "coord", "end", "whole", "x.*")
    return found.select("gene", "first", "last", F.least("coord", "c2").alias("low"), F.greatest("end", "e2").alias("high"), F.coalesce(F.col("last") <= F.col("whole"), F.lit(False)).alias("annotated"))


def expected_gc(seq: Column, window: int = 50) -> Column:
    """Shares of all windows of a sequence by their bin of G and C, 20 bins; zeros for a shorter sequence.

    The bin of a share is its quotient by 0.05 in floating point, cut, so that all G and C fall into the last one.
    """
    bins = np.minimum(np.array([int((i / window) // 0.05) for i in range(window + 1)]), 19)

    @F.arrow_udf("array<double>")
    def shares(column: pa.Array) -> pa.Array:
        out = []
        for s in column.to_pylist():
            raw = np.frombuffer((s or "").upper().encode(), np.uint8)
            total = np.concatenate([[0], np.cumsum((raw == 71) | (raw == 67))])
            n = max(0, len(raw) - window + 1)
            count = np.bincount(bins[total[window : window + n] - total[:n]], minlength=20) if n else np.zeros(20)
            out.append((count / max(n, 1)).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return shares(seq)
