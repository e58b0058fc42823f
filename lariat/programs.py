"""The whole way from annotation, genome and reads to result files, as functions and from the command line.

    python -m lariat.programs index --gtf a.gtf.gz --fasta g.fa.gz -x folder
    python -m lariat.programs quant r1.fastq.gz [r2.fastq.gz] -x folder -o out
    python -m lariat.programs delta -a a1.psi,a2.psi -b b1.psi,b2.psi -o out
    python -m lariat.programs simulate -x folder -o out

Each step's tables are written to the index or result folder and read again, so that plans stay small, lineage is cut and a
lost executor costs one step at most.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lariat.operators import align, bias, events, graph, posterior, quant, simulate
from lariat.operators import transcripts as T
from lariat.sinks import sam, tables
from lariat.sources import alignments, text

_KEY = ["gene", "kind", "path", "mate"]


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    tables.save_index(folder, **{name: df})
    return tables.load_index(df.sparkSession, folder, name)[name]


def build_index(spark: SparkSession, gtf: str, fasta: str, folder: str, kmer: int = 9, reads: str | None = None, least_reads: int = 1, both_novel: bool = False, drop_low_support: bool = False, seed: int = 18, tolerance: int = 4) -> None:
    """Graphs, sequences, k-mers and seeds of an annotation; reads: a BAM or SAM file whose splice sites are added."""
    keep = lambda df, name: _kept(df, folder, name)
    exons = keep(T.one_chromosome(text.gtf(spark, gtf, drop_low_support)).drop("place"), "exon")
    tx = keep(T.transcripts(exons), "tx")
    novel = None
    if reads:
        found = alignments.sam(spark, reads) if text.has_extension(reads, ".sam") else alignments.bam(spark, reads)
        novel = keep(T.novel_sites(found, T.genes(tx), least_reads, not both_novel), "novel")
    genes = keep(T.genes(tx, novel), "gene")
    nodes = keep(graph.nodes(genes, T.distinct_exons(exons)), "node")
    node_seqs = keep(graph.node_sequences(nodes, genes, text.fasta(spark, fasta, genes.select("chrom"))), "node_seq")
    seqs = keep(graph.gene_offsets(graph.gene_sequences(node_seqs)), "gene_seq")
    paths = keep(graph.annotated_paths(nodes, genes, tx), "annopath")
    keep(graph.isoform_lengths(paths, nodes), "isoform")
    keep(graph.kmer_edges(nodes, seqs, kmer), "kmer_edge")
    keep(align.seed_index(seqs, align.Settings(kmer=kmer, seed=seed, tolerance=tolerance)), "seed")
    tables.write(tables.exon_lines(graph.potential_exons(nodes, paths), genes), f"{folder}/exons.tab.gz", tables.exon_header())


def _expected(node_seqs: DataFrame, paths: DataFrame) -> DataFrame:
    """(gene, transcript, expected): shares of windows by G and C of spliced transcripts."""
    listed = node_seqs.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "seq"))), lambda n: n["seq"]).alias("seqs"))
    return paths.join(listed, "gene").select("gene", "transcript", graph.expected_gc(graph.path_sequence(F.col("nodes"), F.col("seqs"))).alias("expected"))


def quantify(spark: SparkSession, folder: str, out: str, first: str, second: str | None = None, settings: align.Settings = align.Settings(), offset: int = 33, circles: bool = False, biased: bool = False, write_sam: bool = False) -> None:
    """Result tables out.gene.tpm.gz, out.isoform.tpm.gz, out.map.gz, out.jnc.gz, out.psi.gz (and out.sam) of reads or pairs.

    Pairs are the same records of two files, by name. The tables of junctions and mapping are written before reads of
    several places are dealt. biased: counts are corrected for what reads begin with, and then for their G and C.
    """
    index = tables.load_index(spark, folder, "gene", "node", "gene_seq", "annopath", "isoform", "seed", "node_seq")
    work = f"{out}.work"
    keep = lambda df, name: _kept(df, work, name)
    nodes, genes, paths = index["node"], index["gene"], index["annopath"]
    graphs = align.broadcast_graphs(nodes, index["gene_seq"], settings)
    reads = text.fastq(spark, first, offset)
    if second is None:
        aligned = keep(align.align(reads, index["seed"], graphs, settings), "aligned")
        single, ones = quant.single_paths(aligned).withColumn("mate", F.lit(None).cast("array<int>")), F.size("alignments") > 1
    else:
        mates = text.fastq(spark, second, offset).select(F.regexp_replace("read_id", "/[12]$", "").alias("read_id"), F.col("seq").alias("mate_seq"), F.col("quality").alias("mate_quality"))
        reads = reads.withColumn("read_id", F.regexp_replace("read_id", "/[12]$", ""))
        aligned = keep(align.align_pairs(reads.join(mates, "read_id"), index["seed"], graphs, settings), "aligned")
        single, ones = quant.paired_paths(aligned), F.size("first") > 1
    tally = aligned.agg(F.count(F.lit(1)).alias("mapped"), F.count_if(ones).alias("multi"), F.coalesce(F.floor(F.avg("length")), F.lit(0)).alias("length")).first()
    total, length = reads.count(), int(tally["length"])
    if biased:
        mapped_reads = keep(reads.join(aligned.select("read_id"), "read_id", "left_semi"), "mapped")
        weights = keep(bias.primer_weights(mapped_reads), "primer")
        single = single.join(bias.primer_adjusted(mapped_reads, weights).select("read_id", "value"), "read_id")
    counts = keep(quant.count(single) if second is None else quant.count_pairs(single), "count")
    classes = keep(quant.classes(counts, paths), "class")
    abundance = keep(quant.abundance(index["isoform"], classes, length, 1), "abundance")
    if biased:
        expected = _expected(index["node_seq"], paths).join(abundance, ["gene", "transcript"])
        gc = keep(bias.gc_weights(mapped_reads, expected), "gc")
        keyed = single.join(mapped_reads.select("read_id", F.explode(bias.gc_bins(F.col("seq"))).alias("bin")), "read_id")
        one = quant.count if second is None else quant.count_pairs
        seen = [one(keyed.where(F.col("bin") == b).drop("value")).withColumn("bin", F.lit(b)).withColumnRenamed("n", "k") for b in range(1, 22)]
        windows = seen[0]
        for s in seen[1:]:
            windows = windows.unionByName(s)
        counts = keep(bias.gc_adjusted(counts, keep(windows, "windows"), gc, _KEY).select(*_KEY, "n"), "corrected")
    tables.write(tables.tpm_lines(quant.gene_abundance(abundance), "gene"), f"{out}.gene.tpm.gz", "Gene\tTpM\tRead_Counts")
    tables.write(tables.tpm_lines(abundance, "transcript"), f"{out}.isoform.tpm.gz", "Isoform\tTpM\tRead_Counts")
    flat = keep(quant.decomposed(counts), "flat")
    tables.write(tables.statistics_lines(quant.mapping_statistics(flat, paths, total, tally["mapped"], tally["multi"], length), folder, "lariat"), f"{out}.map.gz", order=["line"])
    tables.write(tables.junction_lines(quant.junctions(flat, nodes, genes, paths)), f"{out}.jnc.gz", tables.JUNCTION_HEADER)
    dealt = keep(quant.assigned(keep(quant.multi_classes(quant.multi_counts(aligned), paths), "multi"), paths, abundance), "dealt")
    found = keep(events.inclusion(nodes, quant.added(flat, dealt), length, circles), "event")
    tables.write(tables.psi_lines(found, nodes, genes), f"{out}.psi.gz", tables.PSI_HEADER, ["gene", "node"])
    if write_sam:
        sides = [(aligned, reads, None)] if second is None else [(aligned.withColumn("alignments", F.col("first")), reads, 1), (aligned.withColumn("alignments", F.col("second")), mates.withColumnsRenamed({"mate_seq": "seq", "mate_quality": "quality"}), 2)]
        lines = sam.header_lines(nodes, genes).select(F.concat(F.lit("0"), "place").alias("place"), "value")
        for table, own, mate in sides:
            lines = lines.unionByName(sam.sam_lines(own, table, nodes, genes, mate, offset).select(F.concat(F.lit("1"), "read_id").alias("place"), "value"))
        lines.orderBy("place").select("value").write.mode("overwrite").text(f"{out}.sam")


def compare(spark: SparkSession, first: list[str], second: list[str], out: str, least_reads: int = 5, least_samples: int = 1) -> None:
    """out.diff.gz of two sets of inclusion tables, each an equally weighing replicate."""
    if not first or not second:
        raise ValueError("no files match on one side")
    sides = (posterior.replicates(text.psi_file(spark, side)) for side in (first, second))
    rows = posterior.compared(*sides, least_reads, least_samples)
    tables.write(tables.diff_lines(rows), f"{out}.diff.gz", tables.DIFF_HEADER)


def simulated(spark: SparkSession, folder: str, out: str, most_nodes: int = 8, genes: int = 100_000, skip: int = 0) -> None:
    """out.fa.gz and out.gtf.gz of all valid transcripts of an index's genes."""
    index = tables.load_index(spark, folder, "gene", "node", "node_seq")
    nodes = simulate.first_genes(index["node"], genes, skip)
    tx = _kept(simulate.combinatorial(nodes, most_nodes), f"{out}.work", "simulated")
    simulate.fasta_lines(tx, index["node_seq"]).select("value").write.mode("overwrite").option("compression", "gzip").text(f"{out}.fa.gz")
    simulate.gtf_lines(tx, nodes, index["gene"]).orderBy("transcript", "start").select("value").write.mode("overwrite").option("compression", "gzip").text(f"{out}.gtf.gz")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lariat")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("index")
    c.add_argument("--gtf", required=True)
    c.add_argument("--fasta", required=True)
    c.add_argument("-x", "--index", required=True)
    c.add_argument("-k", "--kmer", type=int, default=9)
    c.add_argument("--bam")
    c.add_argument("--bam-min-reads", type=int, default=1)
    c.add_argument("--bam-both-novel", action="store_true")
    c.add_argument("--suppress-low-tsl", action="store_true")
    c.add_argument("-L", "--seed-len", type=int, default=18)
    c.add_argument("-T", "--seed-tol", type=int, default=4)
    c = commands.add_parser("quant")
    c.add_argument("reads", nargs="+")
    c.add_argument("-x", "--index", required=True)
    c.add_argument("-o", "--out", default="output")
    for flag, name, kind in (("-k", "--kmer", int), ("-L", "--seed-len", int), ("-M", "--seed-try", int), ("-T", "--seed-tol", int), ("-B", "--seed-buf", int), ("-I", "--seed-inc", int), ("-P", "--pair-range", int), ("-X", "--mismatches", int), ("-S", "--score-min", float)):
        c.add_argument(flag, name, type=kind)
    for flag in ("--sam", "--biascorrect", "--stranded", "--pair-same-strand", "--phred-33", "--phred-64", "--circ", "--force-gz"):
        c.add_argument(flag, action="store_true")
    c = commands.add_parser("delta")
    c.add_argument("-a", required=True)
    c.add_argument("-b", required=True)
    c.add_argument("-o", "--out", default="output")
    c.add_argument("-d", "--directory", default=".")
    c.add_argument("-r", "--min-reads", type=int, default=5)
    c.add_argument("-s", "--min-samples", type=int, default=1)
    c = commands.add_parser("simulate")
    c.add_argument("-x", "--index", required=True)
    c.add_argument("-o", "--out", default="simul")
    c.add_argument("-n", "--num-nodes", type=int, default=8)
    c.add_argument("-g", "--num-genes", type=int, default=100_000)
    c.add_argument("-i", "--offset", type=int, default=1)
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "index":
        build_index(spark, a.gtf, a.fasta, a.index, a.kmer, a.bam, a.bam_min_reads, a.bam_both_novel, a.suppress_low_tsl, a.seed_len, a.seed_tol)
    elif a.command == "quant":
        given = {"kmer": a.kmer, "seed": a.seed_len, "tries": a.seed_try, "tolerance": a.seed_tol, "buffer": a.seed_buf, "step": a.seed_inc, "pair_range": a.pair_range, "mismatches": a.mismatches, "score_least": a.score_min}
        settings = replace(align.Settings(), stranded=a.stranded, mates_reversed=not a.pair_same_strand, **{k: v for k, v in given.items() if v is not None})
        if a.force_gz and not all(map(text.is_gzipped, a.reads)):
            parser.error("Spark tells gzip by the suffix .gz; rename the files")
        quantify(spark, a.index, a.out, a.reads[0], *a.reads[1:2], settings=settings, offset=64 if a.phred_64 else 33, circles=a.circ, biased=a.biascorrect, write_sam=a.sam)
    elif a.command == "delta":
        compare(spark, *(text.files(spark, side, a.directory) for side in (a.a, a.b)), a.out, a.min_reads, a.min_samples)
    else:
        simulated(spark, a.index, a.out, a.num_nodes, a.num_genes, a.offset - 1)


if __name__ == "__main__":
    main()
