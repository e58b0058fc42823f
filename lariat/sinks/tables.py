"""Result tables as tab-separated lines: formatting is expressions, writing is Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lariat.functions.sequence import significant

#: Headers of the result files (fixed values of their formats).
PSI_HEADER = "Gene\tNode\tCoord\tStrand\tType\tPsi\tCI_Width\tCI_Lo,Hi\tTotal_Reads\tComplexity\tEntropy\tInc_Paths\tExc_Paths\tEdges"
DIFF_HEADER = "Gene\tNode\tCoord\tStrand\tType\tPsi_A\tPsi_B\tDeltaPsi\tProbability\tComplexity\tEntropy"
JUNCTION_HEADER = "CHROM\tDONOR_COORD\tACCEPTOR_COORD\tGENEID:NODES:TYPE\tREADCOUNT\tSTRAND"


def coord(chrom: Column, first: Column, last: Column, strand: Column | None = None) -> Column:
    """chr:first-last, and :strand."""
    parts = [chrom, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string")]
    return F.concat(*parts, *([F.lit(":"), strand] if strand is not None else []))


def text(value: Column) -> Column:
    """A value as text, NA for null."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def complexity(k: Column) -> Column:
    return F.concat(F.lit("K"), k.cast("string"))


def node_list(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), "-")


def paths(column: Column) -> Column:
    """path:share of each, NA without any."""
    return F.coalesce(F.array_join(F.transform(column, lambda p: F.concat(node_list(p["path"]), F.lit(":"), F.round(p["psi"], 6).cast("string"))), ","), F.lit("NA"))


def edges(column: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(column, lambda e: F.concat(e["l"].cast("string"), F.lit("-"), e["r"].cast("string"), F.lit(":"), F.round(e["n"], 1).cast("string"))), ","), F.lit("NA"))


def psi_lines(events: DataFrame, nodes: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, node, value): a line of 14 fields for each row of ``events.inclusion``."""
    at = nodes.select("gene", "node", "coord", (F.col("coord") + F.col("length") - 1).alias("end"))
    other = at.select("gene", F.col("node").alias("until"), F.col("coord").alias("back"))
    rows = events.join(at, ["gene", "node"]).join(other, ["gene", "until"], "left").join(genes.select("gene", "chrom", "strand"), "gene")
    circle, known = F.col("motif") == "BS", F.col("psi").isNotNull()
    na = lambda c: F.when(known, c).otherwise(F.lit("NA"))
    fields = [
        F.col("gene").cast("string"), F.when(circle, F.concat_ws("-", "node", "until")).otherwise(F.col("node").cast("string")),
        coord(F.col("chrom"), F.when(circle, F.col("end")).otherwise(F.col("coord")), F.when(circle, F.col("back")).otherwise(F.col("end"))), F.col("strand"), F.col("motif"),
        na(F.col("psi").cast("string")), na(F.round(F.col("hi") - F.col("lo"), 4).cast("string")), na(F.concat_ws(",", F.col("lo").cast("string"), F.col("hi").cast("string"))), na(significant(F.col("total"), 3).cast("string")),
        na(F.coalesce(complexity(F.col("complexity")), F.lit("NA"))), na(text(F.col("entropy"))), na(paths(F.col("inclusion"))), na(paths(F.col("exclusion"))), na(edges(F.col("edges"))),
    ]
    return rows.select("gene", "node", F.concat_ws("\t", *fields).alias("value"))


def tpm_lines(table: DataFrame, key: str) -> DataFrame:
    """Gene or transcript, abundance, reads."""
    return table.select(F.concat_ws("\t", F.col(key), F.col("tpm").cast("string"), F.col("count").cast("string")).alias("value"))


def junction_lines(junctions: DataFrame) -> DataFrame:
    return junctions.select(F.concat_ws("\t", "chrom", F.col("donor").cast("string"), F.col("acceptor").cast("string"), F.concat(F.col("gene").cast("string"), F.lit(":"), F.col("l").cast("string"), F.lit("-"), F.col("r").cast("string"), F.lit(":"), F.col("class")), F.col("n").cast("string"), "strand").alias("value"))


def exon_lines(exons: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene, coordinates, nodes and whether an annotated transcript has them side by side."""
    # Genes are few beside exons, so a table of them spares sorting these.
    rows = exons.join(genes.select("gene", "chrom", "strand").hint("shuffle_hash"), "gene")
    return rows.select(F.concat_ws("\t", "gene", coord(F.col("chrom"), F.col("low"), F.col("high"), F.col("strand")), F.array_join(F.sequence("first", "last").cast("array<string>"), ","), F.when(F.col("annotated"), "Y").otherwise("N")).alias("value"))


def exon_header(nodes_column: str = "Nodes") -> str:
    return f"Gene\tPotential_Exon\t{nodes_column}\tIs_Annotated"


def statistics_lines(statistics: DataFrame, index: str, version: str) -> DataFrame:
    """(line, value): the one row of ``mapping_statistics`` as keys and values by section."""
    percent = lambda c: F.concat(text(F.col(c)), F.lit("%"))
    whole = lambda c: F.col(c).cast("string")
    entries = [
        (None, F.lit(version)), ("Mapped_Index", F.lit(index)), ("Read_Length", whole("read_length")), ("Total_Reads", whole("total")),
        (None, F.lit("Mapping Stats")), ("Mapped_Reads", whole("mapped")), ("Mapped_Percent", percent("mapped_percent")),
        (None, F.lit("Multi-loci Mapping")), ("Multimap_Reads", whole("multi")), ("Multimap_Percent", percent("multi_percent")),
        (None, F.lit("Unspliced Reads")), ("Exon_Body_Reads", whole("body_reads")), ("Exon_Body_Percent", percent("body_percent")),
        (None, F.lit("Spliced Reads")), ("Junction_Reads", whole("junction_reads")), ("Junction_Percent", percent("junction_percent")), ("Junction_Number", whole("junctions")),
        ("Annotated_Junc_Reads", whole("annotated_reads")), ("Annotated_Junc_Percent", percent("annotated_percent")), ("Annotated_Junc_Number", whole("annotated_junctions")), ("Novel_Junc_Number", whole("novel_junctions")), ("Novel_Junc_Percent", percent("novel_percent")),
    ]
    line = lambda key, value: F.concat_ws("\t", F.lit(key), value) if key else F.concat(F.lit("# -------- "), value, F.lit(" ---------"))
    return statistics.select(F.posexplode(F.array(*[line(k, v) for k, v in entries])).alias("line", "value"))


def diff_lines(differences: DataFrame) -> DataFrame:
    """Gene, node, place, strand, type, both shares, their difference, its probability, complexity and entropy."""
    number = lambda c: significant(F.col(c), 5).cast("string")
    return differences.select(F.concat_ws("\t", "Gene", "Node", "Coord", "Strand", "Type", number("psi_a"), number("psi_b"), number("delta_psi"), number("probability"), complexity(F.col("complexity")), F.col("entropy").cast("string")).alias("value"))


def write(lines: DataFrame, path: str, header: str | None = None, order: list[str] | None = None) -> None:
    """Gzipped text files in a folder, each with the header; sorted over all files by ``order``."""
    rows = lines.orderBy(*order) if order else lines
    out = rows.select(F.col("value").alias(header or "value"))
    # No quotes and no escapes: a line is written as it is, its tabs included.
    out.write.option("header", header is not None).option("sep", "\x01").option("quote", "").option("escapeQuotes", False).option("emptyValue", "").option("compression", "gzip").mode("overwrite").csv(path)


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """All lines of a folder that ``write`` made, headers once; for files that fit in memory."""
    seen: dict[str, None] = {}
    out = [r["value"] for r in spark.read.text(path).collect()]
    return [x for x in out if x.startswith(("Gene\t", "CHROM\t", "Isoform\t")) is False or not (x in seen or seen.setdefault(x))]


def save_index(folder: str, **tables: DataFrame) -> None:
    """An index as one folder of Parquet a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
