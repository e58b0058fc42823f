"""Annotation and sequence files as DataFrames.

Plain files are split by Spark, gzipped ones are one split each. A line's place in its file is its split's first byte and
then its place in the split, so what depends on order (records of several lines, offsets of bases) is put together from
per-split totals, which are few rows, and no file passes through one task.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lariat.functions.sequence import two_bit


def is_gzipped(path: str) -> bool:
    return has_extension(path, ".gz")


def has_extension(path: str, extension: str) -> bool:
    return os.path.splitext(path)[1] == extension


def absolute(path: str) -> str:
    return os.path.abspath(os.path.expanduser(path))


def _lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """value, file, block (the first byte of a line's split) and line, which grows within a split."""
    return spark.read.options(**options).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def attribute(attrs: Column, name: str) -> Column:
    """The first value of a key in a GTF attribute column; "_" if it is absent."""
    value = F.regexp_extract(attrs, f'(?:^|[; ]){name} "?([^";]*)"?', 1)
    return F.when(value == "", "_").otherwise(value)


def gtf(spark: SparkSession, path: str, drop_low_support: bool = False) -> DataFrame:
    """Exon rows of a GTF file: chrom, start, end, strand, gene, transcript, gene_name, place (struct, order in the file).

    Comment lines and other features are passed over; gzip by suffix. With drop_low_support, transcripts of a support
    level other than 1, 2 or NA go; without it, a warning says that there are some. Reading fails where a transcript's
    lines are not side by side.
    """
    return gtf_rows(_lines(spark, path), drop_low_support)


def gtf_rows(lines: DataFrame, drop_low_support: bool = False) -> DataFrame:
    """The same from lines (value, file, block, line), which need not come from a file."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).withColumn("f", f).where((F.size("f") >= 9) & (F.get("f", F.lit(2)) == "exon"))
    attrs = F.get("f", F.lit(8))
    out = rows.select(
        F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(3)).cast("long").alias("start"), F.get("f", F.lit(4)).cast("long").alias("end"), F.get("f", F.lit(6)).alias("strand"),
        attribute(attrs, "gene_id").alias("gene"), attribute(attrs, "transcript_id").alias("transcript"), attribute(attrs, "gene_name").alias("gene_name"),
        F.split(attribute(attrs, "transcript_support_level"), " ")[0].alias("support"), F.struct("file", "block", "line").alias("place"),
    )
    low = ~F.col("support").isin("_", "1", "2", "NA")
    if drop_low_support:
        out = out.where(~low)
    elif not out.where(low).isEmpty():
        warnings.warn("some transcripts have a support level of 3 or more; drop_low_support leaves them out", stacklevel=2)
    return side_by_side(out).drop("support")


def side_by_side(exons: DataFrame) -> DataFrame:
    """The same rows; reading them fails where another transcript's line stands between those of one.

    Transcripts' spans of lines must not overlap. How far the spans before reach is found within splits, or 4,096 first
    bytes, then over those of a file in two steps: one row for each of them, so no file's transcripts meet in a task.
    """
    spans = exons.groupBy("transcript").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    spans = spans.select("transcript", "first", "last", F.col("first.file").alias("file"), F.expr("first.block div 4096").alias("near"), F.expr("first.block div 16777216").alias("far"))
    reached = lambda over, by: F.max("last").over(Window.partitionBy(*over).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    near = spans.groupBy("file", "far", "near").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    far = near.groupBy("file", "far").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    # Spans overlap somewhere if a span, or the first of a group, begins before what those before it reach.
    levels = [(spans, ["file", "far", "near"], "first"), (near, ["file", "far"], "near"), (far, ["file"], "far")]
    broken = [df.withColumn("reached", reached(over, by)).where("reached > first").agg(F.min("first").cast("string").alias("at")) for df, over, by in levels]
    failed = F.raise_error(F.concat(F.lit("lines of a transcript must stand side by side: one lies between those of another, before "), F.coalesce(*[f"_at{i}" for i in range(3)])))
    out = exons
    for i, one in enumerate(broken):
        out = out.crossJoin(F.broadcast(one.withColumnRenamed("at", f"_at{i}")))  # one row
    return out.where(F.when(F.coalesce(*[F.col(f"_at{i}") for i in range(3)]).isNotNull(), failed.cast("boolean")).otherwise(F.lit(True))).select(exons.columns)


def refflat(spark: SparkSession, path: str) -> DataFrame:
    """This format is no longer read."""
    raise ValueError("refFlat files are no longer read; give the annotation as GTF")


def _within(totals: DataFrame, order: list[str], by: list[str], value: str) -> DataFrame:
    """totals with ``first``: the sum of value over the rows before, by order within by; a few rows for each split."""
    return totals.withColumn("first", F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def fasta(spark: SparkSession, path: str, chroms: DataFrame | None = None) -> DataFrame:
    """Lines of sequence as (name, start, seq): upper case, start from 1 within the record; a name ends at its first blank.

    A record of any length stays in its lines. With chroms, only records whose name is in its first column. Text before
    the first header is passed over.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, at = None, 0, 0
        names = ["file", "block", "part", "name", "at", "seq"]
        for b in batches:
            rows = []
            for value, file, block in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block"))):
                if (file, block) != key:
                    key, part, at = (file, block), 0, 0
                if value.startswith(">"):
                    part, at = part + 1, 0
                    rows.append((file, block, part, (value[1:].split() or [""])[0], 0, ""))
                elif seq := "".join(value.split()).upper():
                    rows.append((file, block, part, None, at, seq))
                    at += len(seq)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("name", pa.string()), ("at", pa.int64()), ("seq", pa.string())]))

    pieces = _lines(spark, path).select("value", "file", "block").mapInArrow(cut, "file string, block long, part int, name string, at long, seq string")
    totals = pieces.groupBy("file", "block", "part").agg(F.max("name").alias("name"), F.sum(F.length("seq")).alias("n"))
    order = Window.partitionBy("file").orderBy("block", "part")
    totals = totals.withColumn("record", F.count("name").over(order)).withColumn("name", F.last("name", ignorenulls=True).over(order))
    totals = _within(totals.where("name is not null"), ["block", "part"], ["file", "record"], "n").select("file", "block", "part", F.col("name").alias("record_name"), "first")
    out = pieces.where("seq != ''").join(F.broadcast(totals), ["file", "block", "part"]).select(F.col("record_name").alias("name"), (F.col("first") + F.col("at") + 1).alias("start"), "seq")
    return out if chroms is None else out.join(F.broadcast(chroms.select(F.col(chroms.columns[0]).alias("name")).distinct()), "name", "left_semi")


def sequences(pieces: DataFrame) -> DataFrame:
    """(name, seq): whole records, for those that fit in a row."""
    return pieces.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda p: p["seq"]), "").alias("seq"))


def fastq(spark: SparkSession, path: str, offset: int = 33, other: str = "A", gzipped: bool = False) -> DataFrame:
    """read_id, seq, quality (array of int) of FASTQ files, records of four lines each.

    Bases outside A, C, G, T become ``other``. A split's lines are numbered from the count of those before it; the few
    records that lie across two splits are put together by a shuffle, the others where they are read. gzip by suffix;
    ``gzipped`` refuses files without it, which can't be read so.
    """
    if gzipped and not is_gzipped(path):
        raise ValueError("Spark tells gzip by the suffix .gz; rename the file")
    lines = _lines(spark, path).select("value", "file", "block")
    starts = _within(lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")), ["block"], ["file"], "n").select("file", "block", "first")

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held = None, 0, []
        schema = pa.schema([("file", pa.string()), ("record", pa.int64()), *((c, pa.string()) for c in ("head", "bases", "marks"))])
        column = ("head", "bases", None, "marks")

        def loose(part: list[tuple[int, str]]) -> list[dict]:
            return [{"file": key[0], "record": i // 4, column[i % 4]: v} for i, v in part if i % 4 != 2]

        for b in batches:
            rows: list[dict] = []
            for value, file, block, first in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block", "first"))):
                if (file, block) != key:
                    rows += loose(held)
                    key, n, held = (file, block), first, []
                held.append((n, value))
                n += 1
                if n % 4 == 0:
                    if len(held) == 4:
                        rows.append({"file": file, "record": held[0][0] // 4, "head": held[0][1], "bases": held[1][1], "marks": held[3][1]})
                    else:
                        rows += loose(held)
                    held = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist(loose(held), schema=schema)

    found = lines.join(F.broadcast(starts), ["file", "block"]).mapInArrow(assemble, "file string, record long, head string, bases string, marks string")
    whole = F.col("head").isNotNull() & F.col("bases").isNotNull() & F.col("marks").isNotNull()
    across = found.where(~whole).groupBy("file", "record").agg(*[F.max(c).alias(c) for c in ("head", "bases", "marks")]).where(whole)
    records = found.where(whole).select("head", "bases", "marks").unionByName(across.select("head", "bases", "marks"))
    return records.select(F.regexp_extract("head", r"^@(\S+)", 1).alias("read_id"), two_bit(F.col("bases"), other).alias("seq"), F.transform(F.split("marks", ""), lambda c: F.ascii(c) - offset).alias("quality"))


PSI_SCHEMA = "Gene string, Node string, Coord string, Strand string, Type string, Psi double, CI_Width double, CI string, Total_Reads double, Complexity string, Entropy double, Inc_Paths string, Exc_Paths string, Edges string"


def psi_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated node tables with a header, NA as null, gzip by suffix; ``file`` tells replicates apart."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA", schema=PSI_SCHEMA).withColumn("file", F.input_file_name())


def tpm_file(spark: SparkSession, path: str) -> DataFrame:
    """name, tpm: the first two fields by blanks; a header, whose second field is no number, is passed over."""
    f = F.split(F.trim("value"), r"\s+")
    # The header is the one line whose second field is no number.
    return _lines(spark, path).select(f.alias("f")).where(F.get("f", F.lit(1)).try_cast("double").isNotNull()).select(F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).cast("double").alias("tpm"))


def files(spark: SparkSession, pattern: str, folder: str = ".") -> list[str]:
    """Paths of a comma-separated list, or those in the folder whose name matches *pattern*.psi*, sorted."""
    if "," in pattern:
        return [p for p in pattern.split(",") if p]
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{pattern}*.psi*")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    return sorted(str(s.getPath()) for s in found)
