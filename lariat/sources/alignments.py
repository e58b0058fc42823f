"""Aligned reads: SAM text and BAM files as DataFrames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of CIGAR operations and of bases by their codes in BAM (fixed values of the format).
_OPERATIONS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def sam(spark: SparkSession, path: str) -> DataFrame:
    """name, flag, chrom, pos, mapq, cigar, seq of SAM text, header lines left out; pos from 1."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(f.alias("f")).where(F.size("f") >= 11)
    return rows.select(F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).cast("int").alias("flag"), F.get("f", F.lit(2)).alias("chrom"), F.get("f", F.lit(3)).cast("long").alias("pos"), F.get("f", F.lit(4)).cast("int").alias("mapq"), F.get("f", F.lit(5)).alias("cigar"), F.get("f", F.lit(9)).alias("seq"))


def _inflated(raw: bytes) -> Iterator[bytes]:
    """The blocks of a BGZF file, one gzip member after another."""
    while raw:
        member = zlib.decompressobj(31)
        yield member.decompress(raw)
        raw = member.unused_data


def records(raw: bytes) -> Iterator[dict]:
    """The records of a BAM file's bytes."""
    held = bytearray()
    blocks = _inflated(raw)

    def take(n: int) -> bytes:
        while len(held) < n:
            held.extend(next(blocks))
        out = bytes(held[:n])
        del held[:n]
        return out

    number = lambda: struct.unpack("<i", take(4))[0]
    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    take(number())
    names = []
    for _ in range(number()):
        names.append(take(number())[:-1].decode())
        number()
    while True:
        try:
            body = take(number())
        except StopIteration:
            return
        chrom, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack("<iiBBHHHi", body[:20])
        at = 32 + n_name
        cigar = struct.unpack(f"<{n_cigar}I", body[at : at + 4 * n_cigar])
        at += 4 * n_cigar
        bases = body[at : at + (n_seq + 1) // 2]
        yield {
            "name": body[32 : 32 + n_name - 1].decode(), "flag": flag, "chrom": names[chrom] if chrom >= 0 else "*", "pos": pos + 1, "mapq": mapq,
            "cigar": "".join(f"{c >> 4}{_OPERATIONS[c & 15]}" for c in cigar) or "*", "seq": "".join(_BASES[x >> 4] + _BASES[x & 15] for x in bases)[:n_seq],
        }


def bam(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``sam`` from BAM files, a task for each file; a file's bytes must fit in a worker's memory."""
    schema = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content"):
                held = []
                for r in records(raw.as_py()):
                    held.append(r)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "name string, flag int, chrom string, pos long, mapq int, cigar string, seq string")


def is_spliced(cigar: Column) -> Column:
    return F.contains(cigar, F.lit("N"))


def is_forward(flag: Column) -> Column:
    return flag.bitwiseAND(16) == 0


def _operations(cigar: Column) -> Column:
    """(n, op) of each operation."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda o: F.struct(F.regexp_extract(o, r"^(\d+)", 1).cast("long").alias("n"), F.substring(o, -1, 1).alias("op")))


def right_end(pos: Column, cigar: Column) -> Column:
    """The last position of the reference that a read covers."""
    return pos + F.aggregate(_operations(cigar), F.lit(0).cast("long"), lambda a, o: a + F.when(o["op"].isin("M", "=", "X", "D", "N"), o["n"]).otherwise(F.lit(0).cast("long"))) - 1


def introns(reads: DataFrame, gaps: str = "N") -> DataFrame:
    """reads with ``donor`` and ``acceptor``, a row for each gap: the last base before it and the first one after it.

    gaps: the operations that count; "ND" takes deletions for gaps too.
    """
    moved = F.aggregate(
        _operations(F.col("cigar")), F.struct(F.col("pos").alias("at"), F.array().cast("array<struct<donor:bigint,acceptor:bigint>>").alias("found")),
        lambda a, o: F.struct(
            (a["at"] + F.when(o["op"].isin("M", "=", "X", "D", "N"), o["n"]).otherwise(F.lit(0).cast("long"))).alias("at"),
            F.when(o["op"].isin(*gaps), F.concat(a["found"], F.array(F.struct((a["at"] - 1).alias("donor"), (a["at"] + o["n"]).alias("acceptor"))))).otherwise(a["found"]).alias("found"),
        ),
    )
    return reads.where(is_spliced(F.col("cigar")) | F.lit(gaps != "N")).withColumn("_gap", F.explode(moved["found"])).select(*reads.columns, "_gap.donor", "_gap.acceptor")
