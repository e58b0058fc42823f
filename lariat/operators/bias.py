"""Corrections of counts for what a read begins with and for the share of G and C in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where reads are looked at (fixed values): hexamers at the start, hexamers further on, and windows of fifty bases.
FORE, BACK, HEXAMER = (1, 2), tuple(range(23, 33)), 6
WINDOW, WINDOW_AT, WINDOW_STEP = 50, 5, 10
#: Bin of each number of G and C in a window: the quotient of their share by 0.05 in floating point, cut.
_BIN = np.array([int((i / WINDOW) // 0.05) + 1 for i in range(WINDOW + 1)])


def hexamers(seq: Column) -> Column:
    """(hexamer, fore) at the fixed places of a read; places that reach over its end have none."""
    parts = [F.struct(F.substring(seq, i, HEXAMER).alias("hexamer"), F.lit(i in FORE).alias("fore")) for i in (*FORE, *BACK)]
    return F.filter(F.array(*parts), lambda p: F.length(p["hexamer"]) == HEXAMER)


def gc_bins(seq: Column) -> Column:
    """The bins of a read's windows, from 1; counted along the read once, whatever its length."""

    @F.arrow_udf("array<int>")
    def bins(column: pa.Array) -> pa.Array:
        out = []
        for s in column.to_pylist():
            raw = np.frombuffer((s or "").encode(), np.uint8)
            total = np.concatenate([[0], np.cumsum((raw == 71) | (raw == 67))])
            at = np.arange(WINDOW_AT - 1, max(WINDOW_AT - 1, len(raw) - WINDOW), WINDOW_STEP)
            out.append(_BIN[total[at + WINDOW] - total[at]].tolist() if len(at) else [])
        return pa.array(out, pa.list_(pa.int32()))

    return bins(seq)


def primer_weights(reads: DataFrame) -> DataFrame:
    """(hexamer, weight): its share further on over its share at the start, over all reads; 4096 rows at most."""
    seen = reads.select(F.explode(hexamers(F.col("seq"))).alias("h")).groupBy("h.hexamer").agg(F.count_if("h.fore").alias("fore"), F.count_if(~F.col("h.fore")).alias("back"))
    total = seen.agg(F.sum("fore").alias("f"), F.sum("back").alias("b"))
    return seen.where("fore > 0").join(F.broadcast(total)).select("hexamer", ((F.col("back") / F.col("b")) / (F.col("fore") / F.col("f"))).alias("weight"))


def primer_adjusted(reads: DataFrame, weights: DataFrame) -> DataFrame:
    """reads(read_id, seq, ...) with ``value``: the mean weight of the hexamers at its start."""
    at = reads.select("read_id", F.explode(F.filter(hexamers(F.col("seq")), lambda h: h["fore"])).alias("h"))
    value = at.join(F.broadcast(weights), at.h.hexamer == weights.hexamer).groupBy("read_id").agg((F.sum("weight") / len(FORE)).alias("value"))
    return reads.join(value, "read_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def gc_weights(reads: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(bin, weight): the share of windows expected over that seen in reads; 21 rows at most.

    transcripts: expected (an array of shares by bin) and tpm. Bins that no read has weigh 1.
    """
    fore = reads.select(F.explode(gc_bins(F.col("seq"))).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).cast("double").alias("fore"))
    back = transcripts.select("tpm", F.posexplode("expected").alias("i", "share")).groupBy((F.col("i") + 1).alias("bin")).agg(F.sum(F.col("share") * F.col("tpm")).alias("back"))
    both = fore.join(back, "bin", "full").select("bin", F.coalesce("fore", F.lit(0.0)).alias("fore"), F.coalesce("back", F.lit(0.0)).alias("back"))
    total = both.agg(F.sum("fore").alias("f"), F.sum("back").alias("b"))
    return both.join(F.broadcast(total)).select("bin", F.when((F.col("fore") > 0) & (F.col("f") > 0) & (F.col("b") > 0), (F.col("back") / F.col("b")) / (F.col("fore") / F.col("f"))).otherwise(1.0).alias("weight"))


def gc_adjusted(counts: DataFrame, seen: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """counts(keys, n) times the mean weight of the windows of the reads behind them; seen: keys, bin, k windows.

    The same expression holds for nodes, edges, long paths, circles and reads of several places.
    """
    mean = seen.join(F.broadcast(weights), "bin").groupBy(*keys).agg((F.sum(F.col("k") * F.col("weight")) / F.sum("k")).alias("_w"))
    matched = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    return counts.alias("c").join(mean.alias("m"), matched, "left").select(*[F.col(f"c.{c}") for c in counts.columns if c != "n"], (F.col("c.n") * F.coalesce("m._w", F.lit(1.0))).alias("n"))
