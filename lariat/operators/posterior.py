"""Differences between two groups of replicates, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.functions.beta import probability


def pooled(replicates: DataFrame, keys: list[str], least_reads: int = 5) -> DataFrame:
    """keys, alpha, beta, mean, samples: the beta distribution with the moments of the replicates' equal mixture.

    replicates: keys, psi, n. A replicate is Beta(psi n + 1, (1 - psi) n + 1); those of too few reads are passed over.
    """
    a, b = F.col("psi") * F.col("n") + 1, (1 - F.col("psi")) * F.col("n") + 1
    mean, square = a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))
    used = replicates.where(F.col("psi").isNotNull() & (F.col("n") >= least_reads)).select(*keys, mean.alias("m"), (square + mean * mean).alias("s"))
    pool = used.groupBy(*keys).agg(F.avg("m").alias("mean"), F.avg("s").alias("s"), F.count(F.lit(1)).alias("samples"))
    t = F.col("mean") * (1 - F.col("mean")) / (F.col("s") - F.col("mean") * F.col("mean")) - 1
    return pool.withColumn("t", t).select(*keys, "samples", "mean", (F.col("mean") * F.col("t")).alias("alpha"), ((1 - F.col("mean")) * F.col("t")).alias("beta"))


#: What tells the events of two tables as the same.
EVENT = ["Gene", "Node", "Coord", "Strand", "Type"]


def replicates(table: DataFrame) -> DataFrame:
    """EVENT, psi, n, complexity, entropy out of node tables (``sources.text.psi_file``); circles are passed over.

    Complexity is read as the number after its letter; what is no number counts as 0.
    """
    k = F.coalesce(F.regexp_extract(F.col("Complexity"), r"(\d+)", 1).try_cast("int"), F.lit(0))
    return table.where("Type != 'BS'").select(*EVENT, F.col("Psi").alias("psi"), F.coalesce("Total_Reads", F.lit(0.0)).alias("n"), k.alias("complexity"), F.coalesce("Entropy", F.lit(0.0)).alias("entropy"))


def compared(first: DataFrame, second: DataFrame, least_reads: int = 5, least_samples: int = 1, amount: float = 0.0) -> DataFrame:
    """EVENT, psi_a, psi_b, delta_psi, probability, complexity, entropy of two sets of ``replicates``.

    Events meet by all of EVENT, in whatever order files have them. Complexity and entropy are the largest of any replicate
    with enough reads.
    """
    used = first.unionByName(second).where(F.col("psi").isNotNull() & (F.col("n") >= least_reads))
    most = used.groupBy(*EVENT).agg(F.max("complexity").alias("complexity"), F.max("entropy").alias("entropy"))
    return difference(pooled(first, EVENT, least_reads), pooled(second, EVENT, least_reads), EVENT, least_samples, amount=amount).join(most, EVENT)


def difference(first: DataFrame, second: DataFrame, keys: list[str], least_samples: int = 1, with_probability: bool = True, amount: float = 0.0) -> DataFrame:
    """keys, psi_a, psi_b, delta_psi (and probability) of events with enough replicates on both sides."""
    x = first.where(F.col("samples") >= least_samples).select(*keys, F.col("mean").alias("ma"), F.col("alpha").alias("a1"), F.col("beta").alias("b1"))
    y = second.where(F.col("samples") >= least_samples).select(*keys, F.col("mean").alias("mb"), F.col("alpha").alias("a2"), F.col("beta").alias("b2"))
    both = x.join(y, keys)
    out = [*keys, F.round("ma", 5).alias("psi_a"), F.round("mb", 5).alias("psi_b"), F.round(F.col("ma") - F.col("mb"), 5).alias("delta_psi")]
    return both.select(*out, F.round(probability(amount)("a1", "b1", "a2", "b2"), 5).alias("probability")) if with_probability else both.select(*out)
