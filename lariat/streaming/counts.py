"""Running counts of read paths from a folder that files are dropped into.

Counts are sums, so the state is one number for each key, and a query in complete or update mode holds what a batch over
the same files would. Shares and abundances are computed from a trigger's snapshot by ``operators.events`` and ``quant``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lariat.operators import counts as C

PATHS = "gene string, read string, path array<int>, at timestamp"


def path_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Read paths of JSON files: gene, read, path and the time of arrival ``at``."""
    return spark.readStream.schema(PATHS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_edges(paths: DataFrame) -> DataFrame:
    """(gene, l, r, n): reads over each step so far."""
    return C.edge_counts(paths)


def windowed_edges(paths: DataFrame, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, gene, l, r, n) by time of arrival; reads later than ``late`` are left out and their windows' state freed."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("l"), F.element_at("path", i + 1).alias("r")))
    told = paths.withWatermark("at", late).where(F.size("path") > 1).select("at", "gene", F.explode(steps).alias("s"))
    return told.groupBy(F.window("at", length), "gene", "s.l", "s.r").agg(F.count(F.lit(1)).alias("n"))


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keeps the counts in a table in memory, called by name; ``checkpoint`` is a folder that the cluster shares."""
    return counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()
