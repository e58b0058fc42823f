"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A key goes to the first virtual node clockwise from its hash; keys that find their shard full go on clockwise to the
next shard with room. The bounds are as tight as they can be: shares of all rows that are at most one apart, so the law
that holds is ``rows``. Keys are placed by their number within an arc of the ring, which follows from the keys alone and
not from how the table is split; only the arcs' counts come to the driver: shards * virtual nodes of them, whatever the
corpus. As bounds are exact shares, one more shard also moves keys between old ones, where those fill up elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lariat.llm.common import configure, materialize

Run = tuple[int, int, int, int, int]


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, shard) of all virtual nodes in ring order; positions are signed 64-bit."""
    at = np.array([int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little", signed=True) for s in range(shards) for v in range(virtual)], np.int64)
    owner = np.repeat(np.arange(shards), virtual)
    order = np.argsort(at, kind="stable")
    return at[order], owner[order]


def place(counts: dict[int, int], owner: np.ndarray, shards: int) -> list[Run]:
    """(arc, from, to, shard, first slot): where the keys numbered from..to of each arc go.

    Every arc first fills its own shard; then what is left over goes clockwise. The shards with the most keys of
    their own have the rooms that are one larger.
    """
    total = sum(counts.values())
    own = np.bincount(owner, [counts.get(a, 0) for a in range(len(owner))], shards)
    room = np.full(shards, total // shards, np.int64)
    room[np.argsort(-own, kind="stable")[: total % shards]] += 1
    used = np.zeros(shards, np.int64)
    runs: list[Run] = []
    over: list[tuple[int, int, int]] = []
    for arc in range(len(owner)):
        n, s = counts.get(arc, 0), int(owner[arc])
        k = int(min(n, room[s] - used[s]))
        if k:
            runs.append((arc, 0, k, s, int(used[s])))
            used[s] += k
        if n > k:
            over.append((arc, k, n))
    for arc, at, n in over:
        step = arc
        while at < n:
            step = (step + 1) % len(owner)
            s = int(owner[step])
            k = int(min(n - at, room[s] - used[s]))
            if k:
                runs.append((arc, at, at + k, s, int(used[s])))
                used[s] += k
                at += k
    return runs


#: Ranges of the ring within which keys are sorted, each in one task.
RANGES = 16
#: Equal rows are written out in runs of so many.
RUN = 4096


def _numbered(keyed: DataFrame) -> DataFrame:
    """Rows with their gapless number within an arc, by key and then by all columns, however the rows are split.

    Equal rows are counted first, so that many rows of one key are one row until their numbers are written out.
    """
    row = keyed.columns
    distinct = keyed.groupBy(*row).agg(F.count(F.lit(1)).alias("_m")).withColumn("_range", F.shiftrightunsigned("_key", 64 - RANGES).cast("int"))
    distinct = materialize(distinct, "distinct")
    # Numbers up to a range: at most 2**RANGES ranges and one more for each arc, so they may be broadcast.
    before = Window.partitionBy("_arc").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = distinct.groupBy("_arc", "_range").agg(F.sum("_m").alias("_n")).select("_arc", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_arc", "_range").orderBy(*row).rowsBetween(Window.unboundedPreceding, -1)
    at = distinct.withColumn("_at", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(F.broadcast(starts), ["_arc", "_range"]).withColumn("_at", F.col("_at") + F.col("_start"))
    at = at.select(*row, "_m", "_at")
    few = at.where(F.col("_m") <= RUN).withColumn("rank", F.explode(F.expr("sequence(_at, _at + _m - 1)")))
    many = at.where(F.col("_m") > RUN).withColumn("_run", F.explode(F.expr(f"sequence(0, (_m - 1) div {RUN})"))).repartition("_arc", "_run")
    many = many.withColumn("rank", F.explode(F.expr(f"sequence(_at + _run * {RUN}, _at + least(_m, (_run + 1) * {RUN}) - 1)")))
    return few.select(*row, "rank").unionByName(many.select(*row, "rank"))


def shard(docs: DataFrame, shards: int = 24, virtual: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of docs.

    size: UTF-8 bytes of the text plus 8; a null text has 8 and the checksum of an empty one. Keys are ids; repeated and
    null ids share a place on the ring and are told apart by number, so a group of any size spreads over shards as they
    fill. Equal rows are interchangeable. An empty table gives no rows. Other columns are not carried.
    """
    if not 1 <= shards * virtual <= 1 << 16:
        raise ValueError("the ring's runs are broadcast: at most 65536 virtual nodes")
    configure(docs.sparkSession)
    at, owner = ring(shards, virtual)

    @F.arrow_udf("int")
    def arc_of(key: pa.Array) -> pa.Array:
        return pa.array((np.searchsorted(at, key.to_numpy(zero_copy_only=False)) % len(at)).astype(np.int32))

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = keyed.withColumn("_key", F.xxhash64("doc_id")).withColumn("_arc", arc_of("_key"))
    counts = {r["_arc"]: r["count"] for r in keyed.groupBy("_arc").count().collect()}
    ranked = _numbered(keyed.select("_arc", "_key", "doc_id", "text_crc32", "size"))
    runs = place(counts, owner, shards)
    placed = docs.sparkSession.createDataFrame(runs or [(0, 0, 0, 0, 0)], "_at int, _from long, _to long, shard int, _slot long")
    inside = (F.col("_arc") == F.col("_at")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    return ranked.join(F.broadcast(placed), inside).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("rank") - F.col("_from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
