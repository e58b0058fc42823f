"""k-mers of sequences of any length, numbered and counted along each sequence once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODE = np.full(256, 255, np.uint8)
_CODE[list(b"ACGT")] = range(4)


def codes(seq: bytes, k: int) -> np.ndarray:
    """Numbers from 0 of all k-mers in order, first base most significant; those with other bases are left out. k <= 31."""
    base = _CODE[np.frombuffer(seq, np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for i in range(k):
        out = out << 2 | (base[i : i + n] & 3)
    bad = np.concatenate([[0], np.cumsum(base == 255)])
    return out[bad[k:] == bad[:n]]


def spelled(code: np.ndarray, k: int) -> list[str]:
    """The k-mers of numbers."""
    letters = np.frombuffer(b"ACGT", np.uint8)[code[:, None] >> (2 * np.arange(k - 1, -1, -1)) & 3]
    return [r.tobytes().decode() for r in letters]


def counted(df: DataFrame, k: int, column: str = "seq") -> DataFrame:
    """(kmer, kmer_index, n) over all rows: how often each k-mer stands in them, and its number from 1.

    A task adds up what it has seen before anything is shuffled.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(spelled(code, k), pa.string()), pa.array(code + 1), pa.array(n)], ["kmer", "kmer_index", "n"])

        for b in batches:
            for s in b.column(0).to_pylist():
                held.append(codes((s or "").encode(), k))
                size += len(held[-1])
            if size > 4_000_000:
                size = 0
                yield flush()
        if held:
            yield flush()

    return df.select(column).mapInArrow(count, "kmer string, kmer_index long, n long").groupBy("kmer", "kmer_index").agg(F.sum("n").alias("n"))


def listed(df: DataFrame, key: str, k: int, column: str = "seq") -> DataFrame:
    """(key, kmer): the distinct k-mers of each row."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key_, s in zip(b.column(0), b.column(1).to_pylist()):
                own = spelled(np.unique(codes((s or "").encode(), k)), k)
                yield pa.RecordBatch.from_arrays([pa.array([key_.as_py()] * len(own), key_.type), pa.array(own, pa.string())], [key, "kmer"])

    return df.select(key, column).mapInArrow(each, f"{key} {df.schema[key].dataType.simpleString()}, kmer string")
