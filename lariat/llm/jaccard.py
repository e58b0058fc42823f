"""N-gram Jaccard join: token-combination prefixes, then verification.

A document is the set of its distinct k-word shingles (its tokens). Sets with Jaccard similarity of at least t share
ceil(t * n) tokens, so their first n - ceil(t * n) + j tokens in any common order share j. The order puts rare tokens
first, by the logarithm of their count and then by hash, and frequent ones after them, by count. The logarithms come from
a sketch of 2**SKETCH cells, each with the highest one of its tokens: 2 MB, whatever the number of tokens.

* rare class: a rare token of the 1-prefix is a signature by itself;
* frequent class: if the 1-prefix reaches a frequent token, all rare tokens of the set stand before it. Then two
  similar sets that share no rare signature share j frequent tokens of the prefix extended to j = g + 1. Dealt into g
  groups by hash, two of them fall into one group: the pairs within groups are signatures. g follows the size class,
  and a set signs for its own class and the next, so that any two sizes within t of each other meet in one class.
  Sets of one and two tokens that are similar at t = 1/2 share but one, which is a signature by itself, frequent or not.
  Sets that meet so and share a rare token as well meet by that one too; so here their intersection may be bounded by
  their frequent tokens alone.

Equal sets are one class before anything else. Documents of a signature are first compared with three of them, the
smallest, the largest and one by hash, a frequent token's in parts of some PART documents; the links found make components.
Only signatures that still hold several components go on, and there only the documents outside the signature's largest
component look for partners, in other components. So a group of near copies costs a star and the documents that it leaves
out times its size, not all its pairs, and yet no link between components is lost. A pair is made at the first signature
the two share, as far as the FIRST first ones of each tell. Verification streams the texts behind each centre through
Arrow and compares whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lariat.llm.common import SLICE, U64, bytes_of, configure, discard, id_filter, map_batches, materialize, mix, release, shingle_hashes, whole_ids, word_hashes
from lariat.llm.components import components

#: Most frequent tokens that are broadcast: 8 bytes and a count each, 1 MB.
FREQUENT = 1 << 16
#: The least number of hash classes whose counts bound an intersection.
COUNTERS = 128
#: Bits of a token that choose its cell in the sketch of counts.
SKETCH = 22
#: A group's third centre is the least by one of so many hashes, which one goes by signature.
CENTRES = 32
#: About so many documents of a signature meet in one part at first.
PART = 512
#: Tokens that a task gathers until it counts them: 40 MB, sorted in place.
GATHERED = 5_000_000
#: Tasks of fewer tokens count those too that one of their documents holds; others lose at most one of a token.
WHOLE = 1 << 19
#: The bit that makes a signature of a single token a negative long.
SINGLE = U64(1 << 63)
#: A document's first signatures that tell at which one a pair of documents meets first: 8 bytes each, in every row.
FIRST = 8


def token_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z in lower case."""
    return np.unique(shingle_hashes(word_hashes(text, lower=True)[0], k))


def counted_tokens(tokens: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """(token, count) of the distinct ones of tokens, which are sorted in place; those that occur once only if single."""
    tokens.sort()
    again = np.zeros(len(tokens) + 1, bool)  # whether a token equals the one before it; the last one says that they end
    np.equal(tokens[1:], tokens[:-1], out=again[1:-1])
    begins, ends = ~again[:-1], ~again[1:]
    if not single:
        begins, ends = begins & again[1:], ends & again[:-1]
    first = np.flatnonzero(begins)
    return tokens[first], np.flatnonzero(ends) + 1 - first


def _least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _size_class(n: int, num: int, den: int) -> int:
    return int(math.floor(math.log(n) / math.log(den / num) + 1e-9))


def count_classes(counted: DataFrame) -> np.ndarray:
    """The sketch of counted(token, n): each cell's highest floor(log2(n)), at most 15. It leaves Spark as words of 16 cells."""
    cells = counted.select(F.shiftrightunsigned("token", 64 - SKETCH).alias("cell"), F.least(F.floor(F.log2("n")), F.lit(15)).alias("class")).groupBy("cell").agg(F.max("class").alias("class"))
    words = cells.groupBy(F.shiftright("cell", 4).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(class, cast(4 * (cell % 16) as int))")).alias("b")).toArrow()
    packed = np.zeros(1 << (SKETCH - 4), np.int64)
    packed[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return packed.view(U64)


def signatures(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, num: int, den: int, classes: np.ndarray | None = None, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """(signature, place, gap, number of frequent tokens, parts) of one sorted token set.

    frequent: sorted hashes, rank: their order, held: how many documents hold them. A pair's place is -1 - p, where p is
    that of its earlier token among the set's frequent ones; the gap leads to the later one. parts: in how many a
    signature's documents are dealt at first, by the count of its token or the lesser one of its two.
    """
    none = np.zeros(0, np.int32)
    n = len(tokens)
    if not n or num * n > den * (n - 1):  # one token more or less is too much already: only equal sets link
        if not n or num * (n + 1) > den * n:
            return np.zeros(0, U64), none, none, 0, none
    at = np.searchsorted(frequent, tokens)
    common = (at < len(frequent)) & (frequent[np.minimum(at, max(len(frequent) - 1, 0))] == tokens) if len(frequent) else np.zeros(n, bool)
    rare = tokens[~common]  # in order of hash, which is random
    level = np.zeros(len(rare), np.int32)
    if classes is not None:
        cell = rare >> U64(64 - SKETCH)
        level = (classes[(cell >> U64(4)).astype(np.int64)] >> ((cell & U64(15)) << U64(2)) & U64(15)).astype(np.int32)
        order = np.argsort(level, kind="stable")
        rare, level = rare[order], level[order]
    order = np.argsort(rank[at[common]], kind="stable")
    often = tokens[common][order]
    holders = np.ones(len(often), np.int64) if held is None else held[at[common]][order]
    prefix = n - _least_overlap(n, num, den) + 1
    # Where a single shared token may suffice, at a similarity of a half, frequent ones are signatures too.
    single = max(0, prefix - len(rare)) if _least_overlap(n, num, den) == 1 else 0
    alone = np.concatenate([rare[:prefix], often[:single]])
    sigs, places, gaps = [alone], [np.arange(len(alone), dtype=np.int32)], [np.zeros(len(alone), np.int32)]
    parts = [np.left_shift(2, level[:prefix]) // PART + 1, holders[:single] // PART + 1]
    if len(rare) < prefix:
        own = _size_class(n, num, den)
        for c in (own, own + 1):
            groups = max(1, int((den / num) ** c * (den - num) / den / 4))
            reach = min(n, prefix + groups) - len(rare)
            taken = often[:reach]
            group = (mix(taken ^ U64(c)) % U64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            taken, group = taken[order], group[order]
            step = 1
            while True:  # pairs of the same group at a distance of step
                same = np.flatnonzero(group[step:] == group[:-step]) if step < len(group) else np.zeros(0, np.int64)
                if not len(same):
                    break
                x, y = taken[same], taken[same + step]
                sigs.append(mix(np.minimum(x, y) * U64(0x9E3779B97F4A7C15) + np.maximum(x, y) + U64(c)))
                places.append((-1 - order[same]).astype(np.int32))
                gaps.append((order[same + step] - order[same]).astype(np.int32))
                parts.append((np.minimum(holders[order[same]], holders[order[same + step]]) // PART + 1).astype(np.int32))
                step += 1
    return np.concatenate(sigs), np.concatenate(places), np.concatenate(gaps), len(often), np.concatenate(parts)


def similar_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs: components of the pairs with den * |A & B| >= num * |A | B|.

    A row's set is that of its whole text; a text with fewer than k words has one shingle, and one without words
    (null and empty texts) has none and links with nothing. Rows that share an id are one node, which has the links of
    each of them. A null id can't be a node: its component is null. An empty table gives no rows. Only the id and
    the text are read; other columns are not carried. Ids must be whole numbers. num / den must be at least a half.
    """
    spark = docs.sparkSession
    configure(spark)
    narrow = docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's size and digest; then this task's tokens, of many only those that several of its documents hold."""
        held, size = np.empty(GATHERED, U64), 0
        names = ["doc_id", "n_shingles", "digest", "counts", "token", "n"]

        def flush() -> Iterator[pa.RecordBatch]:
            token, count = counted_tokens(held[:size], size < WHOLE)
            for at in range(0, len(token), SLICE):
                t, n = token[at : at + SLICE], count[at : at + SLICE]
                nothing, blank = pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.binary())
                yield pa.RecordBatch.from_arrays([nothing, nothing, blank, blank, pa.array(t.view(np.int64)), pa.array(n)], names)

        for b in batches:
            sizes, digests, counts = [], [], []
            for t in bytes_of(b.column("_text")):
                s = token_set(t, k)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                counts.append(class_counts(s))
                if size + len(s) > len(held):
                    yield from flush()
                    size = 0
                    if len(s) > len(held):
                        held = np.empty(len(s), U64)
                held[size : size + len(s)] = s
                size += len(s)
            nothing = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.binary()), nothing, nothing], names)
        yield from flush()

    seen = materialize(narrow.mapInArrow(scan, "doc_id long, n_shingles long, digest binary, counts binary, token long, n long"), "tokens")
    rows = seen.where("token is null").select("doc_id", "n_shingles", "digest", "counts")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    # At most FREQUENT / 2 tokens can have this count, as each document counts a token once; a count misses total / WHOLE
    # at most, a sixteenth of it.
    floor = max(32, -(-2 * total // FREQUENT))
    counted = materialize(seen.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")), "counted")
    top = counted.where(F.col("n") >= floor).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    hashes, holders = top.column("token").to_numpy().view(U64), top.column("n").to_numpy()
    order = np.lexsort((hashes, holders))
    hashes, holders = hashes[order], holders[order]
    by_hash = np.argsort(hashes)
    table = spark.sparkContext.broadcast((hashes[by_hash], by_hash, count_classes(counted.where(F.col("n") < floor)), holders[by_hash]))

    # One document stands for all with its set. Written, so that the join may split a set that very many hold.
    keyed = materialize(rows.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "keyed")
    copies = materialize(rows.where("doc_id is not null").join(keyed, "digest").where("doc_id != rep").select("doc_id", "rep").distinct(), "copies")
    known = narrow.where("doc_id is not null and _text is not null")
    maybe_copy = id_filter(copies, "doc_id")
    alone = known.where(~maybe_copy("doc_id"))
    rest = known.where(maybe_copy("doc_id")).join(copies.select("doc_id").distinct().join(keyed.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").hint("shuffle_hash"), "doc_id", "left_anti")
    alone = alone.unionByName(rest)

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        frequent, rank, classes, holders = table.value
        ids, sets, sigs, salts, ats, gaps, sizes, afters = [], [], [], [], [], [], [], []
        for i, t in zip(b.column("doc_id").to_pylist(), bytes_of(b.column("_text"))):
            tokens = token_set(t, k)
            s, p, g, often, parts = signatures(tokens, frequent, rank, num, den, classes, holders)
            ids.append(np.full(len(s), i, np.int64))
            sets.append(np.full(len(s), np.bitwise_xor.reduce(mix(tokens)) if len(tokens) else 0, U64))
            # Single tokens are the lower longs: a pair that shares one must meet there, where all tokens bound it.
            sigs.append(np.where(p < 0, s & ~SINGLE, s | SINGLE))
            salts.append(np.where(parts > 1, mix(np.array([i], np.int64).view(U64)).astype(np.int64) % parts, -1).astype(np.int32))
            at = np.where(p < 0, -1 - p, p)
            ats.append(at.astype(np.int32))
            gaps.append(g)
            sizes.append(np.full(len(s), len(tokens), np.int32))
            # Tokens after it that can be shared: of all of the set, or of the frequent ones for a pair of those.
            afters.append((np.where(p < 0, often, len(tokens)) - at - g - 1).astype(np.int32))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        columns = {"sig": cat(sigs, U64).view(np.int64), "salt": cat(salts, np.int32), "doc_id": cat(ids, np.int64), "set": cat(sets, U64).view(np.int64), "size": cat(sizes, np.int32), "at": cat(ats, np.int32), "gap": cat(gaps, np.int32), "after": cat(afters, np.int32)}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    # salt: a document's part of a signature that many may hold, -1 where all of them meet.
    signed = map_batches(alone, sign, "sig long, salt int, doc_id long, set long, size int, at int, gap int, after int")
    part = Window.partitionBy("sig", "salt")
    held = F.struct("doc_id", "size", "at", "gap", "after")
    met = signed.withColumn("_c", F.min(held).over(part)).withColumn("_last", F.max(held).over(part)).withColumn("_any", F.min(F.struct(F.xxhash64("doc_id", F.pmod("sig", F.lit(CENTRES))).alias("by"), held.alias("held"))).over(part)["held"])
    met = materialize(met.where("_c.doc_id != _last.doc_id or salt >= 0").select("sig", "salt", "doc_id", "set", "size", "at", "gap", "after", F.col("_c.doc_id").alias("centre"), F.array_distinct(F.array("_c", "_last", "_any")).alias("centres")), "met")
    release(spark)
    # The parts' smallest documents meet at the smallest of all.
    tops = met.where("salt >= 0 and doc_id = centre").groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).where("first != _last")
    over = met.where("salt >= 0 and doc_id = centre").join(tops.select("sig", "first"), "sig").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    stars = met.withColumn("c", F.explode("centres")).where(_possible("", "c.", num, den)).select(F.least("c.doc_id", "doc_id").alias("a"), F.greatest("c.doc_id", "doc_id").alias("b")).unionByName(over).where("a != b")
    stars = materialize(stars.distinct(), "stars")
    counts = rows.where("doc_id is not null and digest is not null").select("doc_id", "counts")
    links = _verified(stars, counts, known, k, num, den)
    settled = components(links)
    first = materialize(settled, "first")

    # Signatures that hold several components yet: what isn't in their largest one looks for partners in other components,
    # as far as sizes and places allow.
    comp = met.join(first, met.doc_id == first.node, "left").select("sig", "doc_id", "set", "size", "at", "gap", "after", F.coalesce("component", "doc_id").alias("comp"))
    mixed = comp.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("sig").agg(F.max(F.struct("_n", "comp"))["comp"].alias("top"), F.count(F.lit(1)).alias("_k")).where("_k > 1").select("sig", "top")
    comp = materialize(comp.join(mixed, "sig"), "mixed")
    release(spark)
    # A set's (of several texts of an id, each one's) first signatures; a pair meets before if it shares one of the earlier.
    told = comp.join(_first_signatures(comp), ["doc_id", "set"])
    told = told.select("sig", "doc_id", "size", "at", "gap", "after", "comp", "top", F.filter("firsts", lambda s: s < F.col("sig")).alias("earlier"))
    x, y = told.where("comp != top").alias("x"), told.alias("y")
    once = (F.col("x.comp") < F.col("y.comp")) | (F.col("x.comp") > F.col("y.comp")) & (F.col("y.comp") == F.col("y.top"))
    near = once & _possible("x.", "y.", num, den) & ~_met_before("x.", "y.")
    across = x.join(y, (F.col("x.sig") == F.col("y.sig")) & near).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    across = materialize(across.join(stars, ["a", "b"], "left_anti"), "across")
    more = _verified(across, counts, known, k, num, den)
    nodes = components(first.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    discard(counted, keyed, copies, met, stars, links, settled, first, comp, across, more)
    return rows.join(nodes, rows.doc_id == nodes.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _first_signatures(held: DataFrame) -> DataFrame:
    """(doc_id, set, firsts): the FIRST smallest of each set's signatures, which Spark cuts before the shuffle too."""
    part = Window.partitionBy("doc_id", "set").orderBy("sig")
    ranked = held.select("doc_id", "set", "sig").withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= FIRST)
    return ranked.groupBy("doc_id", "set").agg(F.sort_array(F.collect_list("sig")).alias("firsts"))


def _met_before(x: str, y: str) -> Column:
    """Whether two rows of a signature share an earlier one; mostly their least ones are equal, which is quick to see."""
    least = F.coalesce(F.get(f"{x}earlier", F.lit(0)) == F.get(f"{y}earlier", F.lit(0)), F.lit(False))
    return least | F.arrays_overlap(f"{x}earlier", f"{y}earlier")


def _possible(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and the places of the shared token among the tokens that can be shared leave room for the similarity."""
    shared = F.least(F.col(f"{x}at"), F.col(f"{y}at")) + 1 + F.least(F.col(f"{x}gap"), F.col(f"{y}gap")) + F.least(F.col(f"{x}after"), F.col(f"{y}after"))
    return den * shared >= num * (F.col(f"{x}size") + F.col(f"{y}size") - shared)


def class_counts(tokens: np.ndarray) -> bytes:
    """A set's token counts over hash classes; sums of minima bound an intersection from above.

    Powers of two of classes, at least COUNTERS and about one for every three tokens, up to 64 times COUNTERS; one byte
    each, the last value of which may stand for more (which only loosens the bound of sets beyond it).
    """
    width = min(64 * COUNTERS, max(COUNTERS, 1 << max(0, len(tokens) // 3).bit_length()))
    return np.minimum(np.bincount((tokens >> U64(20)).astype(np.int64) & (width - 1), minlength=width), 255).astype(np.uint8).tobytes()


def _shared_at_most(x: bytes, y: bytes, size: int) -> int:
    """A bound on the intersection by class counts; the wider one is folded to the other's width."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if a.max(initial=0) == 255 or b.max(initial=0) == 255:
        return size
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        b = b.reshape(-1, len(a)).sum(0, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def _bounded(pairs: DataFrame, counts: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) whose class counts allow the similarity; a repeated id passes if any of its texts does."""
    both = pairs.join(counts.select(F.col("doc_id").alias("a"), F.col("counts").alias("x")), "a").join(counts.select(F.col("doc_id").alias("b"), F.col("counts").alias("y")), "b")

    def bound(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            n, m = sum(x), sum(y)
            shared = _shared_at_most(x, y, min(n, m))
            keep.append(255 in x or 255 in y or den * shared >= num * (n + m - shared))
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, bound, "a long, b long").distinct()


def _verified(pairs: DataFrame, counts: DataFrame, known: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) that are similar, written. A centre with very many partners is dealt over 64 parts by partner."""
    pairs = materialize(_bounded(pairs, counts, num, den).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int")), "pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = materialize(known.where(id_filter(ids, "doc_id")("doc_id")).join(ids.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    centres = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "_text")
    members = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "_text")
    # Parts of one centre lie side by side; its own texts (one, or several of a repeated id) come first.
    dealt = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            found = []
            for a, s, b, t in zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("b").to_pylist(), bytes_of(batch.column("_text"))):
                if key != (a, s):
                    key, own = (a, s), []
                tokens = token_set(t, k)
                if b is None:
                    own.append(tokens)
                    continue
                for centre in own:
                    x, y = len(centre), len(tokens)
                    if x and y and den * min(x, y) >= num * max(x, y):
                        both = np.concatenate([centre, tokens])
                        both.sort()
                        inter = int((both[1:] == both[:-1]).sum())
                        if den * inter >= num * (x + y - inter):
                            found.append((a, b))
                            break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    found = materialize(dealt.mapInArrow(compare, "a long, b long").distinct(), "verified")
    discard(pairs, ids, texts)
    release(pairs.sparkSession)
    return found
