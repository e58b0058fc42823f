"""Alignment of reads to splice graphs without gaps inside a node: seeds by an equi-join, extension in Arrow batches.

A seed is a stretch of a read that few places of the genes' sequences hold. Reads are many and their seeds short, so
seeds meet the index in a join by their bases; only reads with hits go on. Extension walks the graph from a hit in both
directions. Walking left is walking right in the mirrored gene, so there is one walk. The graphs travel to the workers
as one broadcast whose size is checked; a larger index has to be aligned to by parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.functions.sequence import reversed_record

_PAIR = str.maketrans("ACGT", "TGCA")
#: A boundary as the mirrored gene has it.
_MIRROR = {"SL": "RS", "RS": "SL", "SR": "LS", "LS": "SR", "LL": "RR", "RR": "LL", "LR": "LR"}


@dataclass(frozen=True)
class Settings:
    """How reads are aligned; the defaults are those of the quantification program."""

    mismatches: int = 3  # a walk ends beyond so many, weighed by quality
    kmer: int = 9  # matches that a splice must have on either side
    tries: int = 3  # seeds that are looked up for a read
    tolerance: int = 4  # places that a seed may have
    least_quality: int = 4  # a seed has only bases of better quality
    seed: int = 18
    buffer: int = 5  # bases at either end of a read that no seed touches
    step: int = 18  # from one seed to the next
    pair_range: int = 5000  # seeds of mates lie nearer than this
    score_range: float = 0.05  # alignments by so much worse than the best are kept
    score_least: float = 0.7
    stranded: bool = False
    mates_reversed: bool = True


@dataclass
class Node:
    """What a walk has seen of one node."""

    node: int
    matches: int = 0
    mismatches: int = 0
    doubt: float = 0.0  # mismatches weighed by the probability that the base is right

    @property
    def poor(self) -> bool:
        return self.mismatches >= self.matches or self.matches - self.mismatches <= 1


@dataclass
class Found:
    """An alignment: where it begins in the gene's sequence and in the read, from 1, and the nodes on the way."""

    gene: str
    path: list[Node]
    forward: bool
    valid: bool
    offset: int
    read_offset: int

    def score(self) -> float:
        return float(sum((np.float32(n.matches) - np.float32(n.doubt) for n in self.path), np.float32(0)))

    def identity(self, length: int) -> float:
        return float(np.float32(self.score() / length))

    @property
    def usable(self) -> bool:
        return self.valid and len(self.path) >= 1 and sum(n.matches for n in self.path) > sum(n.doubt for n in self.path)


class Strand:
    """A gene's graph in one direction. Nodes are numbered from 0, positions from 0; edge[i] stands before node i.

    reach[i, kmer]: nodes that may follow where the splice that leaves before node i is followed by these bases.
    """

    def __init__(self, seq: str, starts: list[int], lengths: list[int], edge: list[str], k: int) -> None:
        self.seq, self.starts, self.lengths, self.edge = seq, starts, lengths, edge
        self.after = [seq[s : s + k] if e in ("LR", "SR", "RR") and s + k <= len(seq) else None for s, e in zip(starts, edge)]
        self.before = [seq[s - k : s] if e in ("LR", "LS", "LL") and s >= k else None for s, e in zip(starts, edge)]
        self.landing: dict[str, list[int]] = {}
        for i, kmer in enumerate(self.after):
            if kmer is not None:
                self.landing.setdefault(kmer, []).append(i)

    def node_at(self, position: int) -> int:
        return int(np.searchsorted(self.starts, position, "right")) - 1


class Graphs:
    """All genes, each in both directions. genes: (gene, seq, lengths, edges), edges one more than nodes."""

    def __init__(self, genes: Iterable[tuple[str, str, list[int], list[str]]], k: int) -> None:
        self.both: dict[str, tuple[Strand, Strand]] = {}
        for gene, seq, lengths, edges in genes:
            starts = (np.cumsum([0, *lengths[:-1]])).tolist()
            back = lengths[::-1]
            mirrored = Strand(seq[::-1], (np.cumsum([0, *back[:-1]])).tolist(), back, [_MIRROR[e] for e in edges[::-1]], k)
            self.both[gene] = Strand(seq, starts, lengths, edges, k), mirrored


class Walk:
    """One read against one strand of a gene, from left to right. Both are given in the direction of the walk."""

    def __init__(self, strand: Strand, read: str, right: list[float], settings: Settings, backwards: bool) -> None:
        self.strand, self.read, self.right, self.settings, self.backwards = strand, read, right, settings, backwards

    def go(self, path: list[Node], node: int, at: int, place: int, valid: bool, ends: tuple[int, int]) -> tuple[list[Node], bool, tuple[int, int]]:
        """Extend the path, whose last node is ``node``, from position ``at`` with the read from ``place``.

        (path, valid, ends): ends are the furthest position and place that a walk backwards has reached.
        """
        s, k = self.strand, self.settings.kmer
        doubt = sum(n.doubt for n in path)
        passed: list[int] = []  # lengths of the path where a splice might have left instead
        while doubt <= self.settings.mismatches and place < len(self.read) and at < len(s.seq):
            if at == s.starts[node] + s.lengths[node]:
                following, kind = node + 1, s.edge[node + 1]
                room = len(self.read) - place >= k
                if kind == "LR" and s.lengths[following] >= k and room:
                    kmer = self.read[place : place + k]
                    if s.after[following] == kmer:
                        place, at, node, valid = place + k - 1, at + k - 1, following, True
                        path.append(Node(node, k - 1))
                    else:
                        path, valid, ends = self.splice(path, following, place, valid, ends)
                        break
                elif kind in ("LR", "LL"):
                    passed.append(len(path))
                    node = following
                    path.append(Node(node))
                elif kind == "LS":
                    if room:
                        path, valid, ends = self.splice(path, following, place, valid, ends)
                    break
                elif kind == "SR":
                    break
                else:
                    node = following
                    if node < len(s.lengths):
                        path.append(Node(node))
            if self.read[place] == s.seq[at]:
                path[-1].matches += 1
            else:
                path[-1].doubt += self.right[place]
                path[-1].mismatches += 1
                doubt += self.right[place]
            place, at = place + 1, at + 1
        reached, last = at, (at, place)
        for length in reversed(passed):  # the latest first: did the walk get far enough beyond this edge?
            if sum(n.matches for n in path[length:]) >= k + self.settings.mismatches:
                valid = True
                break
            following = path[length - 1].node + 1
            del path[length:]
            back = place - (at - s.starts[following])
            last = s.starts[following], back
            if back + k <= len(self.read):
                other, held, reach = self.splice(path, following, back, valid, ends)
                if len(other) > len(path) and _score(other) > _score(path):
                    path, valid, ends = other, held, reach
                elif len(other) <= len(path):
                    valid = valid or held and other is path
        if self.backwards:
            valid = valid or self.enough(path)
            ends = last[0] if reached > ends[0] else ends[0], max(ends[1], last[1])
        while path and path[-1].poor:
            gone = path.pop()
            if not path:
                valid = False
            elif self.backwards:
                ends = s.starts[path[-1].node] + s.lengths[path[-1].node], ends[1] - gone.matches - gone.mismatches
        if not self.backwards:
            valid = valid or self.enough(path)
        return path, valid, ends

    def enough(self, path: list[Node]) -> bool:
        return float(np.float32(_score(path) / len(self.read))) >= self.settings.score_least

    def splice(self, path: list[Node], edge: int, place: int, valid: bool, ends: tuple[int, int]) -> tuple[list[Node], bool, tuple[int, int]]:
        """The best way on by a splice that leaves before node ``edge``, or the path as it is."""
        s, k = self.strand, self.settings.kmer
        best, held, reach = path, valid, ends
        if s.before[edge] is not None:
            for node in s.landing.get(self.read[place : place + k], ()):
                copy = [replace(n) for n in path]
                found = self.go([*copy, Node(node)], node, s.starts[node], place, valid, ends)
                if _score(found[0]) > _score(best):
                    best, held, reach = found
        return best, held or _score(best) >= _score(path) + k, reach


def _score(path: list[Node]) -> float:
    return float(sum((np.float32(n.matches) - np.float32(n.doubt) for n in path), np.float32(0)))


def reverse_complement(seq: str) -> str:
    return seq.translate(_PAIR)[::-1]


def extend(graphs: Graphs, gene: str, at: int, read: str, quality: list[int], place: int, forward: bool, settings: Settings) -> Found:
    """The alignment through a seed that begins at position ``at`` of the gene and ``place`` of the read, from 1."""
    ahead, behind = graphs.both[gene]
    right = [float(np.float32(1 - 10 ** (-q / 10))) for q in quality]
    node = ahead.node_at(at)
    path, valid, _ = Walk(ahead, read, right, settings, False).go([Node(node)], node, at, place, False, (0, 0))
    n, m = len(ahead.lengths), len(ahead.seq)
    turned = [Node(n - 1 - x.node, x.matches, x.mismatches, x.doubt) for x in reversed(path)]
    if not turned or turned[-1].node != n - 1 - node:
        turned.append(Node(n - 1 - node))
    # The walk to the right began one base after the seed's first; that base is where the one to the left begins.
    path, valid, ends = Walk(behind, read[::-1], right[::-1], settings, True).go(turned, n - 1 - node, m - at, len(read) - place, valid, (m - at - 1 + 1, len(read) - place))
    path = [Node(n - 1 - x.node, x.matches, x.mismatches, x.doubt) for x in reversed(path)]
    return Found(gene, path, forward, valid, m - ends[0] + 1, len(read) - ends[1] + 1)


def seed_places(length: int, quality: list[int], settings: Settings, from_left: bool = True) -> list[int]:
    """Where a read's seeds begin, from 1, in the order in which they are tried."""
    at = settings.buffer if from_left else length - settings.seed - settings.buffer
    sign, out = 1 if from_left else -1, []
    while len(out) < settings.tries and settings.buffer <= at <= length - settings.seed - settings.buffer:
        if at >= 1 and min(quality[at - 1 : at - 1 + settings.seed]) > settings.least_quality:
            out.append(at)
            at += sign * settings.step
        else:
            at += sign
    return out


def seed_index(gene_seqs: DataFrame, settings: Settings) -> DataFrame:
    """(seed, hits): stretches of genes with all their places (gene, at from 1), if they are no more than the tolerance.

    gene_seqs: (gene, seq, at) of ``graph.gene_offsets``. No seed lies across two genes. Places are counted before they
    are listed, so a very common stretch gathers nothing.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gene, seq in zip(b.column("gene").to_pylist(), b.column("seq").to_pylist()):
                for lo in range(0, max(0, len(seq) - settings.seed + 1), 100_000):
                    places = range(lo, min(lo + 100_000, len(seq) - settings.seed + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([seq[i : i + settings.seed] for i in places]), pa.array([gene] * len(places)), pa.array([i + 1 for i in places], pa.int32())], ["seed", "gene", "at"])

    seeds = gene_seqs.select("gene", "seq").mapInArrow(cut, "seed string, gene string, at int")
    rare = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= settings.tolerance).select("seed")
    return seeds.join(rare, "seed").join(gene_seqs.select("gene", F.col("at").alias("base")), "gene").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct((F.col("base") + F.col("at")).alias("place"), "gene", "at"))).alias("hits"))


def _tries(reads: DataFrame, settings: Settings, variants: list[tuple[str, Column, Column, bool, bool]]) -> DataFrame:
    """(read_id, variant, try, place, seed, turned): seeds of each variant (name, seq, quality, from left, both strands)."""

    @F.arrow_udf("array<struct<try:int,place:int,seed:string,turned:boolean>>")
    def seeds(seq: pa.Array, quality: pa.Array, from_left: pa.Array, both: pa.Array) -> pa.Array:
        out = []
        for s, q, left, two in zip(seq.to_pylist(), quality.to_pylist(), from_left.to_pylist(), both.to_pylist()):
            own = []
            for i, at in enumerate(seed_places(len(s), q, settings, left)):
                piece = s[at - 1 : at - 1 + settings.seed]
                own.append({"try": 2 * i, "place": at, "seed": piece, "turned": False})
                if two:
                    own.append({"try": 2 * i + 1, "place": len(s) - (at + settings.seed - 1) + 1, "seed": reverse_complement(piece), "turned": True})
            out.append(own)
        return pa.array(out, pa.list_(pa.struct([("try", pa.int32()), ("place", pa.int32()), ("seed", pa.string()), ("turned", pa.bool_())])))

    parts = [reads.select("read_id", F.lit(name).alias("variant"), F.explode(seeds(seq, quality, F.lit(left), F.lit(both))).alias("s")) for name, seq, quality, left, both in variants]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("read_id", "variant", "s.*")


def located(tries: DataFrame, index: DataFrame) -> DataFrame:
    """(read_id, variant, place, turned, hits) by the first seed of each variant that the index has."""
    hit = tries.join(index, "seed").groupBy("read_id", "variant").agg(F.min_by(F.struct("place", "turned", "hits"), "try").alias("s"))
    return hit.select("read_id", "variant", "s.*")


ALIGNMENT = "struct<gene:string,offset:int,read_offset:int,forward:boolean,path:array<struct<node:int,matches:int,mismatches:int,doubt:double>>>"


def _row(found: Found) -> dict:
    return {"gene": found.gene, "offset": found.offset, "read_offset": found.read_offset, "forward": found.forward, "path": [{"node": n.node + 1, "matches": n.matches, "mismatches": n.mismatches, "doubt": float(n.doubt)} for n in found.path]}


def broadcast_graphs(nodes: DataFrame, gene_seqs: DataFrame, settings: Settings, most_bases: int = 1 << 28):
    """The graphs of all genes for the workers; refused if their sequences have more than ``most_bases``."""
    total = gene_seqs.agg(F.sum(F.length("seq"))).first()[0] or 0
    if total > most_bases:
        raise ValueError(f"{total} bases are more than the {most_bases} that are broadcast; align to genes in parts")
    edges = nodes.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("node", "length", "edge_in", "edge_out"))).alias("n"))
    rows = edges.join(gene_seqs.select("gene", "seq"), "gene").collect()
    genes = [(r["gene"], r["seq"], [n["length"] for n in r["n"]], [*(n["edge_in"] for n in r["n"]), r["n"][-1]["edge_out"]]) for r in rows]
    return nodes.sparkSession.sparkContext.broadcast(Graphs(genes, settings.kmer))


def _best(found: list[tuple[float, tuple]], settings: Settings) -> list[tuple]:
    """Those within the score range of the best one."""
    top = max((s for s, _ in found), default=0.0)
    return [x for s, x in found if np.float32(top) - np.float32(s) <= settings.score_range]


def align(reads: DataFrame, index: DataFrame, graphs, settings: Settings = Settings()) -> DataFrame:
    """(read_id, length, alignments) of the reads that align; reads: read_id (unique), seq, quality (array of int).

    graphs: a broadcast of ``broadcast_graphs``; index: the result of ``seed_index``.
    """
    tries = _tries(reads, settings, [("", F.col("seq"), F.col("quality"), True, not settings.stranded)])
    met = reads.select("read_id", "seq", F.col("quality").cast("array<int>").alias("quality")).join(located(tries, index), "read_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                seq, quality = (reverse_complement(r["seq"]), r["quality"][::-1]) if r["turned"] else (r["seq"], r["quality"])
                found = [extend(graphs.value, h["gene"], h["at"], seq, quality, r["place"], not r["turned"], settings) for h in r["hits"]]
                kept = _best([(f.identity(len(seq)), f) for f in found if f.usable], settings)
                if kept:
                    rows.append({"read_id": r["read_id"], "length": len(seq), "alignments": [_row(f) for f in kept]})
            yield _batch(rows, ["alignments"])

    kind = reads.schema["read_id"].dataType.simpleString()
    return met.mapInArrow(run, f"read_id {kind}, length int, alignments array<{ALIGNMENT}>")


def align_pairs(pairs: DataFrame, index: DataFrame, graphs, settings: Settings = Settings()) -> DataFrame:
    """(read_id, length, first, second): alignments of both mates, element by element of one gene and near each other.

    pairs: read_id, seq, quality, mate_seq, mate_quality. The second mate is searched on the strand that the first one's
    seed tells. Hits of both are paired in the order of their places.
    """
    quality, mate = F.col("quality"), F.col("mate_quality")
    turned_mate, turned_quality = reversed_record(F.col("mate_seq"), mate)
    # With mates reversed, the second is turned where the first is not; a turned read is searched from its right end.
    variants = [("first", F.col("seq"), quality, True, not settings.stranded), ("straight", F.col("mate_seq"), mate, True, False), ("turned", turned_mate, turned_quality, False, False)]
    hits = located(_tries(pairs, settings, variants), index)
    first = hits.where("variant = 'first'").select("read_id", F.col("place").alias("place1"), F.col("turned").alias("turned1"), F.col("hits").alias("hits1"))
    wanted = F.when(F.lit(settings.mates_reversed) != F.col("turned1"), "turned").otherwise("straight")
    both = first.join(hits.where("variant != 'first'"), "read_id").where(F.col("variant") == wanted)
    met = pairs.select("read_id", "seq", quality.cast("array<int>").alias("quality"), "mate_seq", mate.cast("array<int>").alias("mate_quality")).join(both, "read_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turn = lambda s, q, yes: (reverse_complement(s), q[::-1]) if yes else (s, q)
                one, q1 = turn(r["seq"], r["quality"], r["turned1"])
                two, q2 = turn(r["mate_seq"], r["mate_quality"], r["variant"] == "turned")
                found, i, j = [], 0, 0
                while i < len(r["hits1"]) and j < len(r["hits"]):
                    x, y = r["hits1"][i], r["hits"][j]
                    if abs(x["place"] - y["place"]) < settings.pair_range and x["gene"] == y["gene"]:
                        f = extend(graphs.value, x["gene"], x["at"], one, q1, r["place1"], not r["turned1"], settings)
                        g = extend(graphs.value, y["gene"], y["at"], two, q2, r["place"], r["turned1"], settings)
                        if f.usable and g.usable:
                            found.append(((f.score() + g.score()) / (len(one) + len(two)), (f, g)))
                        i, j = i + 1, j + 1
                    elif x["place"] > y["place"]:
                        j += 1
                    else:
                        i += 1
                kept = _best(found, settings)
                if kept:
                    rows.append({"read_id": r["read_id"], "length": len(one), "first": [_row(f) for f, _ in kept], "second": [_row(g) for _, g in kept]})
            yield _batch(rows, ["first", "second"])

    kind = pairs.schema["read_id"].dataType.simpleString()
    return met.mapInArrow(run, f"read_id {kind}, length int, first array<{ALIGNMENT}>, second array<{ALIGNMENT}>")


def _batch(rows: list[dict], columns: list[str]) -> pa.RecordBatch:
    path = pa.list_(pa.struct([("node", pa.int32()), ("matches", pa.int32()), ("mismatches", pa.int32()), ("doubt", pa.float64())]))
    one = pa.list_(pa.struct([("gene", pa.string()), ("offset", pa.int32()), ("read_offset", pa.int32()), ("forward", pa.bool_()), ("path", path)]))
    ids = pa.array([r["read_id"] for r in rows])
    return pa.RecordBatch.from_arrays([ids, pa.array([r["length"] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], one) for c in columns)], ["read_id", "length", *columns])


def score(path: Column) -> Column:
    """Matches less weighed mismatches of a path."""
    return F.aggregate(path, F.lit(0.0), lambda a, n: a + n["matches"] - n["doubt"])


def best_alignment(alignments: Column) -> Column:
    """The first of those with the highest score."""
    scored = F.transform(alignments, lambda a, i: F.struct(score(a["path"]).alias("score"), (-i).alias("place"), a.alias("alignment")))
    return F.array_max(scored)["alignment"]


def mean_read_length(aligned: DataFrame) -> DataFrame:
    """One row: reads that align and their mean length, cut to a whole number."""
    return aligned.agg(F.count(F.lit(1)).alias("mapped"), F.floor(F.avg("length")).alias("read_length"))
