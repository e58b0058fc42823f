"""Inclusion of nodes: splicing events solved over the paths around a node, ends of transcripts, and circles.

An event looks at its gene's nodes and counted edges, which the annotation bounds, so genes are solved one by one in
Arrow batches. Paths of a graph of edges are grown from its sources, all at once, to its sinks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.functions.beta import interval
from lariat.functions.sequence import MOTIFS, significant

Edge = tuple[int, int]
Path = tuple[int, ...]

OBLIGATE, ALTERNATIVE_SITES = ("TS", "TE"), ("AD", "AA")


def motif_of(left: str, right: str) -> str:
    return next((name for name, (a, b) in MOTIFS.items() if left in a and right in b), "NA")


def maximal_paths(edges: list[Edge], most: int = 1024) -> list[Path]:
    """All paths along the edges that can't be made longer at either end, sorted.

    Where more than ``most`` are under way at once, those of the least hashes go on, the same ones each time.
    """
    onward: dict[int, list[int]] = {}
    for a, b in sorted(set(edges)):
        onward.setdefault(a, []).append(b)
    targets = {b for _, b in edges}
    growing, done = [(a,) for a in sorted(onward) if a not in targets], []
    while growing:
        longer = []
        for p in growing:
            if p[-1] in onward:
                longer += [(*p, b) for b in onward[p[-1]]]
            else:
                done.append(p)
        growing = longer if len(longer) <= most else sorted(longer, key=lambda p: hashlib.blake2b(repr(p).encode()).digest())[:most]
    return sorted(done if len(done) <= most else sorted(done, key=lambda p: hashlib.blake2b(repr(p).encode()).digest())[:most])


def _steps(path: Path) -> set[Edge]:
    return set(zip(path, path[1:]))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To significant digits, half to even."""
    with np.errstate(all="ignore"):
        scale = 10.0 ** (digits - 1 - np.floor(np.log10(np.abs(np.where(x == 0, 1.0, x)))))
    return np.where(x == 0, 0.0, np.round(x * scale) / scale)


def shares(counts: np.ndarray, lengths: np.ndarray, ambiguous: dict[tuple[int, ...], float], digits: int = 4, most: int = 1500, start: bool = True) -> np.ndarray:
    """Shares of paths by expectation and maximization; NaN where nothing is counted.

    counts: reads of one path alone; lengths: what they are divided by; ambiguous: reads of several paths, dealt evenly at
    first and then by the shares so far. The rounds end when no share, rounded, changes.
    """

    def of(c: np.ndarray, d: int) -> np.ndarray:
        with np.errstate(all="ignore"):
            rate = c / lengths
            out = rate / rate.sum()
        return _rounded(out, d) if d else out

    now = of(counts, 0) if start else np.zeros(len(counts))
    for turn in range(most):
        total = counts.astype(float).copy()
        for paths, n in ambiguous.items():
            at = list(paths)
            weight = np.ones(len(at)) if turn == 0 else now[at]
            if weight.sum() > 0:
                total[at] += n * weight / weight.sum()
        before, now = now, of(total, digits)
        if np.array_equal(now, before) or np.isnan(now).any():
            break
    return now


@dataclass
class Event:
    """Inclusion of a node (psi None if it can't be told) and what it was found from."""

    psi: float | None
    total: float
    inclusion: list[tuple[Path, float]] = field(default_factory=list)
    exclusion: list[tuple[Path, float]] = field(default_factory=list)
    solved: bool = False  # by paths on both sides

    @property
    def paths(self) -> int:
        return len(self.inclusion) + len(self.exclusion)


def spliced(node: int, motif: str, edges: dict[Edge, float], least: float = 0.02) -> Event:
    """A node's inclusion by the edges that end or begin there against those that pass over it.

    Edges of less than ``least`` of the gene's largest count don't found an event. If both kinds are there, edges further
    out that join what they reach come along, the paths of both sides are enumerated, and reads of edges that several
    paths have are dealt by expectation and maximization.
    """
    top = max(edges.values(), default=0.0)
    near = {e: n for e, n in edges.items() if e[0] <= node <= e[1] and top > 0 and n / top >= least}
    touching, passing = [e for e in near if node in e], [e for e in near if node not in e]
    inside, over = sum(near[e] for e in touching), sum(near[e] for e in passing)
    if not touching or not passing:
        found = [(p, 1.0) for p in maximal_paths(touching or passing)]
        if touching:
            psi = 1.0 if inside >= 2 or inside >= 1 and motif in ALTERNATIVE_SITES else None
            return Event(psi, inside, found, [])
        return Event(0.0 if over >= 1 else None, over, [], found)
    sides = [set(touching), set(passing)]
    low, high = (f(x for e in near for x in e) for f in (min, max))
    used = dict(near)
    # Leftwards from the node, then rightwards: an edge comes along on the sides whose nodes it joins.
    for end, turn in ((1, range(node - 1, low, -1)), (0, range(node + 1, high))):
        for at in turn:
            for e in sorted(e for e in edges if e[end] == at and low <= e[0] and e[1] <= high):
                joined = [s for s in sides if any(at in x for x in s)]
                for s in joined:
                    s.add(e)
                if joined:
                    used[e] = edges[e]
    inclusion, exclusion = (maximal_paths(sorted(s)) for s in sides)
    held = [_steps(p) for p in (*inclusion, *exclusion)]
    counts, lengths, ambiguous = np.zeros(len(held)), np.zeros(len(held)), {}
    for e, n in used.items():
        at = [i for i, s in enumerate(held) if e in s]
        lengths[at] += 1
        if len(at) == 1:
            counts[at[0]] += n
        elif len(at) > 1 and n > 0:
            ambiguous[tuple(at)] = ambiguous.get(tuple(at), 0.0) + n
    psi = shares(counts, lengths, ambiguous)
    share = float(psi[: len(inclusion)].sum())
    pairs = [(p, float(x)) for p, x in zip((*inclusion, *exclusion), psi)]
    return Event(None if np.isnan(share) else share, inside + over, pairs[: len(inclusion)], pairs[len(inclusion) :], True)


def tandem(first: int, motifs: list[str], nodes: dict[int, float], edges: dict[Edge, float], lengths: dict[int, float], read_length: int, parity: bool = False) -> tuple[list[int], list[tuple[int, Path, float]], float]:
    """(nodes, (node, path, share) of each, reads) of a run of equal motifs TS or TE that begins at node ``first``.

    The run's paths hold ever more nodes from its inner end outwards, so a path's share is that of the node it adds.
    motifs: those of the gene's nodes, from node 1. parity: shares stand at the run's nodes in order of path, which for
    TS is from the other end. Without more than two reads there are no shares.
    """
    motif, last = motifs[first - 1], first
    while last < len(motifs) and motifs[last] == motif:
        last += 1
    used = list(range(first - 1, last + 1)) if motif == "TE" else list(range(first, last + 2))
    used = [n for n in used if 1 <= n <= len(motifs)]
    seen = sum(nodes.get(n, 0.0) for n in used) + sum(edges.get((n - 1, n), 0.0) for n in (range(first, last + 1) if motif == "TE" else range(first, last + 2)))
    outwards = used if motif == "TE" else used[::-1]
    paths = [tuple(sorted(outwards[: i + 1])) for i in range(len(outwards))]
    if seen <= 2:
        return used, [], 0.0
    counts, size, ambiguous = np.zeros(len(paths)), np.zeros(len(paths)), {}

    def deal(at: list[int], n: float) -> None:
        if len(at) == 1:
            counts[at[0]] += n
        elif at and n > 0:
            ambiguous[tuple(at)] = ambiguous.get(tuple(at), 0.0) + n

    for n in used:
        at = [i for i, p in enumerate(paths) if n in p]
        size[at] += lengths[n]
        deal(at, nodes.get(n, 0.0))
    for e, n in edges.items():
        deal([i for i, p in enumerate(paths) if e in _steps(p)], n)
    psi = shares(counts, np.maximum(size - read_length, 1), ambiguous, start=False)
    if np.isnan(psi).any():
        return used, [], 0.0
    places = used if parity else outwards
    return used, sorted((n, p, float(x)) for n, p, x in zip(places, paths, psi)), float(counts.sum() + sum(ambiguous.values()))


def _entropy(psi: list[float]) -> float:
    p = np.array([x or np.finfo(float).eps for x in psi])
    return float(-(p * np.log2(p)).sum())


_PATHS = "array<struct<path:array<int>,psi:double>>"
SCHEMA = f"gene {{}}, node int, until int, motif string, psi double, total double, complexity int, entropy double, inclusion {_PATHS}, exclusion {_PATHS}, edges array<struct<l:int,r:int,n:double>>"


def solve(gene, motifs: list[str], nodes: dict[int, float], edges: dict[Edge, float], lengths: dict[int, float], read_length: int, circles: dict[Edge, float] | None = None, parity: bool = False) -> list[dict]:
    """Rows of one gene's nodes in order; psi is null where nothing can be said."""
    rows: list[dict] = []

    def row(node: int, motif: str, **known) -> None:
        rows.append({"gene": gene, "node": node, "until": None, "motif": motif, "psi": None, "total": None, "complexity": None, "entropy": None, "inclusion": None, "exclusion": None, "edges": None} | known)

    listed = lambda pairs: [{"path": list(p), "psi": x} for p, x in pairs] or None
    node = 1
    while node <= len(motifs) and len(motifs) > 1:
        motif = motifs[node - 1]
        if motif in OBLIGATE:
            used, found, total = tandem(node, motifs, nodes, edges, lengths, read_length, parity)
            known = {n: (p, x) for n, p, x in found}
            for n in used:
                if n in known:
                    p, x = known[n]
                    row(n, motif, psi=round(x, 4), total=total, complexity=int(np.ceil(np.log2(len(found)))), entropy=round(_entropy([y for *_, y in found]), 4), inclusion=listed([(p, x)]))
                else:
                    row(n, motif)
            node = used[-1] + 1
            continue
        if motif == "NA":
            if not (node < len(motifs) and motifs[node] in OBLIGATE):
                row(node, motif)
        else:
            e = spliced(node, motif, edges)
            if e.psi is not None and 0 <= e.psi <= 1 and e.total > 0:
                reach = [x for p, _ in (*e.inclusion, *e.exclusion) for x in p]
                near = [{"l": a, "r": b, "n": n} for (a, b), n in sorted(edges.items()) if min(reach) <= a and b <= max(reach)]
                row(node, motif, psi=e.psi, total=e.total, complexity=int(np.ceil(np.log2(e.paths))) if e.solved else 0, entropy=round(_entropy([x for _, x in (*e.inclusion, *e.exclusion)]), 4) if e.solved else 0.0, inclusion=listed(e.inclusion), exclusion=listed(e.exclusion), edges=near)
            else:
                row(node, motif)
        node += 1
    for (a, b), n in sorted((circles or {}).items()):
        total = n + sum(k for e, k in edges.items() if e[0] == a)
        if total > 0:
            row(a, "BS", until=b, psi=n / total, total=total)
    return rows


def inclusion(nodes: DataFrame, counts: DataFrame, read_length: int = 50, circles: bool = False, parity: bool = False) -> DataFrame:
    """(gene, node, until, motif, psi, lo, hi, total, complexity, entropy, inclusion, exclusion, edges) of all genes' nodes.

    nodes: the graph, with edge_in and edge_out; counts: of ``quant``, long paths decomposed. Nodes of no length have no
    row. Genes are grouped by rows that the graph bounds: a node, an edge or a circle each.
    """
    kind = nodes.schema["gene"].dataType.simpleString()
    graph = nodes.select("gene", F.lit("graph").alias("kind"), F.col("node").alias("l"), F.col("node").alias("r"), F.col("length").cast("double").alias("n"), "edge_in", "edge_out")
    seen = counts.where("kind in ('node', 'edge', 'circ')").select("gene", "kind", F.col("path")[0].alias("l"), F.element_at("path", -1).alias("r"), "n", F.lit(None).cast("string").alias("edge_in"), F.lit(None).cast("string").alias("edge_out"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == "graph"].sort_values("l")
        motifs = [motif_of(a, b) for a, b in zip(own["edge_in"], own["edge_out"])]
        pick = lambda k: {(int(a), int(b)): float(n) for a, b, n in pdf[pdf["kind"] == k][["l", "r", "n"]].itertuples(index=False)}
        at = {a: n for (a, _), n in pick("node").items()}
        lengths = {int(a): float(n) for a, n in zip(own["l"], own["n"])}
        rows = solve(pdf["gene"].iloc[0], motifs, at, pick("edge"), lengths, read_length, pick("circ") if circles else None, parity) if len(own) else []
        rows = [r for r in rows if lengths[r["node"]] > 0]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(object).where(lambda d: d.notna(), None)

    rows = graph.unionByName(seen).groupBy("gene").applyInPandas(one, SCHEMA.format(kind))
    ci = interval()("psi", F.when(F.col("psi").isNotNull(), F.col("total")))
    psi = F.when(F.col("motif").isin(*OBLIGATE, "BS"), F.col("psi")).otherwise(significant(F.col("psi"), 3))
    rows = rows.withColumn("ci", ci)
    return rows.select("gene", "node", "until", "motif", psi.alias("psi"), significant(F.col("ci.lo"), 3).alias("lo"), significant(F.col("ci.hi"), 3).alias("hi"), "total", "complexity", "entropy", "inclusion", "exclusion", "edges")


def truth(nodes: DataFrame, annotated: DataFrame, tpm: DataFrame) -> DataFrame:
    """(gene, node, psi) of inner spliced nodes by the abundance of transcripts that have them, of those that reach across.

    A node counts if its edges are those of splice sites and, going outwards, a site to splice from stands before it and
    one to splice to behind, before any end of a transcript.
    """
    listed = nodes.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("node", "edge_in", "edge_out"))).alias("n")).withColumn("edges", F.concat(F.transform("n", lambda x: x["edge_in"]), F.array(F.element_at("n", -1)["edge_out"])))
    each = listed.select("gene", "edges", F.explode("n").alias("x")).select("gene", "edges", "x.node", "x.edge_in", "x.edge_out")
    is_in = lambda kinds: lambda e: e.isin(*kinds)

    def first(part: Column, kinds: list[str]) -> Column:
        return F.array_position(F.transform(part, is_in(kinds)), True)

    up, down = F.reverse(F.slice("edges", 1, F.col("node"))), F.slice("edges", F.col("node") + 1, F.size("edges"))
    reaches = lambda part, good, bad: (first(part, good) > 0) & ((first(part, bad) == 0) | (first(part, good) < first(part, bad)))
    inner = F.col("edge_in").isin("RR", "LR", "LL") & F.col("edge_out").isin("LL", "LR", "RR") & reaches(up, ["RR", "LR", "SR"], ["LS", "SL", "RS"]) & reaches(down, ["LL", "LR", "LS"], ["SR", "RS", "SL"])
    inner = each.where(inner).select("gene", "node")
    whole = annotated.join(tpm.select("gene", "transcript", "tpm"), ["gene", "transcript"], "left").withColumn("tpm", F.coalesce("tpm", F.lit(0.0)))
    over = whole.select("gene", "tpm", F.col("nodes").cast("array<int>").alias("nodes")).withColumn("node", F.explode(F.sequence(F.array_min("nodes"), F.array_max("nodes"))))
    c = over.groupBy("gene", "node").agg(F.sum(F.when(F.array_contains("nodes", F.col("node")), F.col("tpm")).otherwise(0.0)).alias("have"), F.sum("tpm").alias("all"))
    return inner.join(c, ["gene", "node"]).where(F.col("all") > 0).select("gene", "node", (F.col("have") / F.col("all")).alias("psi"))
