"""Embedding near-duplicates by cover trees and dual traversal: exact pairs over a cosine threshold.

On unit vectors, cosine >= c is distance <= sqrt(2 - 2c). A cover tree nests nets of halving radii; two nodes are
compared by their centres, and the triangle inequality with both covering radii either prunes the pair, or accepts all
pairs below it at once, or leaves it to their children; the vectors of two small balls are compared by their cosine.

The tree is built from the top down. Over the cluster, a node of more than ``part`` vectors is divided in rounds, its
vectors going to the nearest of FAN centres far from each other. A node that gets no smaller that way, as it is a ball
of near copies, is dealt into pieces with its centre and radius. Pairs of nodes are pruned level by level. The rest of a
node's tree is built once, in one task, which also traverses it against itself; it then travels with the node's vectors
to the tasks of the pairs of nodes that are left. A task returns counts and a spanning forest of its links, not the
links: at most one row per vector and edge of a forest, however dense a group is. Equal vectors are one class from the
start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import configure, discard, materialize, numbered, whole_ids
from lariat.llm.components import components

#: Distances come from products of unit vectors, so one of zero may come out as some 1e-8.
_EPS = 1e-7
#: How far a product in blocks may be from one by itself; nearer to the threshold a pair is multiplied by itself.
_NEAR = 1e-12
_PAIRS = 100_000
#: Distances held at once.
_BLOCK = 1 << 21
#: The most children of a node that is divided over the cluster, two for each ``part`` of its vectors up to that, and how
#: many of its vectors they are chosen from, on average.
FAN, SAMPLE = 16, 512
#: Rounds of division; what is still larger after them is dealt into pieces.
ROUNDS = 24


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between the rows of two arrays of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, or to one vector."""
    return np.sqrt(((x - y) ** 2).sum(-1))


def _net(x: np.ndarray, rows: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, float]]:
    """(centre, rows, covering radius) of a greedy net: centres lie further apart than the radius; rows[0] is one."""
    groups = []
    while len(rows):
        head = x[rows[:256]]
        near, taken, chosen = _distances(head, head) <= radius, np.zeros(len(head), bool), []
        for i in range(len(head)):
            if not taken[i]:
                chosen.append(i)
                taken |= near[i]
        d = _distances(x[rows[chosen]], x[rows])
        d[np.arange(len(chosen)), chosen] = 0
        which, least = d.argmin(0), d.min(0)
        in_reach = least <= radius
        order = np.argsort(which[in_reach], kind="stable")
        own, far = rows[in_reach][order], least[in_reach][order]
        ends = np.cumsum(np.bincount(which[in_reach], minlength=len(chosen)))
        for c, first, last in zip(chosen, np.append(0, ends[:-1]), ends):
            groups.append((int(rows[c]), own[first:last], float(far[first:last].max())))
        rows = rows[~in_reach]
    return groups


class CoverTree:
    """Nodes over the rows of x, unit vectors; node 0 is the root, and a node's children stand side by side.

    centre: a row; cover: the largest distance from the centre to a row below; first, last: the node's rows in ``order``;
    child, children: its first child and how many, 0 of them for a leaf, whose cover is at most ``leaf``.
    """

    _PARTS = ("order", "centre", "cover", "first", "last", "child", "children")

    def __init__(self, x: np.ndarray, leaf: float) -> None:
        self.x = x
        order = np.arange(len(x))
        d = _distances(x[:1], x)[0] if len(x) else np.zeros(0)
        centre, cover, first, last, child, children = [0], [float(d.max(initial=0))], [0], [len(x)], [0], [0]
        level = [(0, cover[0] / 2)]
        while level:
            following = []
            for node, radius in level:
                if cover[node] <= leaf:
                    continue
                rows = order[first[node] : last[node]]
                rows = np.concatenate([[centre[node]], rows[rows != centre[node]]])
                groups = _net(x, rows, radius)
                while len(groups) == 1:
                    radius /= 2
                    groups = _net(x, rows, radius)
                child[node], children[node] = len(centre), len(groups)
                at = first[node]
                for middle, own, far in groups:
                    order[at : at + len(own)] = own
                    following.append((len(centre), radius / 2))
                    for column, value in zip((centre, cover, first, last, child, children), (middle, far, at, at + len(own), 0, 0)):
                        column.append(value)
                    at += len(own)
            level = following
        self.order, self.cover = order, np.array(cover)
        self.centre, self.first, self.last, self.child, self.children = (np.array(v, np.int64) for v in (centre, first, last, child, children))

    def to_bytes(self) -> bytes:
        """All but the vectors."""
        parts = [np.asarray(getattr(self, p)) for p in self._PARTS]
        return np.array([len(parts[0]), len(parts[1])], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, x: np.ndarray, raw: bytes) -> "CoverTree":
        """The tree of the same vectors in the same order."""
        tree = cls.__new__(cls)
        tree.x = x
        rows, nodes = np.frombuffer(raw, np.int64, 2)
        at = 16
        for p in cls._PARTS:
            n = rows if p == "order" else nodes
            setattr(tree, p, np.frombuffer(raw, np.float64 if p == "cover" else np.int64, n, at))
            at += 8 * n
        return tree


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): all values first[i] .. first[i] + n[i] - 1 with their i."""
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


class _Links:
    """What a traversal finds: weights of partners by row, and edges that connect what is linked."""

    def __init__(self, a: CoverTree, b: CoverTree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> None:
        self.a, self.b, self.same, self.cosine = a, b, a is b, cosine
        self.weights = weight_a, weight_b
        self.sums = [np.concatenate([[0], np.cumsum(w[t.order])]) for w, t in ((weight_a, a), (weight_b, b))]
        self.runs = [np.zeros(len(a.x) + 1, np.int64), np.zeros(len(b.x) + 1, np.int64)]
        self.exact = [np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.edges.append((i, j))
        if len(self.edges) > 64:
            self.edges = [_forest(self.edges, len(self.a.x), len(self.b.x), self.same)]

    def whole(self, u: np.ndarray, v: np.ndarray) -> None:
        """All rows of nodes u are linked with all of nodes v; within a node, if u is v."""
        a, b = self.a, self.b
        own = (u == v) & self.same
        for t, o, side, other in ((a, u, 0, self.sums[1][b.last[v]] - self.sums[1][b.first[v]]), (b, v, 1, np.where(own, 0, self.sums[0][a.last[u]] - self.sums[0][a.first[u]]))):
            np.add.at(self.runs[side], t.first[o], other)
            np.add.at(self.runs[side], t.last[o], -other)
        one, row = _spread(a.first[u[own]], a.last[u[own]] - a.first[u[own]])
        np.subtract.at(self.exact[0], a.order[row], self.weights[0][a.order[row]])
        one, row = _spread(a.first[u], a.last[u] - a.first[u])
        self.join(a.order[row], b.centre[v][one])
        u, v = u[~own], v[~own]
        one, row = _spread(b.first[v], b.last[v] - b.first[v])
        self.join(a.centre[u][one], b.order[row])

    def compare(self, u: np.ndarray, v: np.ndarray) -> None:
        """Rows of leaves u against those of leaves v, each by its cosine."""
        a, b = self.a, self.b
        n, m = a.last[u] - a.first[u], b.last[v] - b.first[v]
        large = n * m >= 1024
        for p, q in zip(u[large], v[large]):
            self._block(a.order[a.first[p] : a.last[p]], b.order[b.first[q] : b.last[q]], bool(self.same and p == q))
        u, v, n, m = u[~large], v[~large], n[~large], m[~large]
        for lo in range(0, len(u), 2000):
            part = slice(lo, lo + 2000)
            one, k = _spread(np.zeros(len(n[part]), np.int64), n[part] * m[part])
            i, j = a.order[a.first[u[part]][one] + k // m[part][one]], b.order[b.first[v[part]][one] + k % m[part][one]]
            if self.same:
                inside = u[part][one] == v[part][one]
                i, j = i[~inside | (i < j)], j[~inside | (i < j)]
            for at in range(0, len(i), _PAIRS):
                x, y = i[at : at + _PAIRS], j[at : at + _PAIRS]
                hit = (a.x[x] * b.x[y]).sum(1) >= self.cosine
                x, y = x[hit], y[hit]
                np.add.at(self.exact[0], x, self.weights[1][y])
                np.add.at(self.exact[1], y, self.weights[0][x])
                self.join(x, y)

    def _block(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        step = max(1, _BLOCK // len(j))
        for at in range(0, len(i), step):
            rows = i[at : at + step]
            g = self.a.x[rows] @ self.b.x[j].T
            hit = g >= self.cosine
            x, y = np.nonzero(np.abs(g - self.cosine) < _NEAR)
            hit[x, y] = (self.a.x[rows[x]] * self.b.x[j[y]]).sum(1) >= self.cosine
            if own:
                hit[np.arange(len(rows)), at + np.arange(len(rows))] = False
            self.exact[0][rows] += hit @ self.weights[1][j]
            if not own:  # a tree with itself: both sides of a pair of rows are in the block
                self.exact[1][j] += self.weights[0][rows] @ hit
            x, y = _spanning(hit)
            self.join(rows[x], j[y])


def dual_links(a: CoverTree, b: CoverTree, cosine: float, weight_a: np.ndarray, weight_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows of two trees, or within one if both are the same.

    (links of each row of a, of each row of b, and edges (i, j) that connect what is linked): links count the
    partners' weights; a row is no partner of itself. Rows of b have j in its own numbers. Within one tree, the links of
    a row are the sum of both columns.
    """
    same, theta = a is b, np.sqrt(2 - 2 * cosine)
    found = _Links(a, b, cosine, weight_a, weight_b)
    todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(a.x) and len(b.x) else []

    def visit(p: np.ndarray, q: np.ndarray, d: np.ndarray) -> None:
        if same:  # a row alone is no pair
            several = (p != q) | (a.last[p] - a.first[p] > 1)
            p, q, d = p[several], q[several], d[several]
        both = a.cover[p] + b.cover[q]
        whole = d + both <= theta - _EPS
        found.whole(p[whole], q[whole])
        p, q = p[~whole], q[~whole]
        leaf = (a.children[p] == 0) & (b.children[q] == 0)
        found.compare(p[leaf], q[leaf])
        p, q = p[~leaf], q[~leaf]
        todo.extend((p[at : at + _PAIRS], q[at : at + _PAIRS]) for at in range(0, len(p), _PAIRS))

    if todo:
        p, q = todo.pop()
        d = _distance(a.x[a.centre[p]], b.x[b.centre[q]])
        near = d - a.cover[p] - b.cover[q] <= theta + _EPS
        visit(p[near], q[near], d[near])
    while todo:
        p, q = todo.pop()
        # Both nodes open; a leaf stands for itself.
        fp, fq = (np.where(t.children[o] > 0, t.child[o], o) for t, o in ((a, p), (b, q)))
        kp, kq = (np.maximum(t.children[o], 1) for t, o in ((a, p), (b, q)))
        large = kp * kq >= 1024
        for s, t, k, m, own in zip(fp[large], fq[large], kp[large], kq[large], ((p == q) & same)[large]):
            step = max(1, _BLOCK // m)
            for at in range(s, s + k, step):
                to = min(at + step, s + k)
                d = _distances(a.x[a.centre[at:to]], b.x[b.centre[t : t + m]])
                near = d - a.cover[at:to, None] - b.cover[None, t : t + m] <= theta + _EPS
                if own:
                    near &= np.arange(at, to)[:, None] <= np.arange(t, t + m)[None]
                x, y = np.nonzero(near)
                visit(x + at, y + t, d[x, y])
        p, q, fp, fq, kp, kq = (v[~large] for v in (p, q, fp, fq, kp, kq))
        if len(p):
            one, k = _spread(np.zeros(len(p), np.int64), kp * kq)
            s, t = fp[one] + k // kq[one], fq[one] + k % kq[one]
            if same:
                keep = (p[one] != q[one]) | (s <= t)
                s, t = s[keep], t[keep]
            d = _distance(a.x[a.centre[s]], b.x[b.centre[t]])
            near = d - a.cover[s] - b.cover[t] <= theta + _EPS
            visit(s[near], t[near], d[near])
    out = []
    for t, l, e in ((a, found.runs[0], found.exact[0]), (b, found.runs[1], found.exact[1])):
        n = np.zeros(len(t.x), np.int64)
        n[t.order] = np.cumsum(l)[:-1]
        out.append(n + e)
    i, j = _forest(found.edges, len(a.x), len(b.x), same) if found.edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return out[0], out[1], i, j


def _spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs that a boolean matrix marks, which connect its rows and columns as all of them do."""
    rows, columns = hit.any(1), hit.any(0)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in np.flatnonzero(rows):
        todo = [start] if rows[start] else []
        rows[start] = False
        while todo:
            i = todo.pop()
            j = np.flatnonzero(hit[i] & columns)
            if len(j):
                columns[j] = False
                out.append((np.full(len(j), i), j))
                reached = np.flatnonzero(rows)
                by = hit[np.ix_(reached, j)]
                some = by.any(1)
                reached = reached[some]
                rows[reached] = False
                out.append((reached, j[by[some].argmax(1)]))
                todo.extend(reached.tolist())
    return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1))


def _forest(edges: list[tuple[np.ndarray, np.ndarray]], n: int, m: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges by union-find."""
    i, j = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    parent = list(range(n if same else n + m))
    shift, keep = 0 if same else n, []
    for k, (x, y) in enumerate(zip(i.tolist(), (j + shift).tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[x] = y
            keep.append(k)
    return i[keep], j[keep]


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """Unit vectors as bytes of doubles; None for what is null, empty, zero, or holds null or non-finite components."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    out: list[bytes | None] = [None] * len(column)
    for width in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == width)
        x = flat[first[rows, None] + np.arange(width)]
        with np.errstate(all="ignore"):
            scale = np.abs(x).max(1)
            good = np.isfinite(scale) & (scale > 0)
        x = x[good] / scale[good, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        for i, v in zip(rows[good], x):
            out[i] = v.tobytes()
    return out


def _matrix(column) -> np.ndarray:
    """Equally long vectors as rows."""
    raw = list(column)
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


_KEY = ["_label", "width", "node"]


def _divided(classes: DataFrame, part: int, theta: float) -> tuple[DataFrame, list[DataFrame]]:
    """Classes with their node, and for each level its nodes (_KEY, parent, centre, cover, n, open).

    classes: _label, width, rep, size, unit. Nodes that are open have children, on the next level. What comes to the
    driver is whether a level has open nodes.
    """
    label = classes.schema["_label"].dataType.simpleString()
    rows = materialize(classes.select("_label", "width", F.lit("").alias("node"), "rep", "size", "unit"), "level0")
    nodes = rows.groupBy(*_KEY).agg(F.min(F.struct("rep", "unit"))["unit"].alias("centre"), F.lit(2.0).alias("cover"), F.count(F.lit(1)).alias("n"))
    levels = [materialize(nodes.withColumn("parent", F.lit(None).cast("string")).withColumn("open", F.col("n") > part), "nodes0")]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """Centres far from each other, of a node's sample."""
        pdf = pdf.sort_values("rep")
        x = _matrix(pdf["unit"])
        chosen, far = [0], _distance(x, x[0])
        fan = min(FAN, -(-2 * int(pdf["before"].iloc[0]) // part))
        while len(chosen) < fan and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distance(x, x[chosen[-1]]))
        return pdf.iloc[:1][_KEY].assign(centres=[[pdf["unit"].iloc[i] for i in chosen]])

    @F.arrow_udf("struct<at:int,far:double>")
    def nearest(unit: pa.Array, centres: pa.Array) -> pa.Array:
        at, far = [], []
        for u, c in zip(unit.to_pylist(), centres.to_pylist()):
            d = _distance(_matrix(c), np.frombuffer(u))
            at.append(int(d.argmin()))
            far.append(float(d.min()))
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(far, pa.float64())], ["at", "far"])

    for step in range(1, ROUNDS + 1):
        open_ = levels[-1].where("open").select(*_KEY, F.col("n").alias("before"))
        if open_.isEmpty():
            break
        some = rows.join(open_, _KEY).where(F.pmod(F.xxhash64("rep", F.lit(step)), "before") < SAMPLE).select(*_KEY, "before", "rep", "unit")
        centres = materialize(some.groupBy(*_KEY).applyInPandas(choose, f"_label {label}, width int, node string, centres array<binary>"), f"centres{step}")
        moved = rows.join(centres, _KEY).withColumn("_near", nearest("unit", "centres"))
        moved = moved.select("_label", "width", F.concat("node", F.lit("/"), F.col("_near.at").cast("string")).alias("node"), "rep", "size", "unit", F.col("_near.far").alias("far"), F.col("node").alias("parent"))
        moved = materialize(moved, f"moved{step}")
        kids = centres.select("_label", "width", "node", F.posexplode("centres").alias("_at", "centre")).select("_label", "width", F.concat("node", F.lit("/"), F.col("_at").cast("string")).alias("node"), "centre")
        nodes = moved.groupBy(*_KEY, "parent").agg(F.max("far").alias("cover"), F.count(F.lit(1)).alias("n")).join(kids, _KEY)
        nodes = nodes.join(open_.withColumnRenamed("node", "parent"), ["_label", "width", "parent"])
        # A ball within the threshold has nothing to prune, and one that hardly shrinks won't.
        open_next = (F.col("n") > part) & (F.col("cover") > theta) & (10 * F.col("n") <= 9 * F.col("before")) & F.lit(step < ROUNDS)
        levels.append(materialize(nodes.select(*_KEY, "parent", "centre", "cover", "n", open_next.alias("open")), f"nodes{step}"))
        still = rows.join(open_.select(*_KEY), _KEY, "left_anti").select(rows.columns)
        before, rows = rows, materialize(still.unionByName(moved.select(rows.columns)), f"level{step}")
        discard(before, centres, moved)
    return rows, levels


def _near_nodes(levels: list[DataFrame], theta: float) -> DataFrame:
    """Pairs (_label, width, node <= node2) of nodes without children that their radii don't rule out, level by level."""

    @F.arrow_udf("double")
    def gap(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([float(_distance(np.frombuffer(u), np.frombuffer(v))) for u, v in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    ball = ["_label", "width", "node", "centre", "cover"]
    pairs = levels[0].select("_label", "width", F.col("node").alias("p"), F.col("node").alias("q"))
    shut = levels[0].where("not open").select(ball)
    for i, nodes in enumerate(levels[1:], 1):
        down = nodes.select("parent", *ball).unionByName(shut.withColumn("parent", F.col("node")))
        x = down.select("_label", "width", F.col("parent").alias("p"), F.col("node").alias("a"), F.col("centre").alias("ca"), F.col("cover").alias("ra"))
        y = down.select("_label", "width", F.col("parent").alias("q"), F.col("node").alias("b"), F.col("centre").alias("cb"), F.col("cover").alias("rb"))
        both = pairs.join(x, ["_label", "width", "p"]).join(y, ["_label", "width", "q"]).where("p != q or a <= b")
        both = both.where((F.col("a") == F.col("b")) | (gap("ca", "cb") - F.col("ra") - F.col("rb") <= theta + _EPS))
        before, pairs = pairs, materialize(both.select("_label", "width", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")), f"pairs{i}")
        discard(before)
        shut = shut.unionByName(nodes.where("not open").select(ball))
    return pairs.withColumnsRenamed({"p": "node", "q": "node2"})


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, part: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors.

    Rows are compared if their labels are equal and not null and their vectors have equal length. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, and so do rows with a null label or
    id (a null id's component is null). Repeated ids must not carry different vectors; equal rows count as partners of
    each other. Ids must be whole numbers. An empty table gives no rows; other columns are not carried.
    """
    configure(vectors.sparkSession)
    theta = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(whole_ids(vectors, id_col).alias("vec_id"), F.col(vector_col).alias("_v"), F.col(label_col).alias("_label"))

    @F.arrow_udf("binary")
    def unit(v: pa.Array) -> pa.Array:
        return pa.array(unit_vectors(v), pa.binary())

    rows = rows.select("vec_id", F.when(F.col("_label").isNotNull() & F.col("vec_id").isNotNull(), unit("_v")).alias("unit"), "_label")
    rows = materialize(rows.withColumn("digest", F.unhex(F.sha2("unit", 256))), "units")
    classes = rows.where("unit is not null").groupBy("_label", "unit", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.withColumn("width", F.octet_length("unit")), "classes")
    held, levels = _divided(classes, part, theta)
    near = _near_nodes(levels, theta)
    piece = [*_KEY, "piece"]
    if held.groupBy(*_KEY).count().where(F.col("count") > part).isEmpty():
        members = held.withColumn("piece", F.lit(0))
    else:
        members = numbered(held, _KEY, [F.col("rep")]).withColumn("piece", F.expr(f"cast(rank div {part} as int)")).drop("rank")

    def sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Classes, sizes and vectors of one side in order, and its tree if it came along (as a row of size -1)."""
        own = pdf[pdf["size"] >= 0].sort_values("rep")
        return own["rep"].to_numpy(), own["size"].to_numpy(), _matrix(own["unit"]), list(pdf["unit"][pdf["size"] < 0])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """A piece's links within, and its tree."""
        rep, size, x, _ = sides(pdf)
        tree = CoverTree(x, theta)
        n, m, i, j = dual_links(tree, tree, cosine, size, size)
        links = pd.concat([pd.DataFrame({"a": rep, "b": rep, "n": n + m}).query("n > 0"), pd.DataFrame({"a": rep[i], "b": rep[j], "n": 0})])
        out = pd.DataFrame({"a": [*links["a"], 0], "b": [*links["b"], 0], "n": [*links["n"], 0], "tree": [None] * len(links) + [tree.to_bytes()]})
        return out.assign(**{k: pdf[k].iloc[0] for k in piece})[[*piece, "a", "b", "n", "tree"]]

    kinds = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in piece)
    built = materialize(members.groupBy(*piece).applyInPandas(build, f"{kinds}, a long, b long, n long, tree binary"), "built")
    found = built.where("tree is null").select("a", "b", "n")

    # Pairs of pieces, each with its vectors and its tree.
    parts = built.where("tree is not null").select(*piece)
    others = near.join(parts, _KEY).join(parts.withColumnsRenamed({"node": "node2", "piece": "piece2"}), ["_label", "width", "node2"]).where("node != node2 or piece < piece2")
    others = materialize(others.select(*piece, "node2", "piece2"), "others")
    if not others.isEmpty():
        carried = members.select(*piece, "rep", "size", "unit").unionByName(built.where("tree is not null").select(*piece, F.lit(0).cast("long").alias("rep"), F.lit(-1).cast("long").alias("size"), F.col("tree").alias("unit")))
        task = [*piece, "node2", "piece2"]
        left = others.join(carried, piece).select(*task, F.lit(0).alias("side"), "rep", "size", "unit")
        right = others.join(carried.withColumnsRenamed({"node": "node2", "piece": "piece2"}), ["_label", "width", "node2", "piece2"]).select(*task, F.lit(1).alias("side"), "rep", "size", "unit")

        def traverse(pdf: pd.DataFrame) -> pd.DataFrame:
            (rep, size, x, tree), (rep2, size2, x2, tree2) = (sides(pdf[pdf["side"] == s]) for s in (0, 1))
            a, b = CoverTree.from_bytes(x, tree[0]), CoverTree.from_bytes(x2, tree2[0])
            n, m, i, j = dual_links(a, b, cosine, size, size2)
            return pd.concat([pd.DataFrame({"a": r, "b": r, "n": k}).query("n > 0") for r, k in ((rep, n), (rep2, m))] + [pd.DataFrame({"a": rep[i], "b": rep2[j], "n": 0})])

        crossed = materialize(left.unionByName(right).groupBy(*task).applyInPandas(traverse, "a long, b long, n long"), "crossed")
        found = found.unionByName(crossed)
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    linked = components(found.where("a != b").select("a", "b"))
    classes = classes.join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialize(classes.select("_label", "digest", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "linked")
    discard(held, near, others, built, linked, *levels)
    # Null-safe keys: rows without a vector keep themselves.
    out = rows.select("vec_id", "_label", "digest").join(classes, ["_label", "digest"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
