"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are dealt in blocks by a hash of their id; a task gets one block of queries and one block
of candidates and builds a tree over each. A node covers its points with a radius; its children
are a net of points at least half that radius apart, each with the points nearest to it. A net is
cut at ``NET`` points (in high dimensions halving may never cover); the points left over join the
nearest child, whose measured radius then says so, and every bound stays exact.

For query node (p, r) and candidate node (c, s) no inner product exceeds
p.c + |p| s + |c| r + r s. A pair of nodes whose bound cannot beat the worst kth score of the
group of queries is pruned; pairs of leaves that remain are multiplied out. The k best of each
block are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .frames import find_package

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
NET = 24
LEAF = 256
#: Scores of up to 2**46 and a place in the block fit one sortable number.
_PLACES = 14
_PLACE_MASK = (1 << _PLACES) - 1
_SMALL = 2.0**46


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, center: int):
        self.center = vectors[center]
        self.norm = float(np.sqrt(self.center @ self.center))
        away = vectors[rows] - self.center
        gaps = np.sqrt(np.einsum("ij,ij->i", away, away))
        self.radius = float(gaps.max()) if len(rows) else 0.0
        self.rows, self.children = rows, []
        if len(rows) > LEAF and self.radius > 0:
            self._divide(vectors, center, gaps)

    def _divide(self, vectors, center, gaps) -> None:
        """A net of points, each at least half the radius from those before it."""
        net, nearest = [center], np.zeros(len(self.rows), np.int64)
        points = vectors[self.rows]
        while len(net) < NET and gaps.max() > self.radius / 2:
            new = int(self.rows[gaps.argmax()])
            away = points - vectors[new]
            other = np.sqrt(np.einsum("ij,ij->i", away, away))
            closer = other < gaps
            nearest[closer], gaps = len(net), np.minimum(gaps, other)
            net.append(new)
        for k, point in enumerate(net):
            mine = self.rows[nearest == k]
            if len(mine):
                self.children.append(Node(vectors, mine, point))

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


class Packed:
    """The k best (score, place) per query as one sortable number each; ties to smaller places."""

    least = -(1 << 47)

    def __init__(self, queries: int, k: int):
        self.k = k
        self.keys = np.full((queries, k), self.least << _PLACES, np.int64)

    def worst(self, rows: np.ndarray) -> int:
        return int(self.keys[rows].min()) >> _PLACES

    def add(self, rows: np.ndarray, score: np.ndarray, places: np.ndarray) -> None:
        keys = np.concatenate((self.keys[rows], (score << _PLACES) | (_PLACE_MASK - places)),
                              axis=1)
        self.keys[rows] = np.partition(keys, keys.shape[1] - self.k, axis=1)[:, -self.k:]

    def found(self):
        row, at = np.nonzero(self.keys >> _PLACES > self.least)
        key = self.keys[row, at]
        return row, _PLACE_MASK - (key & _PLACE_MASK), key >> _PLACES


class Wide:
    """The same for scores of any size that fits a long."""

    least = -(1 << 63) + 1

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), self.least, np.int64)
        self.places = np.zeros((queries, k), np.int64)

    def worst(self, rows: np.ndarray) -> int:
        return int(self.scores[rows].min())

    def add(self, rows: np.ndarray, score: np.ndarray, places: np.ndarray) -> None:
        scores = np.concatenate((self.scores[rows], score), axis=1)
        places = np.concatenate((self.places[rows], np.broadcast_to(places, score.shape)), axis=1)
        first = np.lexsort((places, -scores), axis=1)[:, :self.k]
        self.scores[rows] = np.take_along_axis(scores, first, axis=1)
        self.places[rows] = np.take_along_axis(places, first, axis=1)

    def found(self):
        row, at = np.nonzero(self.scores > self.least)
        return row, self.places[row, at], self.scores[row, at]


class DualTree:
    """The k best candidates of every query of one pair of blocks."""

    def __init__(self, queries, query_ids, candidates, candidate_ids, k: int):
        order = np.argsort(candidate_ids, kind="stable")
        self.ids, self.query_ids, self.k = candidate_ids[order], query_ids, k
        self.order, self.q, self.c = order, queries, candidates[order]
        # Double precision where it is exact, else whole numbers; the tree is the same.
        top = max(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (queries, candidates))
        most = top * top * queries.shape[1]
        kind = np.float64 if most < 2**53 else np.int64
        self.exact = self.q.astype(kind), self.c.astype(kind)
        self.q, self.c = self.q.astype(np.float64), self.c.astype(np.float64)
        self.best = (Packed if most < _SMALL else Wide)(len(queries), k)
        self.done: set[tuple[int, int]] = set()
        self.query_root = Node(self.q, np.arange(len(self.q)), 0)
        root = Node(self.c, np.arange(len(self.c)), 0)
        for leaf in self.query_root.leaves():
            self._prime(leaf, root)
        self._visit(self.query_root, [root])

    def _bounds(self, q: Node, nodes: list[Node]) -> np.ndarray:
        """Scores that no pair below (q, node) exceeds; rounding is allowed for."""
        centers = np.stack([n.center for n in nodes])
        norms = np.array([n.norm for n in nodes])
        radii = np.array([n.radius for n in nodes])
        bound = centers @ q.center + q.norm * radii + norms * q.radius + q.radius * radii
        reach = q.norm * norms + q.norm * radii + norms * q.radius + q.radius * radii
        return bound + 1e-3 + 1e-9 * reach

    def _worst(self, q: Node) -> int:
        return self.best.worst(q.rows)

    def _prime(self, q: Node, root: Node) -> None:
        """First kth scores for a group: the leaf below the highest bounds."""
        node = root
        while node.children:
            node = node.children[int(self._bounds(q, node.children).argmax())]
        self._multiply(q, node)

    def _visit(self, q: Node, nodes: list[Node]) -> None:
        bounds, worst = self._bounds(q, nodes), self._worst(q)
        # A node that can only tie may still hold smaller ids.
        nodes = [(float(bounds[i]), nodes[i]) for i in np.argsort(-bounds, kind="stable")
                 if bounds[i] >= worst]
        if not nodes:
            return
        if not q.children and not any(n.children for _, n in nodes):
            for bound, node in nodes:
                if bound < self._worst(q):
                    break
                self._multiply(q, node)
            return
        below = [x for _, n in nodes for x in (n.children or [n])]
        for child in q.children or [q]:
            self._visit(child, below)

    def _multiply(self, q: Node, c: Node) -> None:
        if (id(q), id(c)) in self.done:
            return
        self.done.add((id(q), id(c)))
        asked, offered = self.exact
        score = (asked[q.rows] @ offered[c.rows].T).astype(np.int64)
        score[self.query_ids[q.rows][:, None] == self.ids[c.rows][None, :]] = self.best.least
        self.best.add(q.rows, score, c.rows)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate row, score) of the best."""
        row, place, score = self.best.found()
        return row, self.order[place], score


def _search(k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        ids, forms = frame["vec_id"].to_numpy(), frame["form"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in _FOUND})
        vectors, copies = np.stack(frame["ints"].to_list()), frame["copies"].to_numpy()
        row, found, score = DualTree(vectors[asks], ids[asks], vectors[~asks], ids[~asks],
                                     k).results()
        return pd.DataFrame({"query_id": ids[asks][row], "form": forms[asks][row],
                             "asked": copies[asks][row], "vec_id": ids[~asks][found],
                             "offered": copies[~asks][found], "score": score})
    return run


_FOUND = ["query_id", "form", "asked", "vec_id", "offered", "score"]


def whole_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, ints, form, copies): floor(scale * x) of every component; vectors that are null or
    empty or hold a null or a value that is not finite are left out, and so are rows without an id.
    Equal rows come as one with their number. ``form`` is a hash of the vector, to tell rows apart
    that share an id. A vector of d components of which one reaches sqrt(2**62 / d) in size takes no
    part either: its inner products need not fit a long."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(
        F.abs(F.lit(float(scale)) * v.cast("double")) < F.sqrt(F.lit(2.0**62) / F.size(x)),
        F.lit(False)))
    ints = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return embeddings.filter(fine & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), ints.alias("ints")).groupBy(
        "vec_id", "ints").agg(F.count("*").alias("copies")).withColumn("form", F.xxhash64("ints"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query.

    ``vectors`` and ``queries`` are tables of ``whole_vectors``. Rows with the query's id are no
    candidates. Ties go to the smaller vec_id. Equal rows count each for itself, as candidates and
    as queries. Vectors of different length are never compared; a query with fewer than k
    candidates gets all of them, one with none gets no row, empty tables give none. Blocks follow from exact row counts; every block of queries meets every block of
    candidates, and only k rows per query and block go on.
    """
    counts = [x.agg(F.count("*")).first()[0] for x in (vectors, queries)]
    blocks = [max(1, -(-n // size)) for n, size in zip(counts, (BLOCK_ROWS // 2,
                                                                 QUERY_ROWS // 2))]

    def dealt(df, own: int, other: int, names: tuple[str, str], asks: bool):
        return df.select(
            F.size("ints").alias("length"), "vec_id", "form", "copies", "ints", F.lit(asks).alias("asks"),
            F.pmod(F.xxhash64("vec_id", "form"), F.lit(own)).cast("int").alias(names[0]),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]))

    sides = dealt(vectors, *blocks, ("c", "q"), False).unionByName(
        dealt(queries, *blocks[::-1], ("q", "c"), True))
    find_package(sides.sparkSession)
    found = sides.groupBy("length", "q", "c").applyInPandas(
        _search(k), "query_id long, form long, asked long, vec_id long, offered long, score long")

    def numbered(name: str, most=None):
        last = F.col(name) if most is None else F.least(F.col(name), F.lit(most))
        return F.explode(F.sequence(F.lit(1).cast("long"), last.cast("long")))
    best = Window.partitionBy("query_id", "form").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("copy", numbered("offered", k)).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.withColumn("copy", numbered("asked")).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
