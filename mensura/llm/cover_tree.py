"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are both held in cover trees.  A node has a centre, its
covering radius (the largest distance from the centre to a vector below it) and
children whose centres lie far apart (farthest-point order down to half the
radius, at most ``FAN`` of them).  For a query node and a data node no inner
product exceeds ``<cq, cd> + rq |cd| + rd |cq| + rq rd``; the pair is dropped
when that is below the worst k-th score in the query node.  Scores at the
leaves are exact integer products, and pairs that could still tie are kept.
"""

from __future__ import annotations

import numpy as np

FAN, LEAF, QUERY_LEAF = 12, 32, 16
#: data rows scored in the first leaf pass of a query node; later passes double
PASS_ROWS = 128
#: largest score, and its negative the smallest; one below it stands for no score
LIMIT = np.iinfo(np.int64).max


class CoverTree:
    """Nodes in parent-before-child order; the vectors of a node are consecutive."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        vectors = np.asarray(vectors, dtype=np.int64)
        points = vectors.astype(np.float64)
        self.order = np.arange(len(points))
        centres, radii, first, last, child = [], [], [], [], []

        def add(a: int, b: int, centre: np.ndarray) -> int:
            gaps = np.sqrt(((points[self.order[a:b]] - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(float(gaps.max(initial=0.0)) * (1 + 1e-12))
            first.append(a)
            last.append(b)
            child.append((0, 0))
            return len(radii) - 1

        if len(points):
            add(0, len(points), points.mean(axis=0))
        node = 0
        while node < len(radii):
            a, b = first[node], last[node]
            if b - a > leaf and radii[node] > 0:
                own = self.order[a:b]
                near, which = self._spread(points[own], centres[node], radii[node])
                turn = np.argsort(which, kind="stable")
                self.order[a:b] = own[turn]
                edges = a + np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(near)))])
                begin = len(radii)
                for k, centre in enumerate(near):
                    add(int(edges[k]), int(edges[k + 1]), centre)
                child[node] = (begin, len(radii))
            node += 1
        self.centres = np.array(centres).reshape(len(radii), points.shape[1] if points.ndim == 2 else 0)
        self.radii, self.first, self.last = np.array(radii), np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)
        self.child = np.array(child, dtype=np.int64).reshape(-1, 2)
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.vectors = vectors[self.order]
        self.floats = points[self.order]
        self.largest = float(np.abs(vectors).max(initial=0))

    @staticmethod
    def _spread(points: np.ndarray, centre: np.ndarray, radius: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Child centres in farthest-point order and the nearest of them for every point."""
        gaps = ((points - centre) ** 2).sum(axis=1)
        chosen = [points[int(gaps.argmax())]]
        best = ((points - chosen[0]) ** 2).sum(axis=1)
        which = np.zeros(len(points), dtype=np.int64)
        while len(chosen) < FAN and best.max() > (radius / 2) ** 2:
            chosen.append(points[int(best.argmax())])
            gap = ((points - chosen[-1]) ** 2).sum(axis=1)
            closer = gap < best
            best[closer], which[closer] = gap[closer], len(chosen) - 1
        return chosen, which


def products(a: CoverTree, rows, b: CoverTree, columns) -> np.ndarray:
    """Exact integer inner products: doubles where they are exact, else 64-bit integers, held at their limits beyond them."""
    largest = a.largest * b.largest * max(1, a.vectors.shape[1])
    if largest < 2.0**53:
        return (a.floats[rows] @ b.floats[columns].T).astype(np.int64)
    left, right = a.vectors[rows], b.vectors[columns]
    found = left @ right.T  # modulo 2**64, hence exact wherever the product fits
    if largest >= 2.0**63:
        for i, j in np.argwhere(np.abs(a.floats[rows] @ b.floats[columns].T) > 2.0**62):
            exact = sum(x * y for x, y in zip(left[i].tolist(), right[j].tolist()))
            found[i, j] = max(-LIMIT, min(LIMIT, exact))
    return found


class Search:
    """Running top ``k`` of every query over any number of data trees."""

    LOWEST = np.iinfo(np.int64).min

    def __init__(self, queries: CoverTree, k: int):
        self.q, self.k = queries, k
        n = len(queries.vectors)
        self.scores = np.full((n, k), self.LOWEST)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.pairs = 0

    def add(self, data: CoverTree, ids: np.ndarray) -> None:
        """Search one data tree; ``ids`` are in the tree's input order."""
        if not len(data.radii) or not len(self.q.radii):
            return
        own = ids[data.order]
        stack = [(0, np.zeros(1, dtype=np.int64))]
        while stack:
            node, alive = stack.pop()
            alive, bound = self._kept(node, data, alive)
            a, b = self.q.child[node]
            # data nodes go down one level with the query node
            opened = self._children(data, alive)
            if a < b:
                stack += [(c, opened) for c in range(a, b)]
                continue
            while (data.child[opened, 0] < data.child[opened, 1]).any():
                opened, _ = self._kept(node, data, opened)
                opened = self._children(data, opened)
            opened, bound = self._kept(node, data, opened)
            self._leaves(node, data, own, opened[np.argsort(-bound, kind="stable")])

    @staticmethod
    def _children(data: CoverTree, nodes: np.ndarray) -> np.ndarray:
        begin, end = data.child[nodes].T
        inner = begin < end
        sizes = (end - begin)[inner]
        at = np.repeat(begin[inner] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.concatenate([nodes[~inner], at.astype(np.int64)])

    def _worst(self, node: int) -> float:
        return float(self.scores[self.q.first[node] : self.q.last[node], -1].min())

    def _kept(self, node: int, data: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rq, nq = self.q.radii[node], self.q.norms[node]
        rd, nd = data.radii[nodes], data.norms[nodes]
        bound = data.centres[nodes] @ self.q.centres[node] + rq * nd + rd * nq + rq * rd
        bound = bound + 1e-9 * (nd * nq + rq * nd + rd * nq + rq * rd) + 1e-6  # rounding
        open_ = bound >= self._worst(node)
        return nodes[open_], bound[open_]

    def _leaves(self, node: int, data: CoverTree, ids: np.ndarray, leaves: np.ndarray) -> None:
        a, b = self.q.first[node], self.q.last[node]
        at, limit = 0, PASS_ROWS
        filled = np.cumsum(data.last[leaves] - data.first[leaves])
        while at < len(leaves):
            upto = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + limit, side="right")))
            limit *= 2
            chosen, _ = self._kept(node, data, leaves[at:upto])
            at = upto
            if not len(chosen):
                continue
            place = np.concatenate([np.arange(data.first[c], data.last[c]) for c in chosen])
            found = products(self.q, slice(a, b), data, place)
            self.pairs += found.size
            useful = np.flatnonzero((found >= self.scores[a:b, -1:]).any(axis=0))
            if len(useful):
                scores = np.concatenate([self.scores[a:b], found[:, useful]], axis=1)
                names = np.concatenate([self.ids[a:b], np.broadcast_to(ids[place[useful]], (b - a, len(useful)))], axis=1)
                best = np.lexsort((names, -scores.astype(np.float64) if np.abs(scores[:, self.k :]).max() < 2**53 else ~scores), axis=1)[:, : self.k]
                self.scores[a:b] = np.take_along_axis(scores, best, axis=1)
                self.ids[a:b] = np.take_along_axis(names, best, axis=1)
