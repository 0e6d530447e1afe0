"""A forest of random-projection trees, searched through one shared priority queue.

The trees are fitted on a bounded sample; every vector is then routed. An inner
node has a hyperplane through two random points of its sample, at their
projections' median. The search puts the roots of all trees into one queue,
always opens the node with the largest margin (the smallest distance on the
wrong side met so far), and stops at the wanted number of leaves: one of each
tree and then the leaves that lie nearest behind any hyperplane of any tree.
All vectors of a batch take their steps together, so the queue is an array.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

LEAST_SAMPLE = 8


@dataclass
class Forest:
    """normals, offsets, near and far children by node; a leaf has child -1 and a leaf number."""

    roots: np.ndarray
    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def dumps(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, roots=self.roots, normals=self.normals, offsets=self.offsets, children=self.children, leaf=self.leaf)
        return held.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Forest:
        with np.load(io.BytesIO(data)) as held:
            return cls(**held)

    def search(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """Numbers of the ``leaves`` best leaves for each row of x, -1 where the forest has fewer."""
        n, t = len(x), len(self.roots)
        rows = np.arange(n)
        priority = np.full((n, t), np.inf, np.float32)
        node = np.broadcast_to(self.roots, (n, t)).copy()
        got = np.full((n, leaves), -1, np.int32)
        count = np.zeros(n, np.int64)
        while True:
            best = priority.argmax(1)
            p = priority[rows, best]
            at = node[rows, best]
            open_ = (count < leaves) & (p > -np.inf)
            if not open_.any():
                return got
            is_leaf = open_ & (self.children[at, 0] < 0)
            inner = open_ & ~is_leaf
            hit = rows[is_leaf]
            got[hit, count[hit]] = self.leaf[at[hit]]
            count[hit] += 1
            priority[hit, best[hit]] = -np.inf
            far_priority, far_node = np.full(n, -np.inf, np.float32), np.zeros(n, node.dtype)
            i = rows[inner]
            if len(i):
                margin = np.einsum("ij,ij->i", x[i], self.normals[at[i]]) - self.offsets[at[i]]
                side = (margin > 0).astype(np.int64)
                node[i, best[i]] = self.children[at[i], side]
                far_node[i] = self.children[at[i], 1 - side]
                far_priority[i] = np.minimum(p[i], -np.abs(margin))
                priority = np.column_stack([priority, far_priority])
                node = np.column_stack([node, far_node])


def fit(sample: np.ndarray, parts: int, trees: int, seed: int = 7) -> Forest:
    """Trees of about ``parts`` leaves each; no leaf has fewer than LEAST_SAMPLE sample rows unless the sample is that small."""
    random = np.random.default_rng(seed)
    normals, offsets, children, leaf, roots = [], [], [], [], []
    leaves = 0

    def node() -> int:
        normals.append(np.zeros(sample.shape[1], np.float32))
        offsets.append(0.0)
        children.append([-1, -1])
        leaf.append(-1)
        return len(normals) - 1

    for _ in range(trees):
        root = node()
        roots.append(root)
        todo = [(root, np.arange(len(sample)), float(parts))]
        while todo:
            at, own, wanted = todo.pop()
            side = None
            if wanted > 1 and len(own) >= 2 * LEAST_SAMPLE:
                for _ in range(5):
                    a, b = sample[random.choice(own, 2, replace=False)]
                    w = a - b
                    if (size := np.linalg.norm(w)) > 1e-6:
                        along = sample[own] @ (w / size)
                        side = along > np.median(along)
                        if side.any() and not side.all():
                            break
                        side = None
            if side is None:
                leaf[at] = leaves
                leaves += 1
                continue
            normals[at], offsets[at] = w / size, float(np.median(along))
            children[at] = [node(), node()]
            todo += [(children[at][0], own[~side], wanted / 2), (children[at][1], own[side], wanted / 2)]
    return Forest(np.array(roots), np.array(normals, np.float32), np.array(offsets, np.float32), np.array(children), np.array(leaf, np.int32))
