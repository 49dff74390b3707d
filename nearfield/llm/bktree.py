"""BK-trees over 64-bit codes, many trees at a time, as numpy arrays.

A child hangs below its parent at the edge that bears their Hamming distance,
so everything below edge ``e`` lies at distance ``e`` from the parent. A search
within radius ``r`` that is ``d`` away from a node can by the triangle
inequality only succeed below edges ``d - r`` to ``d + r`` and follows no other.
"""

from __future__ import annotations

import numpy as np

EDGES = 65  # distances of 64-bit codes: 0 to 64


class Forest:
    """One tree per value of ``tree``; codes are distinct within a tree. Nodes are positions in ``codes``."""

    def __init__(self, codes: np.ndarray, tree: np.ndarray):
        self.codes = np.asarray(codes, dtype=np.uint64)
        self.names, self.roots, member = np.unique(tree, return_index=True, return_inverse=True)
        n = len(self.codes)
        waiting = np.setdiff1d(np.arange(n), self.roots, assume_unique=True)
        at = self.roots[member[waiting]]
        slots, nodes = [], []
        while waiting.size:  # one level of all trees per turn
            slot = at * EDGES + np.bitwise_count(self.codes[waiting] ^ self.codes[at]).astype(np.int64)
            taken, first, which = np.unique(slot, return_index=True, return_inverse=True)
            child = waiting[first]
            slots.append(taken)
            nodes.append(child)
            down = np.ones(waiting.size, dtype=bool)
            down[first] = False
            waiting, at = waiting[down], child[which[down]]
        slot = np.concatenate(slots) if slots else np.empty(0, dtype=np.int64)
        order = np.argsort(slot)
        self.slots = slot[order]
        self.nodes = (np.concatenate(nodes) if nodes else np.empty(0, dtype=np.int64))[order]

    def within(self, codes: np.ndarray, tree: np.ndarray, radius: int):
        """``(query position, node)`` of all nodes at ``radius`` or less from a query in the tree it names.

        Queries that name no tree find nothing.
        """
        codes = np.asarray(codes, dtype=np.uint64)
        place = np.searchsorted(self.names, tree)
        place[place == len(self.names)] = 0
        query = np.flatnonzero(self.names[place] == tree) if len(self.names) else np.empty(0, dtype=np.int64)
        node = self.roots[place[query]] if len(self.names) else query
        found_q, found_n = [], []
        while query.size:
            gap = np.bitwise_count(codes[query] ^ self.codes[node]).astype(np.int64)
            hit = gap <= radius
            found_q.append(query[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.slots, node * EDGES + np.maximum(gap - radius, 0))
            high = np.searchsorted(self.slots, node * EDGES + np.minimum(gap + radius, EDGES - 1), side="right")
            many = high - low
            start = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many)
            node = self.nodes[start + np.arange(many.sum())]
            query = np.repeat(query, many)
        if not found_q:
            return query, node
        return np.concatenate(found_q), np.concatenate(found_n)


def merge_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of ``left[i]`` and ``right[i]``; a label is the lowest position of its group."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
