"""A prefix tree of token sets, and the components of the sets that are alike."""

from __future__ import annotations

import numpy as np


def alike(overlap: int, a: int, b: int) -> bool:
    """Whether the Jaccard similarity of two sets is at least 3/4."""
    return 7 * overlap >= 3 * (a + b)


class Node:
    """Tokens that all sets below begin with, after those of the nodes above."""

    __slots__ = ("tokens", "children", "sets", "least", "most", "longest", "open")


class Trie:
    """Sets in one order of tokens, the most frequent first, so that sets share long beginnings."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        tokens, ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.empty(len(tokens), np.int64)
        order[np.argsort(-counts, kind="stable")] = np.arange(len(tokens))
        self.width, self.sizes = int(np.count_nonzero(counts > 1)), sizes
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        # tokens of one set only cannot overlap; they count in the size alone
        self.sets = [np.sort(r[r < self.width]) for r in np.split(order[ranks], cuts)]
        self.path: list[list[Node]] = [[] for _ in sets]
        by_text = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        self.root = self._build(by_text)

    def _build(self, members: list[int]) -> Node:
        top, todo = None, [(members, 0, None)]
        while todo:
            group, depth, above = todo.pop()
            a, b = self.sets[group[0]][depth:], self.sets[group[-1]][depth:]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared = int(differ[0]) if len(differ) else n
            node = Node()
            node.tokens, node.children, node.sets = a[:shared], [], []
            node.open = len(group)
            sizes = [self.sizes[i] for i in group]
            node.least, node.most = min(sizes), max(sizes)
            node.longest = max(len(self.sets[i]) for i in group) - depth
            for i in group:
                self.path[i].append(node)
            if above is None:
                top = node
            else:
                above.children.append(node)
            end, start = depth + shared, 0
            while start < len(group) and len(self.sets[group[start]]) == end:
                node.sets.append(group[start])
                start += 1
            while start < len(group):
                stop, token = start, self.sets[group[start]][end]
                while stop < len(group) and self.sets[group[stop]][end] == token:
                    stop += 1
                todo.append((group[start:stop], end, node))
                start = stop
        return top

    def close(self, i: int) -> None:
        """Leave a set out of later searches."""
        for node in self.path[i]:
            node.open -= 1

    def search(self, i: int, closed: list[bool]) -> list[int]:
        """Sets that are still open and alike to set ``i``.

        The overlap with a node's tokens is counted once for all sets below. A subtree is left where its
        sizes do not fit, or where even all remaining tokens would not make up the overlap.
        """
        mine, size = self.sets[i], self.sizes[i]
        has = np.zeros(self.width, bool)
        has[mine] = True
        found, todo = [], [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            if not node.open or 4 * node.most < 3 * size or 4 * size < 3 * node.least:
                continue
            need = 3 * (size + node.least)
            if 7 * (overlap + min(node.longest, len(mine) - overlap)) < need:
                continue
            overlap += int(np.count_nonzero(has[node.tokens]))
            if 7 * (overlap + min(node.longest - len(node.tokens), len(mine) - overlap)) < need:
                continue
            found += [j for j in node.sets if not closed[j] and alike(overlap, size, self.sizes[j])]
            todo += [(child, overlap) for child in node.children]
        return found


def linked(sets: list[np.ndarray], sizes: list[int]) -> list[int]:
    """For each set the first set of its component, where sets are linked if they are alike.

    Breadth first: a search looks among sets that no component has yet, so a group in which all are
    alike to its first set takes one search.
    """
    root = [-1] * len(sets)
    if not any(len(s) for s in sets):
        return list(range(len(sets)))
    trie = Trie(sets, sizes)
    closed = [False] * len(sets)
    left = len(sets)

    def take(j: int, first: int) -> None:
        nonlocal left
        root[j], closed[j] = first, True
        trie.close(j)
        left -= 1

    for first in range(len(sets)):
        if closed[first]:
            continue
        take(first, first)
        todo = [first]
        while todo and left:
            for j in trie.search(todo.pop(), closed):
                take(j, first)
                todo.append(j)
    return root
