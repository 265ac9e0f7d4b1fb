"""Cover trees over unit vectors, and a dual traversal that finds all pairs within a distance."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SLACK = 1e-9  # far above what rounding adds to a distance


@dataclass
class Node:
    """A center with all rows of its subtree; `radius` is the distance of the farthest of them."""

    center: int
    rows: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def _distances(x: np.ndarray, rows: np.ndarray, center: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[rows] @ x[center])))


def build(x: np.ndarray, rows: np.ndarray, scale: float = 2.0, floor: float = 1e-4) -> Node:
    """Nested levels with halving radii: each level's centers lie farther apart than its radius, and cover their subtree within it."""
    center = int(rows[0])
    d = _distances(x, rows, center)
    node = Node(center, rows, float(d.max()))
    if len(rows) == 1 or node.radius == 0:
        return node
    radius = scale
    while radius >= node.radius:  # levels at which one center covers all are left out
        radius /= 2
    if radius < floor:
        return node
    left, near = rows, d
    while len(left):
        inside = near <= radius
        node.children.append(build(x, left[inside], radius, floor))
        left = left[~inside]
        if len(left):
            near = _distances(x, left, int(left[0]))
    return node


def pairs_within(x: np.ndarray, a: Node, b: Node, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs (one of a's subtree, one of b's) with a cosine of at least `cosine`, each once.

    Both trees are descended together. A pair of nodes is dropped when even its nearest rows lie too far apart
    (distance of the centers less both covering radii), all its pairs are taken when even its farthest rows
    lie near enough, and otherwise the wider node is opened. With a is b each unordered pair comes once.
    """
    limit = float(np.sqrt(2.0 - 2.0 * cosine))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def exact(r: np.ndarray, s: np.ndarray, same: bool) -> None:
        hit = x[r] @ x[s].T >= cosine
        if same:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        left.append(r[i])
        right.append(s[j])

    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        same = a is b
        if len(a.rows) * len(b.rows) <= 4096 or (not a.children and not b.children):
            exact(a.rows, b.rows, same)
            continue
        opened_a = a.children or [a]
        opened_b = b.children or [b]
        if not same and a.children and b.children and (a.radius > 2 * b.radius or b.radius > 2 * a.radius):
            opened_a, opened_b = (opened_a, [b]) if a.radius > b.radius else ([a], opened_b)
        ca, cb = np.array([n.center for n in opened_a]), np.array([n.center for n in opened_b])
        ra, rb = np.array([n.radius for n in opened_a]), np.array([n.radius for n in opened_b])
        cos = x[ca] @ x[cb].T
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))
        reach = d - ra[:, None] - rb[None, :] <= limit + SLACK
        if same:
            reach = np.triu(reach)
        point = (ra == 0)[:, None] & (rb == 0)[None, :]
        single = np.array([len(n.rows) == 1 for n in opened_a])[:, None] & np.array([len(n.rows) == 1 for n in opened_b])[None, :]
        hit = reach & single & (cos >= cosine)
        if same:
            np.fill_diagonal(hit, False)
        i, j = np.nonzero(hit)
        left.append(ca[i])
        right.append(cb[j])
        more = reach & ~single
        whole = more & ~point & (d + ra[:, None] + rb[None, :] <= limit - SLACK)
        for i, j in zip(*np.nonzero(more), strict=True):
            m, n = opened_a[i], opened_b[j]
            if whole[i, j] and m is not n:
                left.append(np.repeat(m.rows, len(n.rows)))
                right.append(np.tile(n.rows, len(m.rows)))
            else:
                todo.append((m, n))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])
