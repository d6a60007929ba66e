"""Two-way labelling of a few nodes by a minimum cut."""

from __future__ import annotations

from collections import deque

_EPS = 1e-9


def label(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut.

    A positive score is the capacity from the source (the cost of the label False), a negative one the capacity to the
    sink; an edge's weight is the cost of giving its ends different labels.

    A node whose own capacity is larger than all its open edges together keeps its label in every minimum cut, so
    it is settled first and its edges become capacities of its neighbours. What stays open goes through max-flow.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    own, found = list(scores), [None] * n
    queue = deque(range(n))
    while queue:
        a = queue.popleft()
        if found[a] is None and abs(own[a]) > sum(near[a].values()) + _EPS:
            found[a] = own[a] > 0
            for b, w in near[a].items():
                own[b] += w if found[a] else -w
                del near[b][a]
                queue.append(b)
            near[a] = {}
    open_ = [a for a in range(n) if found[a] is None]
    if open_:
        source_side = _flow([own[a] for a in open_], {a: k for k, a in enumerate(open_)}, near)
        for k, a in enumerate(open_):
            found[a] = k in source_side
    return [bool(x) for x in found]


def _flow(own: list[float], place: dict[int, int], near: list[dict[int, float]]) -> set[int]:
    """Max-flow by blocking flows; the nodes that the source still reaches afterwards."""
    n = len(own)
    s, t = n, n + 1
    left: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for a, k in place.items():
        for b, w in near[a].items():
            left[k][place[b]] = w
        if own[k] > 0:
            left[s][k], left[k][s] = own[k], 0.0
        elif own[k] < 0:
            left[k][t], left[t][k] = -own[k], 0.0
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, c in left[a].items():
                if c > _EPS and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if t not in level:
            return {a for a in level if a < n}
        ways = {a: list(left[a]) for a in level}
        path = [s]
        while path:
            a = path[-1]
            if a == t:
                most = min(left[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    left[x][y] -= most
                    left[y][x] = left[y].get(x, 0.0) + most
                path = [s]
                continue
            while ways[a]:
                b = ways[a][-1]
                if left[a].get(b, 0.0) > _EPS and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
                ways[a].pop()
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()
