"""Searches within one task: cheapest paths from any number of seeds, with or without a lower bound that leads to the goal."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush
from typing import NamedTuple

from lanecraft.functions import geo

#: Node -> node -> cost.
Links = dict[int, dict[int, float]]
#: Lower bounds are shortened by this share, so that rounding makes none of them too long.
SHORTER = 1 - 1e-9


class Found(NamedTuple):
    cost: dict[int, float]
    before: dict[int, int]
    settled: int

    def path(self, goal: int) -> list[int]:
        """The nodes from a seed to ``goal``."""
        out = [goal]
        while out[-1] in self.before:
            out.append(self.before[out[-1]])
        return out[::-1]


def links(src: Iterable[int], dst: Iterable[int], cost: Iterable[float]) -> Links:
    """Of several links between two nodes the cheapest."""
    out: Links = {}
    for s, d, c in zip(src, dst, cost, strict=True):
        held = out.setdefault(s, {})
        if c < held.get(d, math.inf):
            held[d] = c
    return out


def cheapest(out: Links, seeds: dict[int, float], goals: Iterable[int] | None = None, bound: Callable[[int], float] | None = None) -> Found:
    """Costs from the seeds, which have costs of their own, until all ``goals`` are settled (None: everything that can be reached).

    ``bound`` gives for a node no more than the cost from it to any goal; with it a node may be settled again, and the search
    goes where the goal is. Costs of nodes that aren't settled may be too high.
    """
    cost, before = dict(seeds), {}
    heap = [((bound(n) if bound else 0.0) + c, c, n) for n, c in seeds.items()]
    heapify(heap)
    left = None if goals is None else set(goals)
    settled, bounds = 0, {}
    while heap and (left is None or left):
        _, c, node = heappop(heap)
        if c > cost[node]:
            continue
        settled += 1
        if left is not None:
            left.discard(node)
        for other, step in out.get(node, {}).items():
            if c + step < cost.get(other, math.inf):
                cost[other], before[other] = c + step, node
                ahead = 0.0
                if bound:
                    ahead = bounds.get(other)
                    if ahead is None:
                        ahead = bounds[other] = bound(other)
                heappush(heap, (c + step + ahead, c + step, other))
    return Found(cost, before, settled)


def reached(out: Links, seeds: Iterable[int]) -> set[int]:
    seen = set(seeds)
    stack = list(seen)
    while stack:
        for node in out.get(stack.pop(), ()):
            if node not in seen:
                seen.add(node)
                stack.append(node)
    return seen


def turned(out: Links) -> Links:
    """Every link the other way round."""
    back: Links = {}
    for s, ends in out.items():
        for d, c in ends.items():
            back.setdefault(d, {})[s] = c
    return back


def place(node: int) -> tuple[float, float]:
    """Latitude and longitude of a node id (see ``graph.node_id``)."""
    return node // 100_000_000 / 1e5 - 90, node % 100_000_000 / 1e5 - 180


def metres(a: float, b: float, c: float, d: float) -> float:
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.EARTH_M * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def straight(goal: int, speed: float) -> Callable[[int], float]:
    """Seconds to ``goal`` as the crow flies at the top speed in m/s: never more than a path takes whose links are no faster.

    Ids tell places to five decimals, so three metres are taken off for what links' ends may be away from there.
    """
    lat, lng = place(goal)
    return lambda node: max(metres(*place(node), lat, lng) - 3, 0.0) / speed * SHORTER


class Landmarks:
    """Costs from and to a few far nodes of a graph, held once, which bound the cost between any two nodes."""

    def __init__(self, out: Links, count: int = 4):
        back = turned(out)
        self.ways: list[tuple[dict[int, float], dict[int, float]]] = []
        nodes = sorted(set(out) | set(back))
        chosen: list[int] = []
        while nodes and len(chosen) < count:
            # The node farthest from the landmarks so far; at first from any node.
            near = {n: min((metres(*place(n), *place(c)) for c in chosen or nodes[:1])) for n in nodes}
            far = max(nodes, key=lambda n: (near[n], n))
            if far in chosen:
                break
            chosen.append(far)
            self.ways.append((cheapest(out, {far: 0.0}).cost, cheapest(back, {far: 0.0}).cost))

    def bound(self, goal: int) -> Callable[[int], float]:
        held = [(a, b, a.get(goal), b.get(goal)) for a, b in self.ways]

        def ahead(node: int) -> float:
            most = 0.0
            for out, back, out_goal, back_goal in held:
                if out_goal is not None and node in out:
                    most = max(most, out_goal - out[node])  # from the landmark on
                if back_goal is not None and node in back:
                    most = max(most, back[node] - back_goal)  # to the landmark
            return most * SHORTER

        return ahead


def larger(*bounds: Callable[[int], float]) -> Callable[[int], float]:
    return lambda node: max(b(node) for b in bounds)
