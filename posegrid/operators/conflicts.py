"""Matches across cameras cut until no component has two persons of one video.

The rule: while a component has two persons of a video, the first such video in
order counts, and the weakest match at one of its persons there goes, the first
of equal ones.  Components do not act on each other, so each is worked off alone,
and nothing is built anew after a removal: a search from both ends of the match
that went, a step on each side in turn, either meets or has seen all of the
smaller part.  Only that part gets new tables, and what the larger one still
holds of it is passed over when it comes up.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict, deque

Node = tuple
Edge = tuple[float, Node, Node]


class _Parts:
    """The components, and for each its persons by video and matches by strength."""

    def __init__(self, nodes: list[Node], edges: list[Edge]):
        self.edges = edges
        self.alive = [True] * len(edges)
        self.near: dict[Node, dict[int, Node]] = {n: {} for n in nodes}
        for k, (_, a, b) in enumerate(edges):
            self.near[a][k] = b
            self.near[b][k] = a
        self.part: dict[Node, int] = {}
        self.persons: list[Counter] = []
        self.clashes: list[list] = []
        self.weakest: list[defaultdict] = []
        for n in nodes:
            if n not in self.part:
                self.add(self.reached(n))

    def reached(self, start: Node) -> list[Node]:
        seen, todo = {start}, [start]
        while todo:
            for b in self.near[todo.pop()].values():
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return [*seen]

    def add(self, members: list[Node]) -> int:
        """A component of its own; its tables."""
        number = len(self.persons)
        persons = Counter(v for v, _ in members)
        clash = [v for v, n in persons.items() if n > 1]
        weakest: defaultdict = defaultdict(list)
        for m in members:
            self.part[m] = number
            if persons[m[0]] > 1:
                weakest[m[0]] += [(self.edges[k][0], k, m) for k in self.near[m]]
        heapq.heapify(clash)
        for heap in weakest.values():
            heapq.heapify(heap)
        self.persons.append(persons)
        self.clashes.append(clash)
        self.weakest.append(weakest)
        return number

    def smaller_side(self, a: Node, b: Node) -> list[Node] | None:
        """All that is still connected with one of two nodes, if not with the other: the one seen first."""
        seen = ({a}, {b})
        # nearest first: in a part that hangs together the two meet soon
        todo = (deque([iter(self.near[a].values())]), deque([iter(self.near[b].values())]))
        while True:
            for own, other, waiting in ((seen[0], seen[1], todo[0]), (seen[1], seen[0], todo[1])):
                while waiting:
                    node = next(waiting[0], None)
                    if node is None:
                        waiting.popleft()
                        continue
                    if node in other:
                        return None
                    if node not in own:
                        own.add(node)
                        waiting.append(iter(self.near[node].values()))
                        break
                if not waiting:
                    return [*own]

    def settle(self, number: int) -> list[int]:
        """Cut one component until its persons are of different videos; the parts that came off."""
        off = []
        clashes, weakest, persons = self.clashes[number], self.weakest[number], self.persons[number]
        while clashes:
            video = clashes[0]
            if persons[video] < 2:
                heapq.heappop(clashes)
                continue
            heap = weakest[video]
            while not self.alive[heap[0][1]] or self.part[heap[0][2]] != number:
                heapq.heappop(heap)
            _, k, _ = heapq.heappop(heap)
            self.alive[k] = False
            _, a, b = self.edges[k]
            del self.near[a][k], self.near[b][k]
            side = self.smaller_side(a, b)
            if side is not None:
                persons.subtract(v for v, _ in side)
                off.append(self.add(side))
        return off


def resolve_in_order(nodes: list[Node], edges: list[Edge]) -> dict[Node, Node]:
    """The least node of every node's component once all conflicts are resolved.

    A node is (video, person); ``edges`` are (similarity, node, node) in the order
    that decides between equal ones.
    """
    parts = _Parts(nodes, list(edges))
    todo = [*range(len(parts.persons))]
    while todo:
        todo += parts.settle(todo.pop())
    least: dict[int, Node] = {}
    for n, p in parts.part.items():
        least[p] = min(least.get(p, n), n)
    return {n: least[p] for n, p in parts.part.items()}
