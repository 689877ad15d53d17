"""Weighted finite-state transducers: composition, and the best path over a string of signs."""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass

#: (from, sign read, sign written, weight, to)
Arc = tuple[Hashable, str, str, float, Hashable]


@dataclass(frozen=True)
class Transducer:
    """Arcs by state and sign read: (sign written, weight, next state). Each arc reads and writes one sign."""

    start: Hashable
    final: frozenset
    arcs: dict[tuple[Hashable, str], tuple[tuple[str, float, Hashable], ...]]

    @classmethod
    def of(cls, start: Hashable, final: Iterable[Hashable], arcs: Iterable[Arc]) -> Transducer:
        by: dict[tuple[Hashable, str], list] = {}
        for state, read, wrote, weight, target in arcs:
            by.setdefault((state, read), []).append((wrote, weight, target))
        return cls(start, frozenset(final), {key: tuple(found) for key, found in by.items()})

    def then(self, other: Transducer, signs: str) -> Transducer:
        """The composition: what this one writes, the other reads; weights add up. Its states are the pairs reached on ``signs``."""
        start = (self.start, other.start)
        arcs: list[Arc] = []
        seen, todo = {start}, [start]
        while todo:
            state = left, right = todo.pop()
            for sign in signs:
                for between, weight, next_left in self.arcs.get((left, sign), ()):
                    for wrote, more, next_right in other.arcs.get((right, between), ()):
                        target = (next_left, next_right)
                        arcs.append((state, sign, wrote, weight + more, target))
                        if target not in seen:
                            seen.add(target)
                            todo.append(target)
        return Transducer.of(start, (s for s in seen if s[0] in self.final and s[1] in other.final), arcs)

    def best(self, signs: str) -> float:
        """The greatest weight of a path that reads all of ``signs`` and ends in a final state; minus infinity without one."""
        front: dict[Hashable, float] = {self.start: 0.0}
        for sign in signs:
            ahead: dict[Hashable, float] = {}
            for state, weight in front.items():
                for _, more, target in self.arcs.get((state, sign), ()):
                    if weight + more > ahead.get(target, float("-inf")):
                        ahead[target] = weight + more
            front = ahead
        return max((weight for state, weight in front.items() if state in self.final), default=float("-inf"))
