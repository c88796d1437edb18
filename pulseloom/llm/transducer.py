"""Small weighted finite-state transducers over token classes, with composition (weights add along a path)."""

from __future__ import annotations

from collections import deque


class Transducer:
    """Deterministic: arcs[state][label] = (output, weight, next state). State 0 is the start, every state may end."""

    def __init__(self, arcs: list[dict[str, tuple[str, float, int]]]):
        self.arcs = arcs

    @classmethod
    def grown(cls, start, labels, step):
        """The machine whose states are what ``step(state, label) -> (output, weight, next)`` reaches from ``start``."""
        number, arcs, todo = {start: 0}, [], deque([start])
        while todo:
            state, own = todo.popleft(), {}
            for label in labels:
                out, weight, then = step(state, label)
                if then not in number:
                    number[then] = len(number)
                    todo.append(then)
                own[label] = (out, weight, number[then])
            arcs.append(own)
        return cls(arcs)

    @property
    def outputs(self) -> list[str]:
        return sorted({out for own in self.arcs for out, _, _ in own.values()})

    def compose(self, other: Transducer) -> Transducer:
        """First this machine, then ``other`` over what it puts out."""

        def step(state, label):
            out, w, a = self.arcs[state[0]][label]
            out, v, b = other.arcs[state[1]][out]
            return out, w + v, (a, b)

        return Transducer.grown((0, 0), sorted(self.arcs[0]), step)

    def run(self, labels) -> list[tuple[str, float]]:
        state, out = 0, []
        for label in labels:
            x, weight, state = self.arcs[state][label]
            out.append((x, weight))
        return out
