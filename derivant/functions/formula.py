"""Boolean formulas and ordered decision diagrams of them.

Formulas are built with & | ~ from variables. A Diagrams object compiles them to
reduced ordered diagrams with an apply cache and evaluates those in any semiring: truth
values, probabilities, probabilities with gradients.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field


class Formula:
    def __and__(self, other: Formula) -> Formula:
        return And(self, other)

    def __or__(self, other: Formula) -> Formula:
        return Or(self, other)

    def __invert__(self) -> Formula:
        return Not(self)

    def variables(self) -> list:
        """In the order in which they first occur."""
        raise NotImplementedError

    def holds(self, world: Mapping) -> bool:
        raise NotImplementedError


@dataclass(frozen=True)
class Constant(Formula):
    value: bool

    def variables(self) -> list:
        return []

    def holds(self, world: Mapping) -> bool:
        return self.value


@dataclass(frozen=True)
class Variable(Formula):
    name: Hashable
    positive: bool = True

    def variables(self) -> list:
        return [self.name]

    def holds(self, world: Mapping) -> bool:
        return bool(world[self.name]) == self.positive


@dataclass(frozen=True)
class Not(Formula):
    arg: Formula

    def variables(self) -> list:
        return self.arg.variables()

    def holds(self, world: Mapping) -> bool:
        return not self.arg.holds(world)


@dataclass(frozen=True)
class And(Formula):
    left: Formula
    right: Formula

    def variables(self) -> list:
        return list(dict.fromkeys(self.left.variables() + self.right.variables()))

    def holds(self, world: Mapping) -> bool:
        return self.left.holds(world) and self.right.holds(world)


@dataclass(frozen=True)
class Or(Formula):
    left: Formula
    right: Formula

    def variables(self) -> list:
        return list(dict.fromkeys(self.left.variables() + self.right.variables()))

    def holds(self, world: Mapping) -> bool:
        return self.left.holds(world) or self.right.holds(world)


TRUE, FALSE = Constant(True), Constant(False)


def of_proofs(proofs: Iterable[Iterable]) -> Formula:
    """Some proof holds, that is, all of its facts do."""
    out: Formula = FALSE
    for p in proofs:
        every: Formula = TRUE
        for f in sorted(p, key=str):
            every = every & Variable(f)
        out = out | every
    return out


def at_most_one(names: Sequence) -> Formula:
    """No two of the facts hold."""
    out: Formula = TRUE
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out = out & ~(Variable(a) & Variable(b))
    return out


@dataclass(frozen=True)
class Semiring:
    """zero, one, add, mult, and what a variable and its negation are worth."""

    zero: object
    one: object
    add: Callable
    mult: Callable
    literal: Callable[[Hashable, bool], object]


def truth(world: Mapping) -> Semiring:
    return Semiring(False, True, lambda a, b: a or b, lambda a, b: a and b, lambda v, s: bool(world[v]) == s)


def chance(prob: Mapping) -> Semiring:
    return Semiring(0.0, 1.0, lambda a, b: a + b, lambda a, b: a * b, lambda v, s: prob[v] if s else 1 - prob[v])


@dataclass(frozen=True)
class Dual:
    """A number and its derivatives by some variables."""

    value: float
    slope: Mapping = field(default_factory=dict)

    def __add__(self, other: Dual) -> Dual:
        keys = {*self.slope, *other.slope}
        return Dual(self.value + other.value, {k: self.slope.get(k, 0.0) + other.slope.get(k, 0.0) for k in keys})

    def __mul__(self, other: Dual) -> Dual:
        keys = {*self.slope, *other.slope}
        return Dual(self.value * other.value, {k: self.slope.get(k, 0.0) * other.value + other.slope.get(k, 0.0) * self.value for k in keys})

    def complement(self) -> Dual:
        return Dual(1 - self.value, {k: -v for k, v in self.slope.items()})


def sloped(prob: Mapping) -> Semiring:
    def literal(v: Hashable, positive: bool) -> Dual:
        d = Dual(prob[v], {v: 1.0})
        return d if positive else d.complement()

    return Semiring(Dual(0.0), Dual(1.0), lambda a, b: a + b, lambda a, b: a * b, literal)


class Diagrams:
    """Reduced ordered decision diagrams over a fixed order of variables; nodes 0 and 1 are the constants."""

    def __init__(self, order: Sequence) -> None:
        self.order = list(order)
        self.level = {v: i for i, v in enumerate(self.order)}
        self.nodes: dict[int, tuple[int, int, int]] = {}
        self.unique: dict[tuple[int, int, int], int] = {}
        self.cache: dict[tuple, int] = {}
        self.next = 2

    def node(self, level: int, low: int, high: int) -> int:
        if low == high:
            return low
        key = (level, low, high)
        if key not in self.unique:
            self.unique[key], self.nodes[self.next] = self.next, key
            self.next += 1
        return self.unique[key]

    def compile(self, f: Formula) -> int:
        if isinstance(f, Constant):
            return int(f.value)
        if isinstance(f, Variable):
            return self.node(self.level[f.name], *((0, 1) if f.positive else (1, 0)))
        if isinstance(f, Not):
            return self.negate(self.compile(f.arg))
        return self.apply("and" if isinstance(f, And) else "or", self.compile(f.left), self.compile(f.right))

    def negate(self, a: int) -> int:
        if a < 2:
            return 1 - a
        key = ("not", a)
        if key not in self.cache:
            level, low, high = self.nodes[a]
            self.cache[key] = self.node(level, self.negate(low), self.negate(high))
        return self.cache[key]

    def apply(self, op: str, a: int, b: int) -> int:
        absorbing = int(op == "or")
        if absorbing in (a, b):
            return absorbing
        if a < 2 or a == b:
            return b
        if b < 2:
            return a
        key = (op, min(a, b), max(a, b))
        if key not in self.cache:
            (la, a0, a1), (lb, b0, b1) = self.nodes[a], self.nodes[b]
            level = min(la, lb)
            if la > level:
                a0 = a1 = a
            if lb > level:
                b0 = b1 = b
            self.cache[key] = self.node(level, self.apply(op, a0, b0), self.apply(op, a1, b1))
        return self.cache[key]

    def evaluate(self, root: int, s: Semiring):
        """The weighted count of a diagram; a variable that is skipped counts as add(literal, its negation) = one."""
        memo = {0: s.zero, 1: s.one}

        def value(a: int):
            if a not in memo:
                level, low, high = self.nodes[a]
                v = self.order[level]
                memo[a] = s.add(s.mult(s.literal(v, False), value(low)), s.mult(s.literal(v, True), value(high)))
            return memo[a]

        return value(root)

    def collect(self, roots: Iterable[int]) -> int:
        """Drops all nodes that no root reaches, and says how many."""
        seen, todo = set(), [r for r in roots if r > 1]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += [x for x in self.nodes[a][1:] if x > 1]
        gone = set(self.nodes) - seen
        for a in gone:
            del self.unique[self.nodes.pop(a)]
        self.cache.clear()
        return len(gone)

    def dot(self, root: int) -> str:
        lines, seen, todo = ["digraph {", "0 [shape=box]; 1 [shape=box];"], set(), [root]
        while todo:
            a = todo.pop()
            if a > 1 and a not in seen:
                seen.add(a)
                level, low, high = self.nodes[a]
                lines.append(f'{a} [label="{self.order[level]}"]; {a} -> {low} [style=dashed]; {a} -> {high};')
                todo += [low, high]
        return "\n".join([*lines, "}"])
