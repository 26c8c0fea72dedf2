"""Sentential decision diagrams: diagrams along a tree of variables instead of an order.

A decision node belongs to an inner node of the tree. Its elements are pairs of a prime,
over the variables on the left, and a sub, over those on the right; the primes exclude
each other and one of them always holds. Nodes are kept compressed (no two subs are
equal) and trimmed, so a formula has exactly one node for a given tree. A tree that leans
to the right gives the ordered diagrams of ``formula``.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from .formula import And, Constant, Formula, Not, Semiring, Variable


@dataclass(frozen=True)
class Vtree:
    """A binary tree with a variable at each leaf; all operations give a new tree."""

    left: Vtree | None = None
    right: Vtree | None = None
    name: Hashable = None

    @staticmethod
    def leaf(name: Hashable) -> Vtree:
        return Vtree(name=name)

    @staticmethod
    def balanced(names: Sequence) -> Vtree:
        names = list(names)
        if len(names) == 1:
            return Vtree.leaf(names[0])
        half = len(names) // 2
        return Vtree(Vtree.balanced(names[:half]), Vtree.balanced(names[half:]))

    @staticmethod
    def right_linear(names: Sequence) -> Vtree:
        *before, last = names
        out = Vtree.leaf(last)
        for n in reversed(before):
            out = Vtree(Vtree.leaf(n), out)
        return out

    @staticmethod
    def left_linear(names: Sequence) -> Vtree:
        first, *others = names
        out = Vtree.leaf(first)
        for n in others:
            out = Vtree(out, Vtree.leaf(n))
        return out

    @property
    def is_leaf(self) -> bool:
        return self.left is None

    def names(self) -> list:
        """The variables from left to right."""
        return [self.name] if self.is_leaf else self.left.names() + self.right.names()

    def rotate_left(self) -> Vtree:
        """(a (b c)) becomes ((a b) c)."""
        if self.is_leaf or self.right.is_leaf:
            raise ValueError("the right child is a leaf")
        return Vtree(Vtree(self.left, self.right.left), self.right.right)

    def rotate_right(self) -> Vtree:
        """((a b) c) becomes (a (b c))."""
        if self.is_leaf or self.left.is_leaf:
            raise ValueError("the left child is a leaf")
        return Vtree(self.left.left, Vtree(self.left.right, self.right))

    def swap(self) -> Vtree:
        if self.is_leaf:
            raise ValueError("a leaf has no children")
        return Vtree(self.right, self.left)

    def neighbours(self) -> Iterator[Vtree]:
        """All trees that are one rotation or swap, at any node, away."""
        if self.is_leaf:
            return
        yield self.swap()
        if not self.right.is_leaf:
            yield self.rotate_left()
        if not self.left.is_leaf:
            yield self.rotate_right()
        for other in self.left.neighbours():
            yield Vtree(other, self.right)
        for other in self.right.neighbours():
            yield Vtree(self.left, other)

    def dot(self) -> str:
        lines: list[str] = []

        def walk(t: Vtree) -> int:
            number = len(lines)
            lines.append("")
            if t.is_leaf:
                lines[number] = f'{number} [label="{t.name}", shape=plaintext];'
            else:
                a, b = walk(t.left), walk(t.right)
                lines[number] = f"{number} [shape=point]; {number} -> {a}; {number} -> {b};"
            return number

        walk(self)
        return "\n".join(["digraph {", *lines, "}"])


class Sentences:
    """Diagrams over one tree; nodes 0 and 1 are the constants."""

    def __init__(self, tree: Vtree) -> None:
        self.tree = tree
        # places of the tree in order from left to right: a subtree is an interval
        self.first: list[int] = []
        self.last: list[int] = []
        self.above: list[int] = []
        self.place: dict[Hashable, int] = {}
        self._number(tree)
        self.where: dict[int, int] = {}
        self.elements: dict[int, tuple[tuple[int, int], ...]] = {}
        self.literals: dict[int, tuple[Hashable, bool]] = {}
        self.unique: dict[tuple, int] = {}
        self.cache: dict[tuple, int] = {}
        self.next = 2

    def _number(self, tree: Vtree) -> int:
        start = len(self.first)
        left = None if tree.is_leaf else self._number(tree.left)
        here = len(self.first)
        self.first.append(start)
        self.last.append(here)
        self.above.append(-1)
        if left is None:
            self.place[tree.name] = here
        else:
            right = self._number(tree.right)
            self.last[here] = self.last[right]
            self.above[left] = self.above[right] = here
        return here

    def common(self, u: int, v: int) -> int:
        """The lowest place above both, or one of them if it is above the other."""
        while not self.first[u] <= v <= self.last[u]:
            u = self.above[u]
        return u

    def _new(self, key: tuple, place: int) -> int:
        if key not in self.unique:
            self.unique[key], self.where[self.next] = self.next, place
            self.next += 1
        return self.unique[key]

    def literal(self, name: Hashable, positive: bool = True) -> int:
        node = self._new((self.place[name], positive), self.place[name])
        self.literals[node] = name, positive
        return node

    def decision(self, place: int, pairs: Iterable[tuple[int, int]]) -> int:
        """The node of primes and subs; the primes are exclusive and exhaustive."""
        primes: dict[int, int] = {}
        for prime, sub in pairs:
            if prime:
                primes[sub] = self.apply("or", primes[sub], prime) if sub in primes else prime
        if len(primes) == 1:
            return next(iter(primes))
        if primes.keys() == {0, 1}:
            return primes[1]
        elements = tuple(sorted((p, s) for s, p in primes.items()))
        node = self._new((place, elements), place)
        self.elements[node] = elements
        return node

    def negate(self, a: int) -> int:
        if a < 2:
            return 1 - a
        if a in self.literals:
            name, positive = self.literals[a]
            return self.literal(name, not positive)
        key = ("not", a)
        if key not in self.cache:
            self.cache[key] = self.decision(self.where[a], [(p, self.negate(s)) for p, s in self.elements[a]])
        return self.cache[key]

    def _at(self, a: int, place: int) -> Sequence[tuple[int, int]]:
        """The elements of a node as one of a place that is its own or above it."""
        if self.where[a] == place:
            return self.elements[a]
        return ((a, 1), (self.negate(a), 0)) if self.where[a] < place else ((1, a),)

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
            if a in self.literals and self.where[a] == self.where[b]:
                self.cache[key] = absorbing  # a variable and its negation
            else:
                place = self.common(self.where[a], self.where[b])
                other = self._at(b, place)
                pairs = [(self.apply("and", p, q), s, r) for p, s in self._at(a, place) for q, r in other]
                self.cache[key] = self.decision(place, [(p, self.apply(op, s, r)) for p, s, r in pairs if p])
        return self.cache[key]

    def compile(self, f: Formula) -> int:
        if isinstance(f, Constant):
            return int(f.value)
        if isinstance(f, Variable):
            return self.literal(f.name, f.positive)
        if isinstance(f, Not):
            return self.negate(self.compile(f.arg))
        return self.apply("and" if isinstance(f, And) else "or", self.compile(f.left), self.compile(f.right))

    def evaluate(self, root: int, s: Semiring):
        """The weighted count; a variable that is skipped counts as add(literal, its negation) = one."""
        memo = {0: s.zero, 1: s.one}

        def value(a: int):
            if a not in memo:
                if a in self.literals:
                    memo[a] = s.literal(*self.literals[a])
                else:
                    total = s.zero
                    for prime, sub in self.elements[a]:
                        total = s.add(total, s.mult(value(prime), value(sub)))
                    memo[a] = total
            return memo[a]

        return value(root)

    def reached(self, roots: Iterable[int]) -> set[int]:
        seen, todo = set(), [r for r in roots if r > 1]
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                todo += [x for pair in self.elements.get(a, ()) for x in pair if x > 1]
        return seen

    def size(self, root: int) -> int:
        """The number of elements of all decisions below a node."""
        return sum(len(self.elements.get(a, ())) for a in self.reached([root]))

    def collect(self, roots: Iterable[int]) -> int:
        """Drops all nodes that no root reaches, and says how many."""
        stay = self.reached(roots)
        gone = set(self.where) - stay
        for a in gone:
            del self.where[a]
            self.elements.pop(a, None)
            self.literals.pop(a, None)
        self.unique = {k: a for k, a in self.unique.items() if a in stay}
        self.cache.clear()
        return len(gone)

    def dot(self, root: int) -> str:
        def text(a: int) -> str:
            if a in self.literals:
                name, positive = self.literals[a]
                return f"{'' if positive else '~'}{name}"
            return ("false", "true")[a] if a < 2 else f"#{a}"

        lines = ["digraph {", f'root [label="{text(root)}"];']
        for a in sorted(self.reached([root]) & self.elements.keys()):
            lines.append(f'{a} [label="#{a}", shape=circle];')
            for k, (prime, sub) in enumerate(self.elements[a]):
                lines.append(f'e{a}_{k} [label="{text(prime)} | {text(sub)}", shape=box]; {a} -> e{a}_{k};')
                lines += [f"e{a}_{k} -> {x};" for x in (prime, sub) if x in self.elements]
        return "\n".join([*lines, "}"])


def smaller(f: Formula, tree: Vtree, steps: int = 20) -> Vtree:
    """A tree for which the diagram of f is no larger: steepest descent over rotations and swaps."""

    def size(t: Vtree) -> int:
        s = Sentences(t)
        return s.size(s.compile(f))

    best = size(tree)
    for _ in range(steps):
        found = min(((size(t), k, t) for k, t in enumerate(tree.neighbours())), default=None, key=lambda x: x[:2])
        if found is None or found[0] >= best:
            break
        best, _, tree = found
    return tree
