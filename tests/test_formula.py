"""Formulas and diagrams against truth tables."""

from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from derivant.functions import wmc
from derivant.functions.formula import FALSE, TRUE, And, Diagrams, Not, Or, Variable, at_most_one, chance, of_proofs, sloped, truth
from derivant.functions.sentential import Sentences, Vtree, smaller

A, B, C, D = map(Variable, "abcd")
FORMULAS = [(A | ~B) & C, (A | ~B) & B, (A & B) | (~A & ~B), (A & B) | (B & C) | (C & D), A & ~A, A | ~A, TRUE & ~FALSE, Variable("a", False) | B]


def worlds(names):
    return [dict(zip(names, w, strict=True)) for w in product([False, True], repeat=len(names))]


@pytest.mark.parametrize("f", FORMULAS)
@pytest.mark.parametrize("order", ["abcd", "dcba", "bdac"])
def test_truth_tables(f, order):
    diagrams = Diagrams(order)
    root = diagrams.compile(f)
    for w in worlds("abcd"):
        assert diagrams.evaluate(root, truth(w)) == f.holds(w)
    assert diagrams.compile(Not(Not(f))) == root
    p = dict(zip("abcd", (0.1, 0.4, 0.7, 0.5), strict=True))
    total = 0.0
    for w in worlds("abcd"):
        weight = 1.0
        for v in "abcd":
            weight *= p[v] if w[v] else 1 - p[v]
        total += weight * f.holds(w)
    assert diagrams.evaluate(root, chance(p)) == pytest.approx(total)


def test_constants_and_collection():
    diagrams = Diagrams("abcd")
    assert diagrams.compile(A & ~A) == 0 and diagrams.compile(A | ~A) == 1
    keep = diagrams.compile(A & B)
    diagrams.compile((A & C) | D)
    assert diagrams.collect([keep]) > 0 and len(diagrams.nodes) == 2 and diagrams.collect([keep]) == 0
    assert diagrams.compile(A & B) == keep and "->" in diagrams.dot(keep)
    assert ((A | B) & A).variables() == ["a", "b"]


def test_at_most_one():
    f = at_most_one("abc")
    assert [sum(w.values()) <= 1 for w in worlds("abc")] == [f.holds(w) for w in worlds("abc")]


variables = st.sampled_from("abcd").map(Variable)
formulas = st.recursive(variables, lambda f: st.one_of(st.builds(And, f, f), st.builds(Or, f, f), st.builds(Not, f)), max_leaves=10)


@settings(max_examples=150, deadline=None)
@given(formulas)
def test_any_formula(f):
    diagrams = Diagrams("abcd")
    root = diagrams.compile(f)
    assert all(diagrams.evaluate(root, truth(w)) == f.holds(w) for w in worlds("abcd"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 4), max_size=3), max_size=5))
def test_counting_proofs(proofs):
    p = {i: 0.15 + 0.17 * i for i in range(5)}
    diagrams = Diagrams(range(5))
    root = diagrams.compile(of_proofs(proofs))
    assert diagrams.evaluate(root, chance(p)) == pytest.approx(wmc.count(proofs, p))
    both = diagrams.evaluate(root, sloped(p))
    assert both.value == pytest.approx(wmc.count(proofs, p))
    for f, g in wmc.gradient(proofs, p).items():
        assert both.slope.get(f, 0.0) == pytest.approx(g, abs=1e-9)


SHAPES = [Vtree.balanced, Vtree.left_linear, Vtree.right_linear]


@settings(max_examples=150, deadline=None)
@given(formulas, st.sampled_from(SHAPES), st.permutations("abcd"))
def test_any_formula_along_any_tree(f, shape, names):
    s = Sentences(shape(names))
    root = s.compile(f)
    assert all(s.evaluate(root, truth(w)) == f.holds(w) for w in worlds("abcd"))
    assert s.compile(Not(Not(f))) == root and s.compile(f & f) == root and s.compile(f | ~f) == 1 and s.compile(f & ~f) == 0
    p = dict(zip("abcd", (0.1, 0.4, 0.7, 0.5), strict=True))
    flat = Diagrams(names)
    assert s.evaluate(root, chance(p)) == pytest.approx(flat.evaluate(flat.compile(f), chance(p)))
    for a in s.reached([root]) & s.elements.keys():
        primes = [q for q, _ in s.elements[a]]
        assert all(s.apply("and", x, y) == 0 for i, x in enumerate(primes) for y in primes[:i])
        subs = [q for _, q in s.elements[a]]
        assert len(set(subs)) == len(subs) > 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 4), max_size=3), max_size=5), st.sampled_from(SHAPES))
def test_counting_proofs_along_trees(proofs, shape):
    p = {i: 0.15 + 0.17 * i for i in range(5)}
    s = Sentences(shape(range(5)))
    both = s.evaluate(s.compile(of_proofs(proofs)), sloped(p))
    assert both.value == pytest.approx(wmc.count(proofs, p))
    for f, g in wmc.gradient(proofs, p).items():
        assert both.slope.get(f, 0.0) == pytest.approx(g, abs=1e-9)


def test_trees():
    t = Vtree.right_linear("abcd")
    assert [shape("abcd").names() for shape in SHAPES] == [list("abcd")] * 3
    assert t.rotate_left().rotate_right() == t and t.swap().swap() == t and t.swap().names() == list("bcda")
    assert t.rotate_left() == Vtree(Vtree.balanced("ab"), Vtree.balanced("cd")) == Vtree.balanced("abcd")
    assert t.rotate_left().rotate_left() == Vtree.left_linear("abcd")
    assert len(set(t.neighbours())) == 5  # three swaps, two rotations
    for bad in (Vtree.leaf("a").swap, Vtree.left_linear("ab").rotate_left, Vtree.left_linear("ab").rotate_right):
        with pytest.raises(ValueError):
            bad()
    s = Sentences(Vtree.balanced("abcd"))
    a, b, c, d = (s.place[x] for x in "abcd")
    assert s.common(a, b) == s.common(b, a) != s.common(c, d) and s.common(a, a) == a
    assert s.common(a, d) == s.common(b, c) == s.common(s.common(a, b), c)
    assert t.dot().count("->") == 6


def test_nodes_along_trees_are_dropped():
    s = Sentences(Vtree.balanced("abcd"))
    keep = s.compile((A & B) | (C & D))
    value = s.evaluate(keep, chance(dict.fromkeys("abcd", 0.5)))
    s.compile((A & C) | (B & D))
    assert s.collect([keep]) > 0 and s.collect([keep]) == 0 and value == pytest.approx(1 - 0.75**2)
    assert s.compile((A & B) | (C & D)) == keep and s.evaluate(keep, chance(dict.fromkeys("abcd", 0.5))) == value
    assert "->" in s.dot(keep) and s.dot(0).count("false") == 1


def test_a_smaller_tree():
    """Pairs that are equal: apart in the tree they cost more than side by side."""
    x, y = [Variable(f"x{i}") for i in range(3)], [Variable(f"y{i}") for i in range(3)]
    f = TRUE
    for a, b in zip(x, y, strict=True):
        f = f & ((a & b) | (~a & ~b))
    apart = Vtree.right_linear([v.name for v in [*x, *y]])
    better = smaller(f, apart)
    size = lambda t: (lambda s: s.size(s.compile(f)))(Sentences(t))
    assert size(better) < size(apart) and sorted(better.names()) == sorted(apart.names())
