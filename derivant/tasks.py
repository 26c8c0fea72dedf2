"""Programs over uncertain digits, for many tasks in one run.

digit(task, position, value) has one disjunction for each (task, position); a program
says what follows from k digits: their sum, the permutation that sorts them, or how
many of them equal the expected ones.
"""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import DataFrame

from .engine import Engine

_DECLS = "decl digit(Int, Int, Int). decl digits({ints}). decl result(Int, Int). digits(T, {names}) :- {atoms}.\n"


def _digits(k: int) -> tuple[list[str], str]:
    names = [f"D{i}" for i in range(k)]
    return names, _DECLS.format(ints=", ".join(["Int"] * (k + 1)), names=", ".join(names), atoms=", ".join(f"digit(T, {i}, {n})" for i, n in enumerate(names)))


def sum_program(k: int) -> str:
    names, text = _digits(k)
    return text + f"result(T, {' + '.join(names)}) :- digits(T, {', '.join(names)})."


def sort_program(k: int) -> str:
    """Result i: the i-th permutation, in lexicographic order, is the stable sort of the digits."""
    names, text = _digits(k)
    for i, p in enumerate(permutations(range(k))):
        order = ", ".join(f"D{a} {'<=' if a < b else '<'} D{b}" for a, b in zip(p, p[1:], strict=False))
        text += f"result(T, {i}) :- digits(T, {', '.join(names)}), {order}.\n"
    return text


def count_program(k: int) -> str:
    """Result i: i of the digits equal those of expected(task, ...)."""
    names, text = _digits(k)
    wanted = [f"G{i}" for i in range(k)]
    text = f"decl expected({', '.join(['Int'] * (k + 1))}). " + text
    for same in product([True, False], repeat=k):
        tests = ", ".join(f"{g} {'==' if s else '!='} {n}" for s, g, n in zip(same, wanted, names, strict=True))
        text += f"result(T, {sum(same)}) :- digits(T, {', '.join(names)}), expected(T, {', '.join(wanted)}), {tests}.\n"
    return text


def run(program: str, digits: DataFrame, expected: DataFrame | None = None, tag: str = "top-k-proofs", k: int = 3, gradient: bool = False) -> DataFrame:
    """(task, result, prob) and grad, if asked for, from digits(task, position, value, prob)."""
    engine = Engine(digits.sparkSession, tag, k).load(program)
    engine.insert_disjunction("digit", digits, "prob", ["task", "position"], ["task", "position", "value"])
    if expected is not None:
        engine.insert("expected", expected)
    read = engine.with_gradient if gradient else engine.with_prob
    return read("result", ["task", "result"])
