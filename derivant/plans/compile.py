"""A rule as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import TAG, Unit, lead
from ..sources.relations import NULLARY, SQL_TYPES, keys
from .syntax import Atom, Binary, Const, Expr, Rule, Unary, Var, variables

_OPS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.call_function("div", a, b),  # truncates toward zero
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "&&": lambda a, b: a & b,
    "||": lambda a, b: a | b,
}


#: Frames with proofs that the optimiser takes for larger than so many bytes are not broadcast.
BROADCAST_PROOFS = 64 * 1024


def column_name(var: str) -> str:
    return f"v_{var}"


def literal(c: Const) -> Column:
    return F.lit(c.value).cast({"Int": "bigint", "Bool": "boolean", "String": "string"}[c.kind])


def expression(e: Expr) -> Column:
    if isinstance(e, Const):
        return literal(e)
    if isinstance(e, Var):
        return F.col(column_name(e.name))
    if isinstance(e, Unary):
        arg = expression(e.arg)
        return ~arg if e.op == "!" else -arg if e.op == "-" else arg
    if isinstance(e, Binary):
        return _OPS[e.op](expression(e.left), expression(e.right))
    raise TypeError(e)


def _names(e: Expr) -> set[str]:
    return {v.name for v in variables(e)}


def _atom_vars(a: Atom) -> list[str]:
    return list(dict.fromkeys(x.name for x in a.args if isinstance(x, Var)))


def atom_frame(atom: Atom, df: DataFrame, tag_as: str | None) -> DataFrame:
    """The atom's variables as columns; constants and repeated variables become filters."""
    first: dict[str, str] = {}
    for i, a in enumerate(atom.args):
        c = f"c{i}"
        if isinstance(a, Const):
            df = df.where(F.col(c) == literal(a))
        elif isinstance(a, Var):
            if a.name in first:
                df = df.where(F.col(c) == F.col(first[a.name]))
            else:
                first[a.name] = c
    columns = [F.col(c).alias(column_name(v)) for v, c in first.items()] or [F.lit(0).cast("bigint").alias(NULLARY)]
    return df.select(*columns, *([F.col(TAG).alias(tag_as)] if tag_as else []))


def _unknown_size(df: DataFrame) -> bool:
    """The optimiser counts a proof as one fact and what explode makes as its input, so small frames are the only ones it knows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_PROOFS


def _by_groups(left: DataFrame, right: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """left and right joined, without the pairs whose facts exclude each other.

    Pairs of different groups are made by pairs of groups, each of which has one at least;
    within a group only proofs with an equal fact can hold together. So the work is in
    proportion to what is joined and derived, however many tuples have one key.
    """
    left = left.select("*", lead(F.col(TAG), "d").isNull().alias("_free"), F.coalesce(lead(F.col(TAG), "d"), F.lit(0)).alias("_d"))
    right = right.select("*", lead(F.col(name), "d").isNull().alias("_free2"), F.coalesce(lead(F.col(name), "d"), F.lit(0)).alias("_d2"))
    mine, theirs = ["_free", "_d"], ["_free2", "_d2"]
    pairs = left.select(*on, *mine).distinct().join(right.select(*on, *theirs).distinct(), on).where("_free or _free2 or _d != _d2")
    apart = left.join(pairs.hint("shuffle_merge"), [*on, *mine]).join(right.hint("shuffle_merge"), [*on, *theirs]).drop(*mine, *theirs)
    same = left.where("not _free").withColumn("_f", F.explode(lead(F.col(TAG), "f"))).drop("_free")
    other = right.where("not _free2").withColumn("_f", F.explode(lead(F.col(name), "f"))).drop("_free2").withColumnRenamed("_d2", "_d")
    return apart.unionByName(same.join(other.hint("shuffle_merge"), [*on, "_d", "_f"]).drop("_d", "_f"))


def rule_frame(spark: SparkSession, rule: Rule, frames: Sequence[DataFrame], negated: Sequence[DataFrame], tag: Unit, tagged: Sequence[bool], head_tag: Unit, head_types: Sequence[str], exclude: Callable[[Atom, Atom], bool] = lambda a, b: False) -> DataFrame:
    """The head's tuples (with duplicates) from a frame for each positive and each negated atom.

    Atoms are joined in textual order, except that an atom that shares a variable with
    what is joined already goes before one that shares none, so a product is made only
    where the rule asks for one. Semi-joins are used where an atom adds neither a
    variable that is needed later nor a tag. exclude tells whether the proofs of two
    atoms may hold facts that exclude each other.
    """
    atoms, constraints = rule.atoms(), rule.constraints()
    needs_tags = tag.column_type is not None and head_tag.column_type is not None
    gates = [i for i, a in enumerate(atoms) if not _atom_vars(a)]
    rest = [i for i, a in enumerate(atoms) if _atom_vars(a)]
    late = set().union(*(_names(a) for a in rule.head.args), *(_names(a) for x in rule.negated() for a in x.args), set())
    open_ = list(constraints)
    df: DataFrame | None = None
    known: set[str] = set()
    has_tag = False
    joined: list[Atom] = []

    def tag_of(i: int) -> str | None:
        return f"_t{i}" if needs_tags and tagged[i] else None

    def combine(joined: DataFrame, name: str | None) -> DataFrame:
        nonlocal has_tag
        if name is None:
            return joined
        joined = joined.withColumn(TAG, tag.mult(F.col(TAG), F.col(name)) if has_tag else F.col(name)).drop(name)
        has_tag = True
        return joined

    while rest:
        i = next((k for k in rest if known & set(_atom_vars(atoms[k]))), rest[0])
        rest.remove(i)
        mine, name = set(_atom_vars(atoms[i])), tag_of(i)
        after = late | set().union(*(_names(e) for e in open_), *(set(_atom_vars(atoms[k])) for k in rest), set())
        right = atom_frame(atoms[i], frames[i], name)
        if df is None:
            df = combine(right, name)
        else:
            shared = sorted(known & mine)
            on = [column_name(v) for v in shared]
            if shared and name is None and not (mine - known) & after:
                df, mine = df.join(right.select(*on), on, "left_semi"), set()
            elif shared:
                proofs = name is not None and has_tag and tag.keeps_proofs
                if proofs and any(exclude(a, atoms[i]) for a in joined):
                    df = _by_groups(df, right, on, name)
                elif proofs and _unknown_size(right) and _unknown_size(df):
                    df = df.join(right.hint("shuffle_merge"), on)
                else:
                    df = df.join(right, on)
                df = combine(df, name)
            else:
                df = combine(df.crossJoin(right), name)
        joined.append(atoms[i])
        known |= mine
        for e in [e for e in open_ if _names(e) <= known]:
            df = df.where(expression(e))
            open_.remove(e)
        after = late | set().union(*(_names(e) for e in open_), *(set(_atom_vars(atoms[k])) for k in rest), set())
        known &= after
        df = df.select(*([column_name(v) for v in sorted(known)] or [F.lit(0).cast("bigint").alias(NULLARY)]), *([TAG] if has_tag else []))
    if df is None:
        df = spark.range(1).select(F.lit(0).cast("bigint").alias(NULLARY))
    for e in open_:
        df = df.where(expression(e))
    for i in gates:  # one row at most, or none
        name = tag_of(i)
        gate = atom_frame(atoms[i], frames[i], name)
        if name is None:
            gate = gate.limit(1).select(F.lit(0).alias("_gate"))
        else:
            gate = tag.merge(gate.withColumnRenamed(name, TAG), [NULLARY]).select(F.col(TAG).alias(name), F.lit(0).alias("_gate"))
        df = combine(df.crossJoin(F.broadcast(gate)), name).drop("_gate")
    for atom, frame in zip(rule.negated(), negated, strict=True):
        names = [column_name(v) for v in _atom_vars(atom)]
        right = atom_frame(atom, frame, None)
        if names:
            df = df.join(right.distinct(), names, "left_anti")
        else:
            df = df.join(F.broadcast(right.limit(1).select(F.lit(0).alias("_gate"))), F.lit(True), "left_anti")
    head = [expression(a).cast(SQL_TYPES[t]).alias(c) for a, t, c in zip(rule.head.args, head_types, keys(head_types), strict=False)] or [F.lit(0).cast("bigint").alias(NULLARY)]
    if head_tag.column_type is not None:
        head.append((F.col(TAG) if has_tag else head_tag.one()).alias(TAG))
    return df.select(*head)
