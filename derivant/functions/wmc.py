"""Weighted model counting of proofs.

A tag is a formula in disjunctive normal form over independent facts; its probability
is found by Shannon expansion on the most frequent fact, with absorption, a split into
independent parts and factors, and a memo. With exclusive=True the facts of a disjunction exclude
each other instead. Tags whose proofs share nothing need no expansion and stay in the
JVM.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from math import prod

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import weight

Dnf = frozenset  # of frozensets of facts


def _absorb(proofs: Iterable[frozenset]) -> Dnf:
    proofs = frozenset(proofs)
    if len(set(map(len, proofs))) < 2:  # none is part of another one
        return proofs
    kept: list[frozenset] = []
    for p in sorted(proofs, key=len):
        if not any(q <= p for q in kept):
            kept.append(p)
    return frozenset(kept)


def _parts(dnf: Dnf, group: Mapping) -> list[Dnf]:
    """Sets of proofs that share no group of facts."""
    out: list[tuple[set, list]] = []
    for p in dnf:
        names, mine = ({group.get(f, f) for f in p} if group else set(p)), [p]
        rest = []
        for other, proofs in out:
            if not names.isdisjoint(other):
                names |= other
                mine += proofs
            else:
                rest.append((other, proofs))
        out = [*rest, (names, mine)]
    return [frozenset(x[1]) for x in out]


def _factors(dnf: Dnf) -> list[Dnf]:
    """Formulas without common facts whose conjunction dnf is; facts of one group are in one of them."""
    beside: dict = {}
    for p in dnf:
        for f in p:
            beside[f] = beside[f] | p if f in beside else p
    left, sets = set(beside), []
    while left:  # facts that are never in one proof belong to one factor
        found, work = set(), [left.pop()]
        while work:
            f = work.pop()
            found.add(f)
            more = left - beside[f]
            left -= more
            work += more
        sets.append(found)
    if len(sets) > 1:
        factors = [frozenset(p & names for p in dnf) for names in sets]
        if prod(map(len, factors)) == len(dnf) and not any(frozenset() in x for x in factors):
            return factors
    return [dnf]


def _expanded(proofs: Iterable[Iterable], prob: Mapping, group: Mapping | None, slopes: bool) -> tuple[float, dict]:
    """The probability that some proof holds and, if asked for, its derivative by each fact's, in one pass."""
    group = group or {}
    memo: dict[Dnf, tuple[float, dict]] = {}

    def value(dnf: Dnf) -> tuple[float, dict]:
        if not dnf:
            return 0.0, {}
        if frozenset() in dnf:
            return 1.0, {}
        if len(dnf) == 1:
            return single(*dnf)
        if dnf not in memo:
            parts = _parts(dnf, group)
            if len(parts) > 1:
                memo[dnf] = apart([value(p) for p in parts])
            else:
                factors = _factors(dnf)
                memo[dnf] = together([value(p) for p in factors]) if len(factors) > 1 else expand(dnf)
        return memo[dnf]

    def single(proof: frozenset) -> tuple[float, dict]:
        return together([(prob[f], {f: 1.0}) for f in proof]) if slopes else (prod([prob[f] for f in proof]), {})

    def together(factors: list[tuple[float, dict]]) -> tuple[float, dict]:
        """Independent formulas, all of which hold."""
        slope = {}
        if slopes:
            for k, (_, mine) in enumerate(factors):
                rest = prod(v for i, (v, _) in enumerate(factors) if i != k)
                slope.update((f, rest * d) for f, d in mine.items())
        return prod(v for v, _ in factors), slope

    def apart(parts: list[tuple[float, dict]]) -> tuple[float, dict]:
        """Independent formulas, of which one at least holds."""
        after = [1.0]
        for v, _ in reversed(parts):
            after.append(after[-1] * (1 - v))
        slope, before = {}, 1.0
        for k, (v, mine) in enumerate(parts):
            rest = before * after[len(parts) - 1 - k]
            if slopes:
                slope.update((f, rest * d) for f, d in mine.items())
            before *= 1 - v
        return 1 - before, slope

    def expand(dnf: Dnf) -> tuple[float, dict]:
        often = Counter(group.get(f, f) for p in dnf for f in p)
        pick = min(often, key=lambda g: (-often[g], str(g)))
        facts = sorted({f for p in dnf for f in p if group.get(f, f) == pick}, key=str)
        without, slope = value(frozenset(p for p in dnf if not p.intersection(facts)))
        left = 1.0 - sum(prob[f] for f in facts)
        total, out = left * without, {}
        if slopes:
            out = {f: left * d for f, d in slope.items()}
        for f in facts:  # f holds, and with it none of the others
            others = set(facts) - {f}
            v, slope = value(_absorb(p - {f} for p in dnf if not p & others))
            total += prob[f] * v
            if slopes:
                out[f] = v - without
                for g, d in slope.items():
                    out[g] = out.get(g, 0.0) + prob[f] * d
        return total, out

    proofs = map(frozenset, proofs)
    if group:  # a proof of facts that exclude each other never holds
        proofs = (p for p in proofs if len({group.get(f, f) for f in p}) == len(p))
    return value(_absorb(proofs))


def count(proofs: Iterable[Iterable], prob: Mapping, group: Mapping | None = None) -> float:
    """The probability that some proof holds; group maps facts to groups that exclude each other."""
    return _expanded(proofs, prob, group, False)[0]


def count_and_gradient(proofs: Iterable[Iterable], prob: Mapping, group: Mapping | None = None) -> tuple[float, dict]:
    """Also the derivative by the probability of each fact of the proofs (of one that absorption removes: 0)."""
    proofs = [frozenset(p) for p in proofs]
    total, slope = _expanded(proofs, prob, group, True)
    return total, dict.fromkeys(sorted({f for p in proofs for f in p}, key=str), 0.0) | slope


def gradient(proofs: Iterable[Iterable], prob: Mapping, group: Mapping | None = None) -> dict:
    """The derivative of count by the probability of each fact."""
    return count_and_gradient(proofs, prob, group)[1]


def _unpacked(tags: pa.Array, exclusive: bool) -> Iterator[tuple[list, dict, dict | None] | None]:
    """Each tag's proofs, its facts' probabilities and, if asked for, their groups; None for a null."""
    proofs = tags.values
    facts = proofs.values
    first, start = tags.offsets.to_numpy().tolist(), proofs.offsets.to_numpy().tolist()
    names, prob, group = (facts.field(k).to_numpy(zero_copy_only=False).tolist() for k in ("f", "p", "d"))
    for i, there in enumerate(tags.is_valid().to_numpy(zero_copy_only=False).tolist()):
        if not there:
            yield None
            continue
        bounds = start[first[i] : first[i + 1] + 1]
        a, b = (bounds[0], bounds[-1]) if bounds else (0, 0)
        mine = names[a:b]
        yield [names[x:y] for x, y in zip(bounds, bounds[1:], strict=False)], dict(zip(mine, prob[a:b], strict=True)), dict(zip(mine, group[a:b], strict=True)) if exclusive else None


def _apart(tag: Column, exclusive: bool) -> Column:
    """The proofs share nothing, so they are independent."""
    names = F.flatten(F.transform(tag, lambda p: F.transform(p, lambda x: x["d" if exclusive else "f"])))
    return F.size(names) == F.size(F.array_distinct(names))


def _any(tag: Column) -> Column:
    """The probability that one of independent proofs holds."""
    return 1 - F.aggregate(tag, F.lit(1.0), lambda acc, p: acc * (1 - weight(p)))


def probability(tag: Column, exclusive: bool = False) -> Column:
    """The probability of a column of proofs; no proof: 0, the empty proof: 1."""

    @F.arrow_udf("double")
    def several(tags: pa.Array) -> pa.Array:
        out = []
        for t in _unpacked(tags, exclusive):
            if t is None:
                out.append(None)
            else:
                proofs, prob, group = t
                out.append(count(proofs, prob, group))
        return pa.array(out, pa.float64())

    # proofs that share nothing need no expansion, nor does a single one
    apart = _apart(tag, exclusive)
    return F.coalesce(F.when(F.size(tag) == 1, weight(tag[0])).when(apart, _any(tag)), several(F.when(~apart & (F.size(tag) > 1), tag)))


#: Up to so many proofs that share nothing, the gradient is made of products in the JVM.
JVM_PROOFS = 64
_BOTH = "struct<prob: double, grad: map<bigint, double>>"


def _others(values: Column, at: Column) -> Column:
    """The product of all values but one."""
    return F.aggregate(F.filter(values, lambda _, k: k != at), F.lit(1.0), lambda acc, v: acc * v)


def probability_and_gradient(tag: Column, exclusive: bool = False) -> Column:
    """struct<prob double, grad map<bigint, double>> of a column of proofs; grad's keys are facts."""

    @F.arrow_udf("prob double, grad map<bigint,double>")
    def both(tags: pa.Array) -> pa.Array:
        rows = []
        for t in _unpacked(tags, exclusive):
            if t is None:
                rows.append({"prob": None, "grad": None})
                continue
            proofs, prob, group = t
            total, slope = count_and_gradient(proofs, prob, group)
            rows.append({"prob": total, "grad": list(slope.items())})
        return pa.array(rows, pa.struct([("prob", pa.float64()), ("grad", pa.map_(pa.int64(), pa.float64()))]))

    apart = _apart(tag, exclusive) & (F.size(tag) <= JVM_PROOFS)
    miss = F.transform(tag, lambda p: 1 - weight(p))
    slope = F.transform(
        tag,
        lambda p, i: F.transform(p, lambda x, j: F.struct(x["f"].alias("key"), (_others(miss, i) * _others(F.transform(p, lambda y: y["p"]), j)).alias("value"))),
    )
    plain = F.struct(_any(tag).alias("prob"), F.map_from_entries(F.flatten(slope)).alias("grad")).cast(_BOTH)
    other = both(F.when(~apart, tag))
    return F.when(apart, plain).otherwise(F.struct(other["prob"].alias("prob"), other["grad"].alias("grad")).cast(_BOTH))
