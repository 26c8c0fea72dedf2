"""Bottom-up evaluation: strata in order, each recursive one by semi-naive rounds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from math import prod
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IterationLimit
from ..functions.tags import TAG, Unit
from ..sources.relations import empty, keys
from ..sources.storage import Parts, stored
from . import core
from .analysis import strata
from .compile import rule_frame
from .syntax import Atom, Const, Rule


@dataclass
class Round:
    """What one round of a stratum did."""

    stratum: tuple[str, ...]
    number: int
    seconds: float
    changed: dict[str, int]


#: A relation of so many rows at most is broadcast to a plan that is made over a core.
BROADCAST_ROWS = 1_000_000


@dataclass
class Evaluation:
    """One run: what is new is taken in, stratum by stratum.

    A stratum without recursion that is evaluated for the first time stays a plan. What a
    recursive stratum reads and derives, and all that a later run reads or changes, is kept
    as a few tables in shared storage (``Parts``): a run writes what it adds, and plans do
    not grow with the number of runs or rounds.
    """

    spark: SparkSession
    types: Mapping[str, Sequence[str]]
    tag_of: Callable[[str], Unit]
    tag: Unit
    max_iterations: int = 10_000
    #: The relations that are kept as tables; goes on to the next run.
    parts: dict[str, Parts] = field(default_factory=dict)
    rounds: list[Round] = field(default_factory=list)
    #: Relations with disjunctions, and the columns that make each one's groups, if they do.
    groups: Mapping[str, Sequence[Sequence[int] | None]] = field(default_factory=dict)
    #: The relations with disjunctions that a relation's proofs may use.
    uses: dict[str, set[str]] = field(default_factory=dict)

    def empty(self, p: str) -> DataFrame:
        return empty(self.spark, self.types[p], self.tag_of(p))

    def merge(self, p: str, frames: Sequence[DataFrame]) -> DataFrame:
        return self.tag_of(p).merge(reduce(DataFrame.unionByName, frames), keys(self.types[p]))

    def grow(self, p: str, fresh: DataFrame) -> tuple[DataFrame | None, int]:
        """Adds fresh to a relation; (what is new or has another tag, if anything is; how many)."""
        names, tag = keys(self.types[p]), self.tag_of(p)
        held = self.parts.setdefault(p, Parts(names, tag.keeps_proofs))
        diff = stored(tag.added(held.frame(), fresh, names) if held.tables else fresh, "delta")
        if not diff.rows:
            diff.delete()
            return None, 0
        held.add(diff)
        return diff.frame, diff.rows

    def trace(self, rules: Mapping[int, Rule]) -> None:
        self.uses = {p: {p} for p in self.groups}
        grown = bool(self.uses)
        while grown:
            grown = False
            for r in rules.values():
                mine = self.uses.setdefault(r.head.predicate, set())
                before = len(mine)
                mine.update(*(self.uses.get(a.predicate, ()) for a in r.atoms()))
                grown |= len(mine) > before

    def exclude(self, a: Atom, b: Atom) -> bool:
        """Facts of the two may exclude each other; not if every disjunction has a column where they are known to differ."""
        both = self.uses.get(a.predicate, set()) & self.uses.get(b.predicate, set())
        if not both or a.predicate != b.predicate or both != {a.predicate}:
            return bool(both)
        differ = {i for i, (x, y) in enumerate(zip(a.args, b.args, strict=True)) if isinstance(x, Const) and isinstance(y, Const) and x.value != y.value}
        return not all(g and differ.intersection(g) for g in self.groups[a.predicate])

    def plan(self, rule: Rule, frame: Callable[[int, str], DataFrame], full: Callable[[str], DataFrame]) -> DataFrame:
        atoms = rule.atoms()
        head = rule.head.predicate
        tagged = [self.tag_of(a.predicate).column_type is not None for a in atoms]
        return rule_frame(self.spark, rule, [frame(i, a.predicate) for i, a in enumerate(atoms)], [full(a.predicate) for a in rule.negated()], self.tag, tagged, self.tag_of(head), self.types[head], self.exclude)

    def deltas(self, rule: Rule, changed: Mapping[str, DataFrame], new: Callable[[str], DataFrame], old: Callable[[str], DataFrame | None]) -> list[DataFrame]:
        """The derivations that use a changed tuple: changed at one position, new before it, old after it."""
        out = []
        for i, a in enumerate(rule.atoms()):
            if a.predicate not in changed:
                continue
            later = [b.predicate for b in rule.atoms()[i + 1 :] if b.predicate in changed]
            if any(old(p) is None for p in later):
                continue

            def frame(k: int, p: str, i=i) -> DataFrame:
                return changed[p] if k == i else old(p) if k > i and p in changed else new(p)

            out.append(self.plan(rule, frame, new))
        return out

    def table(self, p: str, now: dict[str, DataFrame]) -> int:
        """Makes a table of a relation that is read again and again; its number of rows."""
        if p not in self.parts:
            self.parts[p] = Parts(keys(self.types[p]), self.tag_of(p).keeps_proofs, tables=[stored(now[p], p.strip("@_"))])
            now[p] = self.parts[p].frame()
        return sum(t.rows for t in self.parts[p].tables)

    def lean(self, p: str, rules: Mapping[int, Rule], given: Sequence[DataFrame], now: dict[str, DataFrame]) -> DataFrame | None:
        """A recursive relation as a plan over its core, if that has fewer tuples than what the rules read; else None."""
        if p.endswith(core.core_name("")):
            return None
        recursive = [r for r in rules.values() if any(a.predicate == p for a in r.atoms())]
        ordered = [*(r for r in rules.values() if r not in recursive), *recursive]
        read = sorted({a.predicate for r in ordered for a in r.atoms()} - {p})
        found = core.occurrences(p, recursive)
        if not found or given or core.occurrences(p, ordered) is None or any(q not in now for q in read):
            return None
        sizes = {q: self.table(q, now) for q in read}
        distinct: dict[tuple[str, int], int] = {}
        for q in read:
            counts = now[q].agg(*[F.approx_count_distinct(c) for c in keys(self.types[q])]).first()
            distinct |= {(q, i): n for i, n in enumerate(counts)}
        needs = [tuple(min(columns, key=distinct.__getitem__) for columns in o) for o in found]
        most = sum(prod(distinct[c] for c in o) for o in set(needs))
        if most > sum(sizes.values()):
            return None
        name = core.core_name(p)
        inside = Evaluation(self.spark, {**self.types, name: self.types[p]}, self.tag_of, self.tag, self.max_iterations, {q: self.parts[q] for q in read})
        full = {q: now[q] for q in read}
        for q, i in sorted({c for o in needs for c in o}):
            need = core.need_name(p, (q, i))
            inside.types = {**inside.types, need: [self.types[q][i]]}
            self.parts[need] = inside.parts[need] = Parts(["c0"], False, tables=[stored(now[q].select(F.col(f"c{i}").alias("c0")).distinct(), "need")])
            full[need] = inside.parts[need].frame()
        program = dict(enumerate(core.core_rules(p, ordered, needs)))
        full = inside.run(program, set(program), full, {})
        self.rounds += inside.rounds
        if name in inside.parts:
            self.parts[name] = inside.parts[name]
        unique = core.apart(ordered, self.keys_of(read, sizes, distinct, now))

        def frame(k: int, q: str) -> DataFrame:
            df = full[name] if q == p else now[q]
            if unique is not None and k == 0:
                return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *keys(self.types[q]))
            return F.broadcast(df) if q == p or sizes[q] <= BROADCAST_ROWS else df

        frames = [inside.plan(core.inner(p, r), lambda k, q: frame(k, p if q == name else q), now.__getitem__) for r in (ordered if unique is None else unique)]
        return self.merge(p, frames) if unique is None else reduce(DataFrame.unionByName, frames)

    def keys_of(self, read: Sequence[str], sizes: Mapping[str, int], distinct: Mapping[tuple[str, int], int], now: Mapping[str, DataFrame]) -> dict[str, set[int]]:
        """The columns whose values are all different, counted exactly where they may be."""
        found: dict[str, set[int]] = {}
        for (q, i), n in distinct.items():
            if n >= 0.8 * sizes[q] and now[q].groupBy(f"c{i}").count().where("count > 1").isEmpty():
                found.setdefault(q, set()).add(i)
        return found

    def run(self, rules: Mapping[int, Rule], fresh_rules: set[int], full: Mapping[str, DataFrame], pending: Mapping[str, Sequence[DataFrame]]) -> dict[str, DataFrame]:
        """All relations after the pending tuples and the fresh rules are taken in."""
        self.trace(rules)
        before, now = dict(full), dict(full)
        changed: dict[str, DataFrame] = {}

        def solid(p: str) -> None:
            """A relation of an earlier run that is read or changed now becomes a table, once."""
            if p in before and p not in self.parts:
                self.parts[p] = Parts(keys(self.types[p]), self.tag_of(p).keeps_proofs, tables=[stored(before[p], p.strip("@_"))])
                before[p] = now[p] = self.parts[p].frame()

        def all_of(p: str) -> DataFrame:
            solid(p)
            return now[p] if p in now else self.empty(p)

        def old_of(p: str) -> DataFrame | None:
            solid(p)
            return before.get(p)

        for group, recursive in strata(rules.values(), [*self.types, *pending]):
            incoming: dict[str, list[DataFrame]] = {p: list(pending.get(p, ())) for p in group}
            mine = {k: r for k, r in rules.items() if r.head.predicate in incoming}
            for k, r in mine.items():
                if k not in fresh_rules:
                    incoming[r.head.predicate] += self.deltas(r, changed, all_of, old_of)
                elif all(a.predicate in now or a.predicate not in incoming for a in r.atoms()):
                    incoming[r.head.predicate].append(self.plan(r, lambda _, p: all_of(p), all_of))
            if recursive and self.tag.column_type is None and len(group) == 1 and group[0] not in before and set(mine) <= fresh_rules:
                p = group[0]
                plan = self.lean(p, mine, pending.get(p, ()), now)
                if plan is not None:
                    now[p] = changed[p] = plan
                    continue
            step: dict[str, DataFrame] = {}
            for p, frames in incoming.items():
                if not frames:
                    continue
                ones = [r for r in mine.values() if r.head.predicate == p]
                if len(frames) == len(ones) == 1 and not pending.get(p) and not recursive and p not in before and self.tag_of(p).column_type is None and core.once(ones[0]):
                    fresh = frames[0]
                else:
                    fresh = self.merge(p, frames)
                if recursive or p in before:
                    solid(p)
                    diff, _ = self.grow(p, fresh)
                    if diff is not None:
                        now[p], step[p] = self.parts[p].frame(), diff
                else:
                    now[p] = step[p] = fresh
            news = {p: [df] for p, df in step.items()}
            if recursive:
                self._rounds(group, mine, now, {p: old_of(p) for p in group}, step, all_of, news)
            for p, frames in news.items():
                if p not in before:
                    changed[p] = now[p]
                elif len(frames) == 1:
                    changed[p] = frames[0]
                else:
                    names = keys(self.types[p]) + ([TAG] if self.tag_of(p).keeps_proofs else [])
                    changed[p] = now[p].join(before[p].select(*names), names, "left_anti")
        return now

    def _rounds(self, group: Sequence[str], rules: Mapping[int, Rule], now: dict[str, DataFrame], old: dict[str, DataFrame | None], delta: dict[str, DataFrame], all_of: Callable[[str], DataFrame], news: dict[str, list[DataFrame]]) -> None:
        inner = [r for r in rules.values() if any(a.predicate in group for a in r.atoms())]
        for q in sorted({a.predicate for r in inner for a in [*r.atoms(), *r.negated()]}):
            if q in now:
                self.table(q, now)
        for number in range(1, self.max_iterations + 1):
            start = perf_counter()
            plans: dict[str, list[DataFrame]] = {}
            for r in inner:
                plans.setdefault(r.head.predicate, []).extend(self.deltas(r, delta, all_of, old.get))
            previous = {p: now.get(p) for p in group}
            # the relations of a stratum are independent within a round
            work = [(p, f) for p, f in plans.items() if f]
            with ThreadPoolExecutor(max(1, min(len(work), 8))) as pool:
                results = list(pool.map(lambda x: self.grow(x[0], self.merge(*x)), work))
            step = {}
            for (p, _), (diff, _) in zip(work, results, strict=True):
                if diff is not None:
                    now[p], step[p] = self.parts[p].frame(), diff
                    news.setdefault(p, []).append(diff)
            self.rounds.append(Round(tuple(group), number, perf_counter() - start, {p: n for (p, _), (_, n) in zip(work, results, strict=True)}))
            if not step:
                return
            for p in group:
                old[p] = previous[p]
            delta = step
        raise IterationLimit(f"{', '.join(group)}: no fixpoint after {self.max_iterations} rounds")
