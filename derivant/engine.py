"""The engine: declare relations, insert tuples, add rules, run, read."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .functions import tags as tagging
from .functions import wmc
from .functions.tags import TAG, Unit
from .plans import analysis, demand, syntax
from .plans.analysis import Schema
from .plans.compile import literal
from .plans.fixpoint import Evaluation, Round
from .sources import relations as rel
from .sources.storage import Parts, Table, stored

PROB, FACT, GROUP = "prob", "fact", "group"
#: Inserts into a relation that rules derive, too, are kept apart until there are so many.
MOST_INSERTS = 8


class Engine:
    """A set of relations and rules over one kind of tag.

    tag is "unit" (plain sets), "boolean", "proofs" or "top-k-proofs". Relations are
    DataFrames with columns c0, c1, ...; a relation without columns has none but one
    row. run() is incremental: tuples and rules added since the last run are taken in
    as changes, and a run after the first writes what it adds to shared storage. With
    demand=True, query() evaluates only what the query needs. close() deletes what was
    written; frames that were read from the engine are not readable any more then.
    """

    def __init__(self, spark: SparkSession, tag: str = "unit", k: int = 3, demand: bool = False, max_iterations: int = 10_000) -> None:
        self.spark, self.tag, self.demand, self.max_iterations = spark, tagging.make(tag, k), demand, max_iterations
        self.schema = Schema()
        self.rules: dict[int, syntax.Rule] = {}
        self.queries: list[syntax.Query] = []
        self.rounds: list[Round] = []
        self._base: dict[str, list[DataFrame]] = {}
        self._pending: dict[str, list[DataFrame]] = {}
        self._fresh: set[int] = set()
        self._full: dict[str, DataFrame] = {}
        self._facts: dict[str, list[DataFrame]] = {}
        self._parts: dict[str, Parts] = {}
        self._dead: list[Table] = []
        self._groups: dict[str, list[list[int] | None]] = {}
        self._inserts = self._next_rule = 0
        self._items: list[syntax.Item] = []

    # programs

    def load(self, text: str | syntax.Program) -> Engine:
        """Declarations, facts, rules and queries of a program; nothing changes if it has an error."""
        old = Schema(dict(self.schema.types), dict(self.schema.symbols))
        try:
            program = analysis.check(syntax.parse(text) if isinstance(text, str) else text, self.schema)
            rules = program.of(syntax.Rule)
            self._check_strata([*self.rules.values(), *rules])
        except E.DatalogError:
            self.schema = old
            raise
        self._items += program.items
        facts: dict[str, list[tuple]] = {}
        certain: dict[str, list[tuple]] = {}
        groups = 0
        for x in program.items:
            if isinstance(x, syntax.Fact):
                values = analysis.check_fact(x, self.schema)
                if x.prob is None:
                    certain.setdefault(x.atom.predicate, []).append(values)
                else:
                    facts.setdefault(x.atom.predicate, []).append((values, x.prob, None))
            elif isinstance(x, syntax.Disjunction):
                groups += 1
                for f in x.facts:
                    facts.setdefault(f.atom.predicate, []).append((analysis.check_fact(f, self.schema), 1.0 if f.prob is None else f.prob, groups))
        for p, rows in certain.items():
            self._add(p, self._tagged(rel.from_rows(self.spark, rows, self.schema.types[p]), self.tag.one()))
        for p, rows in facts.items():
            self._insert_literals(p, rows)
        for r in rules:
            self._new_rule(r)
        self.queries += program.of(syntax.Query)
        return self

    @staticmethod
    def compile(text: str) -> syntax.Program:
        """The program, checked and with symbols resolved, without any data."""
        return analysis.check(syntax.parse(text), Schema())

    def declare(self, name: str, types: Sequence[str] = ()) -> Engine:
        if name in self.schema.types:
            raise E.VariableAlreadyExisted(f"relation {name} exists")
        self.schema.declare(syntax.Decl(name, tuple(types)))
        return self

    def drop(self, name: str) -> Engine:
        """Removes a relation that no rule uses."""
        self._types(name)
        for r in self.rules.values():
            if name == r.head.predicate or any(a.predicate == name for a in [*r.atoms(), *r.negated()]):
                raise E.CompileError(f"relation {name} is used by: {r.codify()}")
        for d in (self.schema.types, self._base, self._pending, self._full, self._facts, self._groups):
            d.pop(name, None)
        if name in self._parts:
            self._retire([self._parts.pop(name)])
        return self

    def add_rule(self, text: str) -> int:
        rule = analysis.check_rule(syntax.parse_rule(text), self.schema)
        self._check_strata([*self.rules.values(), rule])
        return self._new_rule(rule)

    def remove_rule(self, rule_id: int) -> None:
        """The rule derives nothing more; what it has derived stays."""
        if rule_id not in self.rules:
            raise E.UndefinedVariable(f"no rule {rule_id}")
        if rule_id not in self._fresh:
            p = self.rules[rule_id].head.predicate
            if p in self._full:
                self._base.setdefault(p, []).append(self._full[p])
        del self.rules[rule_id]
        self._fresh.discard(rule_id)

    def _new_rule(self, rule: syntax.Rule) -> int:
        self._next_rule += 1
        self.rules[self._next_rule] = rule
        self._fresh.add(self._next_rule)
        return self._next_rule

    def _check_strata(self, rules: Sequence[syntax.Rule]) -> None:
        analysis.strata(rules, self.schema.types)
        if self.tag.keeps_proofs and any(r.negated() for r in rules):
            raise E.NegationOfProofs("negation needs unit or boolean tags")

    # tuples

    def insert(self, name: str, df: DataFrame, columns: Sequence[str] | None = None) -> Engine:
        """Certain tuples: df's columns by position, or those named; rows with nulls are left out."""
        frame = rel.from_columns(df, self._types(name), columns)
        return self._add(name, self._tagged(frame, self.tag.one()))

    def insert_rows(self, name: str, rows: Sequence[tuple]) -> Engine:
        return self._add(name, self._tagged(rel.from_rows(self.spark, rows, self._types(name)), self.tag.one()))

    def insert_prob(self, name: str, df: DataFrame, prob: str, columns: Sequence[str] | None = None) -> Engine:
        """Independent tuples with a probability each."""
        return self._insert_uncertain(name, df, prob, (), columns)

    def insert_disjunction(self, name: str, df: DataFrame, prob: str, group: Sequence[str], columns: Sequence[str] | None = None) -> Engine:
        """Tuples with probabilities, those with equal group columns exclude each other."""
        return self._insert_uncertain(name, df, prob, group, columns)

    def bind(self, name: str, df: DataFrame, columns: Sequence[str] | None = None) -> Engine:
        return self.insert(name, df, columns)

    def _insert_uncertain(self, name: str, df: DataFrame, prob: str, group: Sequence[str], columns: Sequence[str] | None) -> Engine:
        types = self._types(name)
        if columns is None:
            columns = [c for c in df.columns if c != prob][: len(types)]
        extra = [prob, *group]
        self._inserts += 1
        frame = rel.from_columns(df, types, columns, extra)
        names, p = rel.keys(types), F.col("_x0").cast("double")
        fact = rel.fact_id(name, self._inserts, names, p)
        exclusive = F.xxhash64(F.lit(name), F.lit(self._inserts), *[F.col(f"_x{i + 1}") for i in range(len(group))]) if group else fact
        tag = self.tag.base(fact, exclusive, p)
        self._remember(name, frame.select(*names, fact.alias(FACT), exclusive.alias(GROUP), p.alias(PROB)))
        if group:
            self._groups.setdefault(name, []).append([list(columns).index(c) for c in group if c in columns])
        return self._add(name, frame.select(*names, *([tag.alias(TAG)] if tag is not None else [])))

    def _insert_literals(self, name: str, rows: Sequence[tuple]) -> None:
        types = self.schema.types[name]
        self._inserts += 1
        names = rel.keys(types)
        frame = rel.from_rows(self.spark, [], types)
        data = [(*(v or ((0,) if not types else ())), p, g) for v, p, g in rows]
        schema = rel.with_fields(frame.schema, _p="double", _g="int")
        df = rel.local(self.spark, data, schema)
        fact = rel.fact_id(name, self._inserts, [*names], F.struct("_p", "_g"))
        exclusive = F.when(F.col("_g").isNull(), fact).otherwise(F.xxhash64(F.lit("group"), F.lit(self._inserts), F.col("_g")))
        tag = self.tag.base(fact, exclusive, F.col("_p"))
        if any(g is not None for _, _, g in rows):
            self._groups.setdefault(name, []).append(None)
        self._remember(name, df.select(*names, fact.alias(FACT), exclusive.alias(GROUP), F.col("_p").alias(PROB)))
        self._add(name, df.select(*names, *([tag.alias(TAG)] if tag is not None else [])))

    def _remember(self, name: str, facts: DataFrame) -> None:
        if self.tag.keeps_proofs:
            self._facts.setdefault(name, []).append(facts)

    def facts(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The uncertain facts that were inserted: their tuple, fact, group and prob.

        fact is the key of the gradients; facts of one group exclude each other.
        """
        self._needs_proofs()
        types = self._types(name)
        if name not in self._facts:
            schema = rel.with_fields(rel.empty(self.spark, types, Unit()).schema, fact="long", group="long", prob="double")
            return self._named(rel.local(self.spark, [], schema), types, columns, FACT, GROUP, PROB)
        frames = [self._named(f, types, columns, FACT, GROUP, PROB) for f in self._facts[name]]
        return reduce(DataFrame.unionByName, frames).distinct()

    def _tagged(self, df: DataFrame, tag) -> DataFrame:
        return df if tag is None else df.withColumn(TAG, tag)

    def _add(self, name: str, df: DataFrame) -> Engine:
        self._base.setdefault(name, []).append(df)
        self._pending.setdefault(name, []).append(df)
        return self

    def _types(self, name: str) -> tuple[str, ...]:
        if name not in self.schema.types:
            raise E.UndefinedVariable(f"no relation {name}")
        return self.schema.types[name]

    # evaluation

    def _evaluation(self, types: dict[str, tuple[str, ...]] | None = None, untagged: frozenset[str] = frozenset()) -> Evaluation:
        unit = Unit()
        groups = self._groups if self.tag.keeps_proofs else {}
        groups = groups | {f"{p}@base": g for p, g in groups.items()}
        return Evaluation(self.spark, types or self.schema.types, lambda p: unit if p in untagged else self.tag, self.tag, self.max_iterations, {} if types else self._parts, groups=groups)

    def run(self) -> Engine:
        if not self._pending and not self._fresh:
            return self
        evaluation = self._evaluation()
        if self._full and any(r.negated() for r in self.rules.values()):
            # what was derived from an absence may not hold any more
            self._retire(self._parts.values())
            self._parts = evaluation.parts = {}
            for p in self._base:
                self._one_base(p, 1)
            full, pending, fresh = {}, self._base, set(self.rules)
        else:
            full, pending, fresh = self._full, self._pending, self._fresh
        self._full = evaluation.run(self.rules, fresh, full, pending)
        self.rounds += evaluation.rounds
        derived = {r.head.predicate for r in self.rules.values()}
        for p in self._pending:
            if p in self._parts and p not in derived:
                self._base[p] = [self._full[p]]
            else:
                self._one_base(p, MOST_INSERTS)
        self._pending, self._fresh = {}, set()
        return self

    def _one_base(self, p: str, most: int) -> None:
        """More than most inserts into a relation become one table."""
        if len(self._base.get(p, ())) > most:
            table = stored(self.tag.merge(reduce(DataFrame.unionByName, self._base[p]), rel.keys(self.schema.types[p])), "base")
            self._base[p] = [table.frame]
            self._dead.append(table)

    def _retire(self, parts: Iterable[Parts]) -> None:
        for x in parts:
            self._dead += [*x.tables, *x.dead]

    def vacuum(self) -> None:
        """Deletes tables that no relation reads any more; so do no frames that were read before the last run."""
        for x in self._parts.values():
            for t in x.dead:
                t.delete()
            x.dead.clear()

    def close(self) -> None:
        """Deletes everything that the engine has written."""
        self._retire(self._parts.values())
        for t in self._dead:
            t.delete()
        self._dead, self._parts, self._full, self._base, self._pending = [], {}, {}, {}, {}

    def _tuples(self, name: str) -> DataFrame:
        types = self._types(name)
        self.run()
        return self._full[name] if name in self._full else rel.empty(self.spark, types, self.tag)

    def relation(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The tuples of a relation, without tags; reading does not change it."""
        return self._named(self._tuples(name), self._types(name), columns)

    def tagged(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The tuples and their tags in the column _tag."""
        return self._named(self._tuples(name), self._types(name), columns, *([F.col(TAG)] if self.tag.column_type else []))

    def with_prob(self, name: str, columns: Sequence[str] | None = None, exclusive: bool = False) -> DataFrame:
        """The tuples and their probabilities; exclusive takes disjunctions as exclusive when counting, too."""
        self._needs_proofs()
        return self._named(self._tuples(name), self._types(name), columns, wmc.probability(F.col(TAG), exclusive).alias(PROB))

    def with_gradient(self, name: str, columns: Sequence[str] | None = None, exclusive: bool = False) -> DataFrame:
        """Also grad: the derivative of the probability by each fact, by fact identifier."""
        self._needs_proofs()
        both = self._named(self._tuples(name), self._types(name), columns, wmc.probability_and_gradient(F.col(TAG), exclusive).alias("_b"))
        return both.select(*[c for c in both.columns if c != "_b"], F.col("_b.prob").alias(PROB), F.col("_b.grad").alias("grad"))

    def _needs_proofs(self) -> None:
        if not self.tag.keeps_proofs:
            raise E.DatalogError("probabilities need proofs or top-k-proofs as tags")

    def _named(self, df: DataFrame, types: Sequence[str], columns: Sequence[str] | None, *more) -> DataFrame:
        names = rel.keys(types)
        if columns is not None and len(columns) != len(types):
            raise ValueError(f"{len(types)} names are needed")
        return df.select(*[F.col(c).alias(n) for c, n in zip(names, columns or names, strict=False)], *more)

    def query(self, text: str | syntax.Query, columns: Sequence[str] | None = None, prob: bool = False) -> DataFrame:
        """The tuples that match a query such as path(1, X)."""
        q = text if isinstance(text, syntax.Query) else analysis.check_query(syntax.parse_query(text), self.schema)
        types = self._types(q.atom.predicate)
        df = self._demanded(q) if self.demand else self._tuples(q.atom.predicate)
        first: dict[str, str] = {}
        for i, a in enumerate(q.atom.args):
            if isinstance(a, syntax.Const):
                df = df.where(F.col(f"c{i}") == literal(a))
            elif isinstance(a, syntax.Var):
                df = df.where(F.col(f"c{i}") == F.col(first.setdefault(a.name, f"c{i}")))
        more = [wmc.probability(F.col(TAG)).alias(PROB)] if prob else []
        return self._named(df, types, columns, *more)

    def _demanded(self, q: syntax.Query) -> DataFrame:
        out = demand.rewrite(list(self.rules.values()), [q])
        types = dict(self.schema.types)
        for name, (p, positions) in out.columns.items():
            types[name] = tuple(self.schema.types[p][i] for i in positions)
        pending = {p: f for p, f in self._base.items() if p not in out.base.values() or p in out.plain}
        for p in set(out.base.values()):
            types[f"{p}@base"] = self.schema.types[p]
            if p in self._base:
                pending[f"{p}@base"] = self._base[p]
        for name, rows in out.seeds.items():
            pending[name] = [rel.from_rows(self.spark, rows, types[name])]
        untagged = frozenset(n for n in types if n.startswith(demand.DEMAND))
        evaluation = self._evaluation(types, untagged)
        full = evaluation.run(dict(enumerate(out.rules)), set(range(len(out.rules))), {}, pending)
        self.rounds += evaluation.rounds
        self._retire(evaluation.parts.values())
        name = out.answers[q]
        return full[name] if name in full else rel.empty(self.spark, types[name], self.tag)

    def answers(self) -> dict[str, DataFrame]:
        """The answer of each query directive that was loaded."""
        return {q.atom.codify(): self.query(q) for q in self.queries}

    # views of the program

    def codify(self) -> str:
        return syntax.Program(tuple(self._items)).codify()

    def explain(self, what: str = "strata") -> str:
        """ast, strata, demand (the rewritten rules of the loaded queries) or plan (Spark's, after run)."""
        if what == "ast":
            return "\n".join(map(repr, self._items))
        if what == "strata":
            return "\n".join(f"{', '.join(g)}{' (recursive)' if r else ''}" for g, r in analysis.strata(self.rules.values(), self.schema.types))
        if what == "demand":
            return "\n".join(r.codify() for r in demand.rewrite(list(self.rules.values()), self.queries).rules)
        if what == "plan":
            self.run()
            return "\n".join(f"{p}:\n{df._jdf.queryExecution().toString()}" for p, df in self._full.items())
        raise ValueError(what)


def engines(spark: SparkSession, text: str, tag: str = "unit", **options) -> dict[str, Engine]:
    """An engine for each program of a text such as "Roads { decl a(Int). a(1). } Rails { .. }"; they share nothing."""
    return {name: Engine(spark, tag, **options).load(program) for name, program in syntax.parse_block(text).items()}
