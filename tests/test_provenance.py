"""Tags, probabilities and gradients, against hand-derived values and enumeration."""

from itertools import product

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from derivant import Engine
from derivant import errors as E
from derivant.functions import wmc
from derivant.functions.tags import TAG, Proofs, sorted_set
from derivant.operators import relational as R
from derivant.plans.fixpoint import Evaluation


def close(found, expected):
    assert set(found) == set(expected)
    for k, v in expected.items():
        assert found[k] == pytest.approx(v, abs=1e-9), k


def probs(engine, name, **options):
    return {tuple(r)[:-1] if len(r) > 2 else r[0]: r[-1] for r in engine.with_prob(name, **options).collect()}


def worlds(groups):
    """(held facts, chance) of every way to choose one fact or none of each group of (fact, chance)."""
    for pick in product(*([*g, None] for g in groups)):
        w = 1.0
        for g, x in zip(groups, pick, strict=True):
            w *= x[1] if x is not None else 1 - sum(p for _, p in g)
        yield {x[0] for x in pick if x is not None}, w


def chances(groups, holds):
    """The chance of each answer; holds(facts) gives the answers in a world."""
    out = {}
    for held, w in worlds(groups):
        for answer in holds(held):
            out[answer] = out.get(answer, 0.0) + w
    return out


# a valve is open, shut or stuck; pipes between tanks hold or leak
VALVES = [[(("valve", v, s), p) for s, p in states] for v, states in ((1, (("open", 0.5), ("shut", 0.25))), (2, (("open", 0.125), ("shut", 0.375), ("stuck", 0.5))))]
PIPES = [[(("pipe", a, b), p)] for a, b, p in ((1, 2, 0.75), (2, 3, 0.5), (1, 3, 0.25), (3, 2, 0.5))]
TANKS = "decl valve(Int, String). decl pipe(Int, Int). decl r(Int). decl flow(Int, Int). " + " ".join("; ".join(f'{p}::valve({f[1]}, "{f[2]}")' for f, p in g) + "." for g in VALVES) + " " + " ".join(f"{p}::pipe({f[1]}, {f[2]})." for ((f, p),) in PIPES) + " "


def independent(groups):
    """The same facts, none of which excludes another."""
    return [[x] for g in groups for x in g]


@pytest.mark.parametrize("tag", ["proofs", "top-k-proofs"])
def test_facts_that_exclude_each_other(spark, tag):
    """Any state of a valve will do: apart when counted, unless they are said to exclude each other there, too."""
    engine = Engine(spark, tag, k=4).load(TANKS + "r(V) :- valve(V, _), pipe(V, 3).")

    def holds(facts):
        return {f[1] for f in facts if f[0] == "valve" and ("pipe", f[1], 3) in facts}

    close(probs(engine, "r"), chances(independent(VALVES + PIPES), holds))
    close(probs(engine, "r", exclusive=True), chances(VALVES + PIPES, holds))


def test_no_proof_has_facts_that_exclude_each_other(spark):
    engine = Engine(spark, "proofs").load(TANKS + 'r(V) :- valve(V, "open"), valve(V, "shut"). r(V) :- valve(V, "stuck"), pipe(1, V).')
    close(probs(engine, "r"), {2: 0.5 * 0.75})


def test_sums_of_two_dice(spark):
    """Loaded dice: all sums, the two best proofs of each, and one die's values as exclusive."""
    dice = [[((i, v), p) for v, p in enumerate(ps, 1)] for i, ps in enumerate(((0.25, 0.125, 0.5, 0.125), (0.375, 0.25, 0.25, 0.125)))]
    facts = " ".join("; ".join(f"{p}::die({i}, {v})" for (i, v), p in d) + "." for d in dice)
    text = f"decl die(Int, Int). decl r(Int). {facts} r(A + B) :- die(0, A), die(1, B)."

    def holds(held):
        return {a + b for i, a in held if i == 0 for j, b in held if j == 1}

    exact = chances(independent(dice), holds)
    close(probs(Engine(spark, "proofs").load(text), "r"), exact)
    close(probs(Engine(spark, "proofs").load(text), "r", exclusive=True), chances(dice, holds))
    close(probs(Engine(spark, "top-k-proofs", k=9).load(text), "r"), exact)
    best = {}
    for (_, a), p in dice[0]:
        for (_, b), q in dice[1]:
            best.setdefault(a + b, []).append((p * q, (a, b)))
    two = {}
    for total, ways in best.items():
        ways = [x for _, x in sorted(ways, reverse=True)[:2]]
        if len(best[total]) <= 2 or sorted(best[total], reverse=True)[1][0] > sorted(best[total], reverse=True)[2][0]:  # no tie for the last place
            two[total] = chances(independent(dice), lambda held, ways=ways: {0} if any((0, a) in held and (1, b) in held for a, b in ways) else set())[0]
    found = probs(Engine(spark, "top-k-proofs", k=2).load(text), "r")
    close({k: found[k] for k in two}, two)


def test_set_operations(spark):
    text = TANKS + "decl one(Int). decl two(Int). one(B) :- pipe(1, B). two(B) :- pipe(_, B), pipe(B, _). "
    pipes = independent(PIPES)
    to, on = (lambda held: {b for _, a, b in held if a == 1}), (lambda held: {b for _, _, b in held if any(x == b for _, x, _ in held)})
    close(probs(Engine(spark, "proofs").load(text + "r(A) :- one(A), two(A)."), "r"), chances(pipes, lambda h: to(h) & on(h)))
    close(probs(Engine(spark, "proofs").load(text + "r(A) :- one(A). r(A) :- two(A)."), "r"), chances(pipes, lambda h: to(h) | on(h)))


def test_rules_added_between_runs(spark):
    engine = Engine(spark, "proofs").load(TANKS + "decl s(Int).")
    engine.add_rule("r(B) :- pipe(1, B).")
    close(probs(engine, "r"), {2: 0.75, 3: 0.25})
    engine.add_rule("r(B) :- pipe(3, B).")
    close(probs(engine, "r"), {2: 1 - 0.25 * 0.5, 3: 0.25})
    engine.add_rule('s(B) :- r(B), valve(B, "open").')
    close(probs(engine, "s"), {2: (1 - 0.25 * 0.5) * 0.125})


def test_number_of_proofs(spark):
    facts = " ".join("; ".join(f"0.125::card({i}, {v})" for v in range(8)) + "." for i in range(2))
    engine = Engine(spark, "proofs").load(f"decl card(Int, Int). decl r(Int). {facts} r(A / 2 - B / 2) :- card(0, A), card(1, B).")
    expected = {}
    for a, b in product(range(8), repeat=2):
        expected[a // 2 - b // 2] = expected.get(a // 2 - b // 2, 0) + 1
    assert {r[0]: r[1] for r in engine.tagged("r").select("c0", F.size(TAG)).collect()} == expected


def test_recursive_proofs_saturate(spark):
    """Longer ways come in later rounds and are proofs like the others; ways through a cycle add nothing."""
    engine = Engine(spark, "proofs").load(TANKS + "flow(A, B) :- pipe(A, B). flow(A, C) :- flow(A, B), pipe(B, C).")

    def holds(held):
        found = {(a, b) for _, a, b in held}
        while more := {(a, d) for a, b in found for c, d in found if b == c} - found:
            found |= more
        return found

    close(probs(engine, "flow"), chances(independent(PIPES), holds))
    top = probs(Engine(spark, "top-k-proofs", k=1).load(TANKS + "flow(A, B) :- pipe(A, B). flow(A, C) :- flow(A, B), pipe(B, C)."), "flow")
    assert top[(1, 3)] == pytest.approx(0.75 * 0.5) and top[(1, 2)] == pytest.approx(0.75)


def test_plain_facts_are_certain(spark):
    engine = Engine(spark, "proofs").load("decl sure(Int). decl maybe(Int). decl r(Int). decl on. sure(4). 0.25::sure(6). 0.5::maybe(4). on. r(A) :- sure(A), on. r(A) :- maybe(A).")
    close(probs(engine, "r"), {4: 1.0, 6: 0.25})


def test_demand_keeps_probabilities(spark):
    text = "decl e(Int, Int). decl r(Int, Int). 0.5::e(1, 2). 0.5::e(2, 3). 0.4::e(1, 3). 0.9::e(7, 8). r(A, B) :- e(A, B). r(A, C) :- e(A, B), r(B, C)."
    a, b = (Engine(spark, "proofs", demand=d).load(text).query("r(1, X)", prob=True) for d in (True, False))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_gradient_by_fact(spark):
    """Slopes join to facts; those of shared facts are expanded, the others are products."""
    frame = spark.createDataFrame([(1, 0.5), (2, 0.25), (4, 0.75)], "x int, p double")
    text = "decl a(Int). decl b(Int). decl r(Int). r(0) :- a(_). r(1) :- a(A), b(A). r(2) :- a(A), b(5)."
    engine = Engine(spark, "proofs").load(text).insert_prob("a", frame, "p").insert_prob("b", spark.createDataFrame([(2, 0.5), (4, 0.5), (5, 0.125)], frame.schema), "p")
    p = {("a", 1): 0.5, ("a", 2): 0.25, ("a", 4): 0.75, ("b", 2): 0.5, ("b", 4): 0.5, ("b", 5): 0.125}
    proofs = {0: [{("a", x)} for x in (1, 2, 4)], 1: [{("a", x), ("b", x)} for x in (2, 4)], 2: [{("a", x), ("b", 5)} for x in (1, 2, 4)]}

    def chance(k, p):
        return sum(w for held, w in worlds([[x] for x in p.items()]) if any(q <= held for q in proofs[k]))

    names = {}
    for relation in "ab":
        for r in engine.facts(relation, ["x"]).collect():
            assert r["prob"] == p[(relation, r["x"])] and r["group"] == r["fact"]
            names[r["fact"]] = (relation, r["x"])
    assert sorted(names.values()) == sorted(p)
    for row in engine.with_gradient("r", ["k"]).collect():
        assert row["prob"] == pytest.approx(chance(row["k"], p))
        slopes = {names[f]: s for f, s in row["grad"].items()}
        close(slopes, {f: chance(row["k"], p | {f: 1.0}) - chance(row["k"], p | {f: 0.0}) for q in proofs[row["k"]] for f in q})


def test_facts_of_other_tags(spark):
    engine = Engine(spark, "proofs").load("decl a(Int). a(1). 0.5::a(2); 0.25::a(3).")
    found = engine.facts("a", ["x"]).collect()
    assert sorted((r["x"], r["prob"]) for r in found) == [(2, 0.5), (3, 0.25)] and len({r["group"] for r in found}) == 1
    assert Engine(spark, "proofs").load("decl a(Int).").facts("a").count() == 0
    with pytest.raises(E.DatalogError):
        Engine(spark).load("decl a(Int).").facts("a")


def test_disjunctions_of_a_frame(spark):
    frame = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.25)], "t int, v int, p double")
    engine = Engine(spark, "proofs").load("decl d(Int, Int). decl r(Int, Int). r(A, B) :- d(T, A), d(T, B).").insert_disjunction("d", frame, "p", ["t"])
    close(probs(engine, "r"), {(0, 0): 1 - 0.5 * 0.75, (1, 1): 0.5})


def test_no_negation_of_proofs(spark):
    with pytest.raises(E.NegationOfProofs):
        Engine(spark, "proofs").load("decl a(Int). decl b(Int). b(A) :- a(A), ~b(A)." .replace("~b", "~a"))
    with pytest.raises(E.DatalogError):
        Engine(spark).load("decl a(Int).").with_prob("a")


facts = st.integers(0, 5)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(facts, max_size=3), max_size=6), st.lists(st.floats(0.05, 0.95), min_size=6, max_size=6))
def test_counting_equals_enumeration(proofs, p):
    expected = 0.0
    for world in product([0, 1], repeat=6):
        if any(all(world[f] for f in proof) for proof in proofs):
            w = 1.0
            for f in range(6):
                w *= p[f] if world[f] else 1 - p[f]
            expected += w
    assert wmc.count(proofs, dict(enumerate(p))) == pytest.approx(expected, abs=1e-9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(facts, max_size=3), max_size=5))
def test_exclusive_counting_equals_enumeration(proofs):
    """Facts 0-2 exclude each other, and 3-4 do."""
    p, group = {0: 0.3, 1: 0.2, 2: 0.4, 3: 0.5, 4: 0.25, 5: 0.7}, {0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: "c"}
    expected = 0.0
    for a, b, c in product([0, 1, 2, None], [3, 4, None], [5, None]):
        held = {a, b, c} - {None}
        w = (p[a] if a is not None else 0.1) * (p[b] if b is not None else 0.25) * (0.7 if c else 0.3)
        expected += w * any(q <= held for q in proofs)
    assert wmc.count(proofs, p, group) == pytest.approx(expected, abs=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.frozensets(facts, min_size=1, max_size=3), min_size=1, max_size=5))
def test_gradient_equals_difference(proofs):
    p = {f: 0.1 + 0.13 * f for f in range(6)}
    for f, g in wmc.gradient(proofs, p).items():
        up, down = dict(p), dict(p)
        up[f] += 1e-5
        down[f] -= 1e-5
        assert g == pytest.approx((wmc.count(proofs, up) - wmc.count(proofs, down)) / 2e-5, abs=1e-6)


def test_operators(spark, rows):
    a = R.source(spark, [(1, 3), (1, 4), (2, 5), (4, 4), (1, 3)], "x long, y long")
    b = R.source(spark, [(1, 3), (2, 5), (9, 9)], "x long, y long")
    assert rows(R.project(a, "y")) == [(3,), (4,), (5,)]
    assert rows(R.project(a, (F.col("x") + F.col("y")).alias("s"))) == [(4,), (5,), (7,), (8,)]
    assert rows(R.dedupe(R.select(a, F.col("x") < F.col("y")))) == [(1, 3), (1, 4), (2, 5)]
    assert rows(R.dedupe(R.find(a, "x", 1))) == [(1, 3), (1, 4)]
    assert rows(R.intersect(a, b)) == [(1, 3), (2, 5)]
    assert rows(R.union(a, b)) == [(1, 3), (1, 4), (2, 5), (4, 4), (9, 9)]
    assert rows(R.difference(a, b)) == rows(R.dedupe(R.delta(a, b))) == [(1, 4), (4, 4)]
    assert rows(R.antijoin(a, b, ["x"])) == [(4, 4)]
    assert rows(R.dedupe(R.semi_join(a, b, ["x"]))) == [(1, 3), (1, 4), (2, 5)]
    assert R.join(R.dedupe(a), b.withColumnRenamed("y", "z"), ["x"]).count() == 3
    assert R.product(b.select("x"), b.select("y")).count() == 9
    assert rows(R.contains_chain(a, {"x": 4}, b)) == rows(b) and not rows(R.contains_chain(a, {"x": 5}, b))


def test_only_frames_of_known_size_are_broadcast(spark, rows):
    """The optimiser takes exploded rows and proofs for much smaller than they are."""
    parts = F.explode(F.array(*map(F.lit, range(5)))).alias("b")
    many = spark.range(20_000).select("id", parts).select("id", "b", F.lit(0.5).alias("p"))
    few = spark.range(3).select("id", F.lit(0.25).alias("p"))

    def joined(second):
        engine = Engine(spark, "proofs").load("decl a(Int, Int). decl c(Int, Int). decl d(Int). r(A) :- a(A, _), c(A, _). s(A) :- a(A, _), d(A). decl r(Int). decl s(Int).")
        engine.insert_prob("a", many, "p", ["id", "b"]).insert_prob("c", many, "p", ["id", "b"]).insert_prob("d", few, "p", ["id"])
        df = engine.tagged(second, ["a"])
        return df, df._jdf.queryExecution().executedPlan().toString()

    df, plan = joined("r")
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert df.count() == 20_000 and df.select(F.min(F.size(TAG)), F.max(F.size(TAG))).first() == (25, 25)
    df, plan = joined("s")
    assert "Broadcast" in plan and df.count() == 3


def test_pairs_of_one_group_are_not_made(spark, monkeypatch):
    """n facts that exclude each other give n proofs, not n times n products of which n are left."""
    seen, merge = [], Proofs.merge
    monkeypatch.setattr(Proofs, "merge", lambda self, df, keys: seen.append(df) or merge(self, df, keys))
    facts = spark.range(600).select("id", (F.col("id") % 2).alias("n"), F.lit(0.001).alias("p"))
    engine = Engine(spark, "proofs").load("decl s(Int, Int). decl t(Int, Int). decl r(Int). t(A, N) :- s(A, N). r(N) :- t(A, N), t(B, N).")
    engine.insert_disjunction("s", facts, "p", ["n"])
    assert [tuple(x) for x in engine.tagged("r", ["n"]).select("n", F.size(TAG)).orderBy("n").collect()] == [(0, 300), (1, 300)]
    assert seen[-1].count() == 600


@pytest.mark.parametrize("tag", ["proofs", "top-k-proofs"])
def test_joins_by_groups_keep_all_proofs(spark, rows, monkeypatch, tag):
    """The same tags as without them: several groups a key, certain and repeated tuples, proofs of several facts."""
    text = """
        decl s(Int, Int). decl e(Int, Int). decl two(Int, Int, Int). decl r(Int). decl q(Int, Int). decl u(Int).
        s(1, 0). 0.25::s(7, 0); 0.5::s(8, 0).
        r(N) :- s(A, N), s(B, N). q(A, B) :- s(A, N), s(B, N), A < B.
        two(A, B, N) :- s(A, N), e(A, B). u(N) :- two(A, _, N), two(B, _, N), s(B, N). u(N) :- s(7, N), s(8, N).
    """

    def read():
        engine = Engine(spark, tag, k=5).load(text)
        facts = spark.createDataFrame([(a, a % 2, a // 4, (a % 5 + 1) / 20) for a in range(12)] + [(3, 1, 0, 0.125), (3, 1, 2, 0.0625)], "a long, n long, g long, p double")
        engine.insert_disjunction("s", facts, "p", ["g"], ["a", "n"])
        engine.insert_disjunction("s", facts.where("a < 6"), "p", ["n"], ["a", "n"])
        engine.insert_prob("e", facts.selectExpr("a", "a * 3 % 12", "p").distinct(), "p")
        return {p: rows(engine.tagged(p)) for p in ("r", "q", "u")}

    by_groups = read()
    monkeypatch.setattr(Evaluation, "exclude", lambda self, a, b: False)
    plain = read()
    assert by_groups == plain and all(plain.values())


def test_sorted_sets(spark):
    df = spark.createDataFrame([([3, 1, 3, 2, 1],), ([],), ([5],), ([4, 4],)], "v array<int>")
    assert [r[0] for r in df.select(sorted_set(F.transform("v", lambda x: F.array(x)))).collect()] == [[[1], [2], [3]], [], [[5]], [[4]]]


def test_products_are_factored():
    """Any of a, any of b and any of c: no expansion is needed; of one proof less it is."""
    sides = [[(s, i) for i in range(n)] for s, n in (("a", 9), ("b", 11), ("c", 13))]
    prob = {f: (f[1] % 7 + 1) / 11 for side in sides for f in side}
    proofs = [frozenset(p) for p in product(*sides)]
    assert len(wmc._factors(frozenset(proofs))) == 3 and len(wmc._factors(frozenset(proofs[1:]))) == 1

    def some(side, without=None):
        miss = 1.0
        for f in side:
            miss *= 1.0 if f == without else 1 - prob[f]
        return 1 - miss

    a, b, c = map(some, sides)
    total, slope = wmc.count_and_gradient(proofs, prob)
    assert total == pytest.approx(a * b * c) and slope[("a", 3)] == pytest.approx((1 - some(sides[0], ("a", 3))) * b * c)
    # with groups: values of a exclude each other
    prob = {f: p / 13 for f, p in prob.items()}
    group = {f: "one a" if f[0] == "a" else f for f in prob}
    assert wmc.count(proofs, prob, group) == pytest.approx(sum(prob[f] for f in sides[0]) * some(sides[1]) * some(sides[2]))


def test_tags_of_a_sliced_array():
    tags = pa.array([[[(1, 2, 0.5)]], None, [], [[(1, 3, 0.25), (4, 4, 0.5)], []], [[(7, 8, 0.125)], [(1, 2, 0.5)]]], pa.list_(pa.list_(pa.struct([("d", pa.int64()), ("f", pa.int64()), ("p", pa.float64())]))))
    expected = [([[2]], {2: 0.5}, {2: 1}), None, ([], {}, {}), ([[3, 4], []], {3: 0.25, 4: 0.5}, {3: 1, 4: 4}), ([[8], [2]], {8: 0.125, 2: 0.5}, {8: 7, 2: 1})]
    for start in range(5):
        assert list(wmc._unpacked(tags[start:], True)) == expected[start:]
