"""Digit tasks against enumeration."""

from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from derivant import Engine, tasks
from derivant.functions import wmc
from derivant.functions.tags import TAG
from derivant.queries import queries

P = {(t, i, v): (1 + (v * (t + 2) + i) % 5) / (11 + t) for t in range(2) for i in range(3) for v in range(4)}


def frame(spark, k):
    return spark.createDataFrame([(*key, p) for key, p in P.items() if key[1] < k], "task long, position long, value long, prob double")


def enumerate_(k, outcome):
    proofs = {}
    for t in range(2):
        for values in product(range(4), repeat=k):
            proofs.setdefault((t, outcome(values)), []).append(frozenset((t, i, v) for i, v in enumerate(values)))
    return {r: wmc.count(ps, P) for r, ps in proofs.items()}


def check(spark, program, k, outcome, **options):
    found = {(r["task"], r["result"]): r["prob"] for r in tasks.run(program, frame(spark, k), tag="proofs", **options).collect()}
    expected = enumerate_(k, outcome)
    assert set(found) == set(expected)
    for r, p in expected.items():
        assert found[r] == pytest.approx(p, abs=1e-9)


def test_sum(spark):
    check(spark, tasks.sum_program(3), 3, sum)


def test_sort(spark):
    orders = {p: i for i, p in enumerate(permutations(range(3)))}
    check(spark, tasks.sort_program(3), 3, lambda v: orders[tuple(sorted(range(3), key=lambda i: v[i]))])


def test_count(spark):
    expected = spark.createDataFrame([(0, 1, 2), (1, 1, 2)], "t long, a long, b long")
    check(spark, tasks.count_program(2), 2, lambda v: (v[0] == 1) + (v[1] == 2), expected=expected)


def uniform(spark, program, k, **more):
    digits = spark.range(k).select(F.lit(0).alias("task"), F.col("id").alias("position"), F.explode(F.array(*map(F.lit, range(10)))).alias("value"), F.lit(0.1).alias("prob"))
    engine = Engine(spark, "proofs").load(program).insert_disjunction("digit", digits, "prob", ["task", "position"], ["task", "position", "value"])
    for name, rows in more.items():
        engine.insert_rows(name, rows)
    return [r[1] for r in engine.tagged("result", ["task", "result"]).select("result", F.size(TAG)).orderBy("result").collect()]


def test_numbers_of_proofs(spark):
    assert uniform(spark, tasks.sort_program(2), 2) == [55, 45]
    assert uniform(spark, tasks.sort_program(3), 3) == [220, 165, 165, 165, 165, 120]
    assert uniform(spark, tasks.count_program(2), 2, expected=[(0, 3, 7)]) == [81, 18, 1]


def test_gradient_of_the_best_proofs(spark):
    rows = tasks.run(tasks.sum_program(2), frame(spark, 2), k=3, gradient=True).collect()
    assert all(1 <= len(r["grad"]) <= 6 and r["prob"] > 0 for r in rows) and len(rows) == 14


@pytest.mark.parametrize("name", ["wmc_exclusive", "sum2_tasks"])
def test_tasks_are_dealt_once(spark, name):
    """Digits of a task meet where the task's rows were sent at first; nothing of the size of the input is broadcast."""
    plan = queries()[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange" in x]
    assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges), plan
