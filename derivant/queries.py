"""One query per operator and construct, over whole tables, and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Engine
from .functions.tags import TAG
from .operators import relational as R

#: name -> (query, SQL)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _ALL[f.__name__] = (f, sql)
        return f

    return register


def program(name: str, text: str, output: str, columns: list[str], tables: dict[str, tuple[str, list[str]]], sql: str, **options) -> None:
    """Registers a program over tables: relation -> (table, its columns)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, **options).load(text)
        for relation, (source, names) in tables.items():
            engine.bind(relation, table(spark, sf_dir, source), names)
        return engine.relation(output, columns)

    _ALL[name] = (run, sql)


NATION = {"nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"])}
REGION = {"region": ("region", ["r_regionkey", "r_name"])}
CUSTOMER = {"customer": ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])}
SUPPLIER = {"supplier": ("supplier", ["s_suppkey", "s_nationkey"])}
ORDERS = {"orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])}
PART = {"part": ("part", ["p_partkey", "p_size"])}
TURN = {"turn": ("conversations", ["conv_id", "turn"])}
D_NATION = "decl nation(Int, String, Int). "
D_REGION = "decl region(Int, String). "
D_CUSTOMER = "decl customer(Int, String, Int, String). "
D_SUPPLIER = "decl supplier(Int, Int). "
D_ORDERS = "decl orders(Int, Int, String, String). "
D_PART = "decl part(Int, Int). "
D_TURN = "decl turn(Int, Int). "

program("scan_copy", D_NATION + "decl r(Int, String). r(A, B) :- nation(A, B, _).", "r", ["k", "name"], NATION, "SELECT DISTINCT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
program("column_permutation", D_NATION + "decl r(Int, Int, Int). r(B, A, A) :- nation(A, _, B).", "r", ["region", "k", "again"], NATION, "SELECT DISTINCT n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS k, n_nationkey::BIGINT AS again FROM nation")
program("project_dedupe", D_CUSTOMER + "decl r(String). r(S) :- customer(_, _, _, S).", "r", ["segment"], CUSTOMER, "SELECT DISTINCT c_mktsegment AS segment FROM customer")
program("project_expr", D_PART + "decl r(Int, Int). r(K, (S + 2) * 3 - K) :- part(K, S).", "r", ["k", "v"], PART, "SELECT DISTINCT p_partkey AS k, (p_size + 2) * 3 - p_partkey AS v FROM part")
program("int_div", D_PART + "decl r(Int, Int). r(K, (S - 20) / 3) :- part(K, S).", "r", ["k", "v"], PART, "SELECT DISTINCT p_partkey AS k, trunc((p_size - 20) / 3.0)::BIGINT AS v FROM part")
program("unary_ops", D_PART + "decl r(Int, Int, Bool). r(K, -S, !(S > 25)) :- part(K, S).", "r", ["k", "minus", "small"], PART, "SELECT DISTINCT p_partkey AS k, -p_size::BIGINT AS minus, NOT p_size > 25 AS small FROM part")
program("const_head", D_ORDERS + 'decl r(Int, Int, String). r(K, 100, "open") :- orders(K, _, "O", _).', "r", ["k", "v", "s"], ORDERS, "SELECT DISTINCT o_orderkey AS k, 100::BIGINT AS v, 'open' AS s FROM orders WHERE o_orderstatus = 'O'")
program("const_body", D_ORDERS + 'decl r(Int). r(K) :- orders(K, _, "F", _).', "r", ["k"], ORDERS, "SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'")
program("repeated_var", D_NATION + "decl r(Int, String). r(A, N) :- nation(A, N, A).", "r", ["k", "name"], NATION, "SELECT DISTINCT n_nationkey::BIGINT AS k, n_name AS name FROM nation WHERE n_nationkey = n_regionkey")
program("filter_cmp", D_PART + "decl r(Int, Int). r(K, S) :- part(K, S), S > 25, S <= 40, S != 30.", "r", ["k", "size"], PART, "SELECT DISTINCT p_partkey AS k, p_size::BIGINT AS size FROM part WHERE p_size > 25 AND p_size <= 40 AND p_size <> 30")
program("string_constraint", D_CUSTOMER + 'decl r(Int). r(K) :- customer(K, _, _, S), S == "BUILDING".', "r", ["k"], CUSTOMER, "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'")
program("bool_expr_head", D_PART + "decl r(Int, Bool). r(K, S > 25 && S <= 40 || S == 7) :- part(K, S).", "r", ["k", "b"], PART, "SELECT DISTINCT p_partkey AS k, p_size > 25 AND p_size <= 40 OR p_size = 7 AS b FROM part")
program("symbol_constants", D_PART + "decl kind(Int, Symbol). decl r(Int). kind(K, small) :- part(K, S), S < 10. kind(K, large) :- part(K, S), S >= 10. r(K) :- kind(K, small).", "r", ["k"], PART, "SELECT DISTINCT p_partkey AS k FROM part WHERE p_size < 10")
program("join_single", D_CUSTOMER + D_NATION + "decl r(String, String). r(C, N) :- customer(_, C, K, _), nation(K, N, _).", "r", ["customer", "nation"], CUSTOMER | NATION, "SELECT DISTINCT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
program("join_chain", D_CUSTOMER + D_NATION + D_REGION + "decl r(String, String, String). r(C, N, R) :- customer(_, C, K, _), nation(K, N, G), region(G, R).", "r", ["customer", "nation", "region"], CUSTOMER | NATION | REGION, "SELECT DISTINCT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
program(
    "join_multi_key", "decl a(Int, Int, Int). decl b(Int, Int, Int). decl r(Int, Int, Int, Int). r(O, L, P, S) :- a(O, L, P), b(O, L, S).", "r", ["o", "l", "p", "s"],
    {"a": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]), "b": ("lineitem", ["l_orderkey", "l_linenumber", "l_suppkey"])},
    "SELECT DISTINCT a.l_orderkey AS o, a.l_linenumber::BIGINT AS l, a.l_partkey AS p, b.l_suppkey AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
)
program("subset_join", D_ORDERS + D_CUSTOMER + 'decl r(Int, Int). r(O, C) :- orders(O, C, _, _), customer(C, _, _, "BUILDING").', "r", ["o", "c"], ORDERS | CUSTOMER, "SELECT DISTINCT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
program("intersect_rule", D_CUSTOMER + D_SUPPLIER + "decl r(Int). r(N) :- customer(_, _, N, _), supplier(_, N).", "r", ["nation"], CUSTOMER | SUPPLIER, "SELECT c_nationkey::BIGINT AS nation FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier")
program("bidirected", D_NATION + "decl e(Int, Int). decl r(Int, Int). e(A, B) :- nation(A, _, B). e(B, A) :- nation(A, _, B), A < 3. r(A, B) :- e(A, B), e(B, A).", "r", ["a", "b"], NATION, "WITH e AS (SELECT n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b FROM nation UNION SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey < 3) SELECT DISTINCT x.a, x.b FROM e x JOIN e y ON x.a = y.b AND x.b = y.a")
program("product_rule", D_NATION + D_REGION + "decl r(String, String). r(N, R) :- nation(_, N, _), region(_, R).", "r", ["nation", "region"], NATION | REGION, "SELECT DISTINCT n_name AS nation, r_name AS region FROM nation, region")
program("theta_join", D_NATION + "decl r(Int, Int). r(A, B) :- nation(A, _, R), nation(B, _, R), A < B.", "r", ["a", "b"], NATION, "SELECT DISTINCT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
program("union_rules", D_CUSTOMER + D_SUPPLIER + "decl r(Int). r(N) :- customer(_, _, N, _). r(N) :- supplier(_, N).", "r", ["nation"], CUSTOMER | SUPPLIER, "SELECT c_nationkey::BIGINT AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
program("contains_gate", D_NATION + D_REGION + 'decl has(Int, Int). decl r(String). has(A, R) :- nation(A, _, R). r(N) :- region(_, N), has(0, 0). r("never") :- has(0, 99).', "r", ["name"], NATION | REGION, "SELECT DISTINCT r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 0 AND n_regionkey = 0)")
program("unit_relation", D_NATION + "decl flag. decl other. decl r(String). flag. r(N) :- nation(_, N, _), flag. r(N) :- nation(_, N, _), other.", "r", ["name"], NATION, "SELECT DISTINCT n_name AS name FROM nation")
program("ground_body", D_ORDERS + 'decl any. decl r(Int). any :- orders(_, _, "P", _). r(1) :- any. r(0) :- orders(_, _, "no such status", _).', "r", ["v"], ORDERS, "SELECT 1::BIGINT AS v WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P')")
program("negation", D_CUSTOMER + D_ORDERS + "decl has(Int). decl r(Int, String). has(C) :- orders(_, C, \"F\", _). r(C, N) :- customer(C, N, _, _), ~has(C).", "r", ["k", "name"], CUSTOMER | ORDERS, "SELECT DISTINCT c_custkey AS k, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
program("bool_tag", D_CUSTOMER + D_ORDERS + 'decl r(Int). r(C) :- customer(C, _, _, "BUILDING"), orders(_, C, "F", _).', "r", ["k"], CUSTOMER | ORDERS, "SELECT DISTINCT c_custkey AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'", tag="boolean")

EDGE = D_NATION + "decl edge(Int, Int). decl path(Int, Int). edge(A, A * 7 + 3 - (A * 7 + 3) / 25 * 25) :- nation(A, _, _). edge(A, B) :- nation(A, _, B). "
EDGE_SQL = "edge AS (SELECT n_nationkey::BIGINT AS a, (n_nationkey * 7 + 3)::BIGINT % 25 AS b FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation)"
PATH_SQL = f"WITH RECURSIVE {EDGE_SQL}, path AS (SELECT a, b FROM edge UNION SELECT edge.a, path.b FROM edge JOIN path ON edge.b = path.a) "
program("tc_path", EDGE + "path(A, B) :- edge(A, B). path(A, C) :- edge(A, B), path(B, C).", "path", ["a", "b"], NATION, PATH_SQL + "SELECT a, b FROM path")
program("tc_nonlinear", EDGE + "path(A, B) :- edge(A, B). path(A, C) :- path(A, B), path(B, C).", "path", ["a", "b"], NATION, PATH_SQL + "SELECT a, b FROM path")
NEXT = D_TURN + "decl next(Int, Int, Int). next(C, A, B) :- turn(C, A), turn(C, B), B == A + 1. "
NEXT_SQL = "next AS (SELECT DISTINCT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"
program("tc_turns", NEXT + "decl reach(Int, Int, Int). reach(C, A, B) :- next(C, A, B). reach(C, A, D) :- reach(C, A, B), next(C, B, D).", "reach", ["c", "a", "b"], TURN, f"WITH RECURSIVE {NEXT_SQL}, reach AS (SELECT c, a, b FROM next UNION SELECT r.c, r.a, n.b FROM reach r JOIN next n ON r.c = n.c AND r.b = n.a) SELECT c, a, b FROM reach")
program("mutual_even_odd", NEXT + "decl even(Int, Int). decl odd(Int, Int). even(C, A) :- turn(C, A), A == 0. odd(C, B) :- even(C, A), next(C, A, B). even(C, B) :- odd(C, A), next(C, A, B).", "even", ["c", "turn"], TURN, f"WITH RECURSIVE {NEXT_SQL}, r AS (SELECT DISTINCT conv_id AS c, turn AS t FROM conversations WHERE turn = 0 UNION SELECT r.c, n.b FROM r JOIN next n ON r.c = n.c AND r.t = n.a) SELECT c, t AS turn FROM r WHERE t % 2 = 0")
program(
    "same_generation", D_SUPPLIER + D_NATION + "decl parent(Int, Int). decl sg(Int, Int). parent(S + 1000000, N + 1000) :- supplier(S, N). parent(N + 1000, R) :- nation(N, _, R). sg(A, B) :- parent(A, P), parent(B, P), A != B. sg(A, B) :- parent(A, P), sg(P, Q), parent(B, Q).", "sg", ["a", "b"], SUPPLIER | NATION,
    "WITH RECURSIVE parent AS (SELECT s_suppkey + 1000000 AS a, s_nationkey::BIGINT + 1000 AS p FROM supplier UNION SELECT n_nationkey::BIGINT + 1000, n_regionkey FROM nation), sg AS (SELECT x.a, y.a AS b FROM parent x JOIN parent y ON x.p = y.p AND x.a <> y.a UNION SELECT x.a, y.a FROM sg JOIN parent x ON x.p = sg.a JOIN parent y ON y.p = sg.b) SELECT a, b FROM sg",
)


@query(PATH_SQL + "SELECT a, b FROM path WHERE a = 3")
def tc_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, demand=True).load(EDGE + "path(A, B) :- edge(A, B). path(A, C) :- path(A, B), edge(B, C).")
    engine.bind("nation", table(spark, sf_dir, "nation"), NATION["nation"][1])
    return engine.query("path(3, X)", ["a", "b"])


@query("SELECT DISTINCT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey::BIGINT AS region FROM nation WHERE n_nationkey = 7")
def find_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark).declare("nation", ["Int", "String", "Int"]).bind("nation", table(spark, sf_dir, "nation"), NATION["nation"][1])
    return R.find(engine.relation("nation", ["k", "name", "region"]), "k", 7)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.difference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")))


@query("SELECT DISTINCT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return R.dedupe(R.antijoin(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), orders, ["k"]))


@query("SELECT DISTINCT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = 2)")
def contains_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contains_chain(table(spark, sf_dir, "region"), {"r_regionkey": 2}, R.project(table(spark, sf_dir, "nation"), F.col("n_name").alias("name")))


def _by_task(df: DataFrame) -> DataFrame:
    """Dealt by task while rows are narrow, into as many parts as any shuffle: what follows of a task needs no other exchange."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t")


# probabilities: thirteenths have no ties where decimals are rounded
CHANCE = "(round(l_discount * 100) + 1) / 13"
ITEMS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FACTS_SQL = f"f AS (SELECT DISTINCT {', '.join(ITEMS)}, (round(l_discount * 100) + 1) / 13 AS p FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str, text: str, **options) -> Engine:
    engine = Engine(spark, **options).load("decl item(Int, Int, Int, Int). " + text)
    return engine.insert_prob("item", table(spark, sf_dir, "lineitem").withColumn("p", F.expr(CHANCE)), "p", ITEMS)


@query(f"WITH {FACTS_SQL} SELECT l_orderkey AS o, round(1 - product(1 - p), 6) AS prob FROM f GROUP BY l_orderkey")
def wmc_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _items(spark, sf_dir, "decl r(Int). r(O) :- item(O, _, _, _).", tag="proofs")
    return engine.with_prob("r", ["o"]).withColumn("prob", F.round("prob", 6))


@query(f"WITH {FACTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC) AS n FROM f) SELECT l_orderkey AS o, round(1 - product(1 - p), 6) AS prob FROM k WHERE n <= 2 GROUP BY l_orderkey")
def wmc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _items(spark, sf_dir, "decl r(Int). r(O) :- item(O, _, _, _).", tag="top-k-proofs", k=2)
    return engine.with_prob("r", ["o"]).withColumn("prob", F.round("prob", 6))


@query(f"WITH {FACTS_SQL} SELECT l_orderkey AS o, count(*)::INTEGER AS n FROM f GROUP BY l_orderkey")
def proofs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _items(spark, sf_dir, "decl r(Int). r(O) :- item(O, _, _, _).", tag="proofs")
    return engine.tagged("r", ["o"]).select("o", F.size(TAG).alias("n"))


@query(f"WITH {FACTS_SQL}, g AS (SELECT l_orderkey AS o, product(1 - p) AS none FROM f GROUP BY l_orderkey) SELECT o, round(1 - none, 6) AS prob, round(sum(none / (1 - p)), 6) AS slope FROM g JOIN f ON o = l_orderkey GROUP BY o, none")
def wmc_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _items(spark, sf_dir, "decl r(Int). r(O) :- item(O, _, _, _).", tag="proofs")
    slope = F.aggregate(F.map_values("grad"), F.lit(0.0), lambda a, x: a + x)
    return engine.with_gradient("r", ["o"]).select("o", F.round("prob", 6).alias("prob"), F.round(slope, 6).alias("slope"))


@query("SELECT p_partkey AS k, round(p_size / 53.0::DOUBLE * (p_partkey % 7 + 1) / 9, 6) AS prob FROM part GROUP BY ALL")
def wmc_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    engine = Engine(spark, "proofs").load("decl a(Int). decl b(Int). decl r(Int). r(K) :- a(K), b(K).")
    engine.insert_prob("a", part.select("p_partkey", (F.col("p_size") / 53).alias("p")), "p")
    engine.insert_prob("b", part.select("p_partkey", ((F.col("p_partkey") % 7 + 1) / 9).alias("p")), "p")
    return engine.with_prob("r", ["k"]).withColumn("prob", F.round("prob", 6))


@query("SELECT n_nationkey::BIGINT AS k, count(DISTINCT s_suppkey)::INTEGER AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey")
def disjunction_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation exclude each other, so only pairs of a supplier with itself are proofs."""
    engine = Engine(spark, "proofs").load("decl s(Int, Int). decl r(Int). r(N) :- s(A, N), s(B, N).")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.lit(0.01).alias("p"))
    engine.insert_disjunction("s", suppliers, "p", ["s_nationkey"])
    return engine.tagged("r", ["k"]).select("k", F.size(TAG).alias("n"))


@query("SELECT n_nationkey::BIGINT AS k, round((n_nationkey % 5 + 1) / 7.0::DOUBLE * (1 - product(1 - (s_suppkey % 10 + 1) / 13.0::DOUBLE)), 6) AS prob FROM (SELECT DISTINCT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey) GROUP BY n_nationkey")
def wmc_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All proofs of a nation share the fact that it is open."""
    engine = Engine(spark, "proofs").load("decl open(Int). decl s(Int, Int). decl r(Int). r(N) :- s(A, N), open(N).")
    engine.insert_prob("open", table(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") % 5 + 1) / 7).alias("p")), "p")
    engine.insert_prob("s", table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", ((F.col("s_suppkey") % 10 + 1) / 13).alias("p")), "p")
    return engine.with_prob("r", ["k"]).withColumn("prob", F.round("prob", 6))


# in a chain of turns, all that matters of the earlier ones is whether the last one held
_TURNS = "f AS (SELECT DISTINCT conv_id AS c, turn AS t, ((conv_id * 3 + turn * 5) % 7 + 1) / 9.0::DOUBLE AS p FROM conversations)"
_CHAIN = f"WITH RECURSIVE {_TURNS}, s AS (SELECT DISTINCT c, -1::BIGINT AS t, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM f UNION ALL SELECT s.c, s.t + 1, (a + b) * (1 - coalesce(p, 0)), a * coalesce(p, 0) FROM s LEFT JOIN f ON f.c = s.c AND f.t = s.t + 1 WHERE s.t < (SELECT max(t) FROM f))"


def _chain(spark: SparkSession, sf_dir: str) -> Engine:
    """Two turns in a row: each proof shares a fact with the one before it and with the one after it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (((F.col("conv_id") * 3 + F.col("turn") * 5) % 7 + 1) / 9).alias("p")).distinct()
    return Engine(spark, "proofs").load("decl turn(Int, Int). decl r(Int). r(C) :- turn(C, A), turn(C, B), B == A + 1.").insert_prob("turn", turns, "p")


@query(_CHAIN + " SELECT c, round(1 - (a + b), 6) AS prob FROM s WHERE t = (SELECT max(t) FROM f) AND c IN (SELECT x.c FROM f x JOIN f y ON x.c = y.c AND y.t = x.t + 1)")
def wmc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir).with_prob("r", ["c"]).withColumn("prob", F.round("prob", 6))


# the derivative by a fact: the others' chance if it holds, less that if it does not
_SLOPES = (
    f"WITH RECURSIVE {_TURNS}, g AS (SELECT x.c, x.t AS of, v FROM f x, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) AS w(v)), "
    "s AS (SELECT c, of, v, -1::BIGINT AS t, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM g UNION ALL "
    "SELECT s.c, of, v, s.t + 1, (a + b) * (1 - q), a * q FROM s LEFT JOIN f ON f.c = s.c AND f.t = s.t + 1, LATERAL (SELECT CASE WHEN s.t + 1 = of THEN v ELSE coalesce(p, 0) END AS q) WHERE s.t < (SELECT max(t) FROM f)), "
    "e AS (SELECT c, of, sum(CASE WHEN v = 1 THEN 1 - (a + b) ELSE (a + b) - 1 END) AS slope FROM s WHERE t = (SELECT max(t) FROM f) GROUP BY c, of) "
)


@query(_SLOPES + "SELECT e.c, of AS t, round(slope, 6) AS slope FROM e JOIN f ON e.c = f.c AND e.of = f.t WHERE EXISTS (SELECT 1 FROM f y WHERE y.c = e.c AND (y.t = of + 1 OR y.t = of - 1))")
def wmc_fact_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of each conversation's probability by each of its facts, joined to the fact's tuple."""
    engine = _chain(spark, sf_dir)
    slopes = engine.with_gradient("r", ["c"]).select(F.explode("grad").alias("fact", "slope"))
    return slopes.join(engine.facts("turn", ["c", "t"]), "fact").select("c", "t", F.round("slope", 6).alias("slope"))


_DIGITS = "SELECT DISTINCT l_orderkey AS t, l_linenumber - 1 AS i, v, (l_quantity::BIGINT * (v + 2) % 11 + 1) / 37.0::DOUBLE AS p FROM lineitem, (VALUES (0), (1), (2), (3)) AS x(v) WHERE l_linenumber <= 2"


@query(f"WITH d AS ({_DIGITS}), e AS (SELECT t, i, v, 1 - product(1 - p) AS p FROM d GROUP BY t, i, v) SELECT a.t, (a.v + b.v)::BIGINT AS total, round(1 - product(1 - a.p * b.p), 6) AS prob FROM e a JOIN e b ON a.t = b.t AND a.i = 0 AND b.i = 1 GROUP BY a.t, a.v + b.v")
def sum2_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many tasks in one run: the sum of two uncertain digits, one disjunction a digit.

    A digit that was read several times has several facts for a value.
    """
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("t"), (F.col("l_linenumber") - 1).alias("i"), F.col("l_quantity").cast("long").alias("q"))
    rows = _by_task(rows).select("t", "i", F.explode(F.array(*map(F.lit, range(4)))).alias("v"), "q")
    digits = rows.select("t", "i", "v", ((F.col("q") * (F.col("v") + 2) % 11 + 1) / 37).alias("p")).distinct()
    engine = Engine(spark, "proofs").load("decl digit(Int, Int, Int). decl sum(Int, Int). sum(T, A + B) :- digit(T, 0, A), digit(T, 1, B).")
    engine.insert_disjunction("digit", digits, "p", ["t", "i"], ["t", "i", "v"])
    return engine.with_prob("sum", ["t", "total"]).withColumn("prob", F.round("prob", 6))


@query("WITH d AS (SELECT DISTINCT c_custkey AS t, i, v, (c_custkey * (i + 2) + v * 3) % 5 + 1 AS w FROM customer, (VALUES (0), (1)) AS x(i), (VALUES (0), (1), (2)) AS y(v)), e AS (SELECT *, w / (sum(w) OVER (PARTITION BY t, i))::DOUBLE AS p FROM d) SELECT a.t, (a.v + b.v)::BIGINT AS total, round(sum(a.p * b.p), 6) AS prob FROM e a JOIN e b ON a.t = b.t AND a.i = 0 AND b.i = 1 GROUP BY a.t, a.v + b.v")
def wmc_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of two digits whose values exclude each other when counted, too."""
    tasks = _by_task(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("t")))
    rows = tasks.select("t", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("t", "i", F.explode(F.array(*map(F.lit, range(3)))).alias("v")).distinct()
    rows = rows.withColumn("w", (F.col("t") * (F.col("i") + 2) + F.col("v") * 3) % 5 + 1)
    total = F.sum("w").over(Window.partitionBy("t", "i"))
    digits = rows.select("t", "i", "v", (F.col("w") / total).alias("p"))
    engine = Engine(spark, "proofs").load("decl digit(Int, Int, Int). decl sum(Int, Int). sum(T, A + B) :- digit(T, 0, A), digit(T, 1, B).")
    engine.insert_disjunction("digit", digits, "p", ["t", "i"], ["t", "i", "v"])
    return engine.with_prob("sum", ["t", "total"], exclusive=True).withColumn("prob", F.round("prob", 6))


# of a ladder of edges, all that matters is whether the last two turns are reached
_STEP = "((conv_id + turn * 3) % 4 + 1) / 7.0::DOUBLE"
_LEAP = "((conv_id * 5 + turn) % 3 + 1) / 8.0::DOUBLE"
_LADDER = (
    f"WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS c, turn AS t, {_STEP} AS p, {_LEAP} AS q FROM conversations), m AS (SELECT c, max(t) AS last FROM t GROUP BY c), "
    "s AS (SELECT c, 0::BIGINT AS t, 0.0::DOUBLE AS n, 1.0::DOUBLE AS y, 0.0::DOUBLE AS yy FROM m UNION ALL "
    # n: only the turn before is reached, y: only this one, yy: both
    "SELECT s.c, s.t + 1, (y * (1 - a) + yy * (1 - a) * (1 - b)), n * b, y * a + yy * (1 - (1 - a) * (1 - b)) FROM s JOIN m ON s.c = m.c JOIN t x ON x.c = s.c AND x.t = s.t, "
    "LATERAL (SELECT x.p AS a, coalesce((SELECT q FROM t z WHERE z.c = s.c AND z.t = s.t - 1), 0) AS b) WHERE s.t < last) "
)


@query(_LADDER + "SELECT c, t, round(y + yy, 6) AS prob FROM s WHERE t > 0")
def wmc_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability over uncertain edges from each turn to the next and the one after it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")).distinct()
    to = turns.withColumnRenamed("t", "u")
    step = ((F.col("c") + F.col("t") * 3) % 4 + 1) / 7
    leap = ((F.col("c") * 5 + F.col("t")) % 3 + 1) / 8
    edges = turns.join(to, "c").where("u = t + 1 or u = t + 2").select("c", "t", "u", F.when(F.col("u") == F.col("t") + 1, step).otherwise(leap).alias("p"))
    engine = Engine(spark, "proofs").load("decl edge(Int, Int, Int). decl reach(Int, Int). reach(C, B) :- edge(C, 0, B). reach(C, D) :- reach(C, B), edge(C, B, D).")
    engine.insert_prob("edge", edges, "p", ["c", "t", "u"])
    return engine.with_prob("reach", ["c", "t"]).withColumn("prob", F.round("prob", 6))


# a graph that grows with the data: each part hangs below the one of half its number
TREE = "decl part(Int, Int). decl up(Int, Int). decl above(Int, Int). up(A, A / 2) :- part(A, _), A > 0. above(A, B) :- up(A, B). above(A, C) :- up(A, B), above(B, C)."
TREE_SQL = "WITH RECURSIVE up AS (SELECT DISTINCT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0), above AS (SELECT a, b FROM up UNION SELECT up.a, above.b FROM up JOIN above ON up.b = above.a) "
program("tc_tree", TREE, "above", ["a", "b"], PART, TREE_SQL + "SELECT a, b FROM above")


@query(TREE_SQL + "SELECT a, b FROM above WHERE a = 187")
def tc_tree_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All above one part: without demand the whole closure would be made."""
    engine = Engine(spark, demand=True).load(TREE).bind("part", table(spark, sf_dir, "part"), PART["part"][1])
    return engine.query("above(187, X)", ["a", "b"])


@query("SELECT DISTINCT n_name AS nation, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def incremental_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders and customers in twelve parts, with a run after each: the same as at once."""
    engine = Engine(spark).load(D_NATION + "decl customer(Int, Int). decl orders(Int, String). decl bought(Int, String). decl r(String, String). bought(N, P) :- orders(C, P), customer(C, N). r(N, P) :- bought(K, P), nation(K, N, _).")
    engine.bind("nation", table(spark, sf_dir, "nation"), NATION["nation"][1])
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    for k in range(12):
        engine.bind("customer", customers.where(F.pmod("c_custkey", F.lit(12)) == k), ["c_custkey", "c_nationkey"])
        engine.bind("orders", orders.where(F.pmod("o_orderkey", F.lit(12)) == k), ["o_custkey", "o_orderpriority"]).run()
    return engine.relation("r", ["nation", "priority"])


@query(PATH_SQL + "SELECT a, b FROM path")
def incremental_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted in two parts with a run between: the same as at once."""
    nation = table(spark, sf_dir, "nation")
    engine = Engine(spark).load(EDGE + "path(A, B) :- edge(A, B). path(A, C) :- edge(A, B), path(B, C).")
    engine.bind("nation", nation.where("n_nationkey % 2 = 0"), NATION["nation"][1]).run()
    engine.bind("nation", nation.where("n_nationkey % 2 = 1"), NATION["nation"][1]).run()
    return engine.relation("path", ["a", "b"])


@query("SELECT DISTINCT n_nationkey::BIGINT AS k FROM nation")
def rule_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a removed rule has derived stays; it derives nothing from later tuples."""
    engine = Engine(spark).load(D_NATION + "decl r(Int).").bind("nation", table(spark, sf_dir, "nation"), NATION["nation"][1])
    rule = engine.add_rule("r(A) :- nation(A, _, _).")
    engine.run().remove_rule(rule)
    engine.insert_rows("nation", [(1000, "nowhere", 0)])
    return engine.relation("r", ["k"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s is not None}
