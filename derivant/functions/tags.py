"""Provenance tags as columns: ⊗ is an expression, ⊕ an aggregate.

A proof is an array of facts, sorted, each with the group of facts it excludes, its
own identifier and its probability, so that neither the conflict test nor the weight
of a proof needs a table of facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tag's column name.
TAG = "_tag"
FACT = T.StructType([T.StructField("d", T.LongType()), T.StructField("f", T.LongType()), T.StructField("p", T.DoubleType())])
PROOFS = T.ArrayType(T.ArrayType(FACT))


def compatible(proof: Column) -> Column:
    """No two facts of the proof exclude each other."""
    return F.size(F.array_distinct(F.transform(proof, lambda x: x["d"]))) == F.size(proof)


def lead(tag: Column, field: str) -> Column:
    """d: the group of all proofs' first facts, if it is one; f: those facts. Null if a proof is empty."""
    d = F.get(F.get(tag, F.lit(0)), F.lit(0))["d"]
    one = F.forall(tag, lambda p: F.get(p, F.lit(0))["d"] == d)
    return F.when(one, d if field == "d" else F.array_distinct(F.transform(tag, lambda p: F.get(p, F.lit(0))["f"])))


def sorted_set(values: Column) -> Column:
    """Sorted, each once; array_distinct compares every two arrays."""

    def once(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.struct(x.alias("x"), x.eqNullSafe(y).alias("again")))
        return F.when(F.size(s) < 2, s).otherwise(F.transform(F.filter(pairs, lambda z: ~z["again"]), lambda z: z["x"]))

    # a lambda's argument is evaluated once, however often it is used
    return F.get(F.transform(F.array(F.sort_array(values)), once), F.lit(0))


class Unit:
    """Tuples are there or not; there is no tag column."""

    name, column_type = "unit", None
    keeps_proofs = False

    def one(self) -> Column | None:
        return None

    def base(self, fact: Column, group: Column, prob: Column) -> Column | None:
        return None

    def mult(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def merge(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.select(*keys).distinct()

    def added(self, full: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The tuples that are new, or have another tag, when fresh (merged) is added to full."""
        return fresh.join(full.select(*keys), list(keys), "left_anti")


class Boolean(Unit):
    """true or false; false tuples are dropped."""

    name, column_type = "boolean", T.BooleanType()

    def one(self) -> Column:
        return F.lit(True)

    def base(self, fact: Column, group: Column, prob: Column) -> Column:
        return prob > 0

    def mult(self, a: Column, b: Column) -> Column:
        return a & b

    def merge(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.bool_or(TAG).alias(TAG)).where(TAG)


class Proofs(Unit):
    """All proofs of a tuple, as a sorted set."""

    name, column_type = "proofs", PROOFS
    keeps_proofs = True

    def one(self) -> Column:
        return F.array(F.array().cast(T.ArrayType(FACT)))

    def base(self, fact: Column, group: Column, prob: Column) -> Column:
        return F.array(F.array(F.struct(group.alias("d"), fact.alias("f"), prob.alias("p"))))

    def normal(self, proofs: Column) -> Column:
        return sorted_set(proofs)

    def mult(self, a: Column, b: Column) -> Column:
        pairs = F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.sort_array(F.array_union(p, q)))))
        return self.normal(F.filter(pairs, compatible))

    def merge(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        merged = df.groupBy(*keys).agg(F.flatten(F.collect_list(TAG)).alias(TAG))
        return merged.withColumn(TAG, self.normal(F.col(TAG))).where(F.size(TAG) > 0)

    def added(self, full: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
        # only the tuples of full that fresh touches take part
        touched = full.join(fresh.select(*keys), list(keys), "left_semi").withColumn("_before", F.col(TAG))
        both = touched.unionByName(fresh.withColumn("_before", F.lit(None).cast(PROOFS)))
        merged = both.groupBy(*keys).agg(F.flatten(F.collect_list(TAG)).alias(TAG), F.first("_before", ignorenulls=True).alias("_before"))
        merged = merged.withColumn(TAG, self.normal(F.col(TAG)))
        return merged.where((F.size(TAG) > 0) & ~F.col(TAG).eqNullSafe(F.col("_before"))).select(*keys, TAG)


def weight(proof: Column) -> Column:
    """The product of the facts' probabilities."""
    return F.aggregate(proof, F.lit(1.0), lambda acc, x: acc * x["p"])


class TopKProofs(Proofs):
    """The k proofs of the largest weight; ties go to the smaller facts."""

    name = "top-k-proofs"

    def __init__(self, k: int) -> None:
        if k < 1:
            raise ValueError("k is at least 1")
        self.k = k

    def normal(self, proofs: Column) -> Column:
        ranked = sorted_set(F.transform(proofs, lambda p: F.struct((-weight(p)).alias("w"), p.alias("p"))))
        return F.transform(F.slice(ranked, 1, self.k), lambda x: x["p"])


def make(name: str, k: int = 3) -> Unit:
    kinds = {"unit": Unit, "empty": Unit, "boolean": Boolean, "proofs": Proofs}
    if name in ("top-k-proofs", "topk"):
        return TopKProofs(k)
    if name not in kinds:
        raise ValueError(f"unknown tag {name!r}")
    return kinds[name]()
