"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Targets: the sources, by code point with null last, weigh 3, 1, 2, repeating, and
share ``share`` times all words; a target stops at ``limit`` times its source's
words, the excess being reshared by weight until none is above. That fixed point
is min(limit * size, weight * level) and the level follows from one prefix sum
over the sources in the order in which they reach their limit.

Copies: all documents of a source expect target / source size copies. The expected
copies are prefix-summed within the source in order of size, one random offset per
source is added, and a document is emitted once per integer boundary that its
interval crosses. In order of size, neighbours in the sum are alike, so the words
taken stay within about one document of the target. The prefix sum has three levels:
ranks inside (source, size class, id class, size, id range), offsets of these ranges
inside (source, size class, id class), and offsets of the classes. A range holds at most
``ID_RANGE`` ids of one size, so neither a source with a third of all rows nor a size
that so many texts have, nor ids that are all multiples of some number, is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

WEIGHTS = (3, 1, 2)
SHARE, LIMIT, SEED = 1.5, 2.0, "mix-1"
SIZE_CLASS, ID_CLASSES = 16, 64
#: Ids that agree but for their last bits are one range; rows without an id are dealt to so many.
RANGE_BITS, NULL_RANGES = 16, 4096
ID_RANGE = 1 << RANGE_BITS


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space and 0x09-0x0D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(_src, _source_size, _target, _rate) of each source of sizes(_src, _source, _size)."""
    per = sizes.groupBy("_src").agg(F.first("_source").alias("_source"), F.sum("_size").alias("_source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    all_ = Window.partitionBy()
    per = per.select("_src", F.col("_source_size"), F.col("_source_size").cast("double").alias("_s"), weight.alias("_w"), F.col("_source"))
    per = per.withColumn("_ratio", F.lit(limit) * F.col("_s") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    since = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.select(
        "*",
        F.row_number().over(order).alias("_k"),
        ((F.lit(share) * F.sum("_s").over(all_) - F.lit(limit) * F.coalesce(F.sum("_s").over(before), F.lit(0.0))) / F.sum("_w").over(since)).alias("_level"),
    )
    level = F.min_by(F.when(F.col("_ratio") > F.col("_level"), F.col("_level")), F.when(F.col("_ratio") > F.col("_level"), F.col("_k"))).over(all_)
    target = F.least(F.lit(limit) * F.col("_s"), F.col("_w") * F.coalesce(level, F.lit(float("inf"))))
    per = per.select("_src", "_source_size", "_s", target.alias("_target"))
    return per.select("_src", "_source_size", "_target", F.when(F.col("_s") > 0, F.col("_target") / F.col("_s")).otherwise(F.lit(0.0)).alias("_rate"))


def mix(docs: DataFrame, carry: Sequence[str] = (), id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) and the columns in carry, renamed to c_<name>.

    One row per input row; copies is 0, 1 or 2. A null or empty text has size 0 and
    takes nothing; sources with only such texts have target 0; a null source is a
    source of its own; rows that tie in size and id are in order of a hash of their
    text, so reruns take the same of them; rows without an id come first, in that
    order; an empty table gives no rows; clashing names in further columns do not matter.
    """
    source = F.col(source_column).cast("string")
    base = docs.select(
        F.col(id_column).cast("long").alias("_id"),
        word_count(F.col(text_column)).alias("_size"),
        source.alias("_source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("_src"),
        F.xxhash64(F.col(text_column).cast("string")).alias("_tie"),
        *[F.col(c).alias(f"c_{c}") for c in carry],
    )
    base = base.withColumn("_class", F.floor(F.col("_size") / SIZE_CLASS)).withColumn("_sub", F.coalesce(F.pmod("_id", F.lit(ID_CLASSES)), F.lit(-1)))
    base = base.withColumn("_range", F.coalesce(F.shiftright("_id", RANGE_BITS), F.pmod("_tie", F.lit(NULL_RANGES))))
    keys, ranges = ["_src", "_class", "_sub"], ["_src", "_class", "_sub", "_size", "_range"]
    # texts are counted once, or twice if columns are carried along
    slim = materialize(base.select("_id", "_tie", "_source", *ranges), "sizes")
    base = base if carry else slim
    inner = Window.partitionBy(*ranges).orderBy("_id", "_tie")
    ranked = base.drop("_source").withColumn("_rank", F.row_number().over(inner))
    counts = slim.groupBy(*ranges).agg(F.count("*").alias("_n"))
    middle = Window.partitionBy(*keys).orderBy("_size", "_range").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select(*ranges, F.coalesce(F.sum("_n").over(middle), F.lit(0)).alias("_within"))
    outer = Window.partitionBy("_src").orderBy("_class", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy(*keys).agg(F.sum("_n").alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"))
    offsets = within.join(classes, keys).withColumn("_before", F.col("_before") + F.col("_within")).drop("_within")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_src"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    offsets = offsets.join(targets(slim), "_src").withColumn("_start", start)
    rank = (F.col("_rank") + F.col("_before")).cast("double")
    crossed = F.floor(F.col("_rate") * rank + F.col("_start")) - F.floor(F.col("_rate") * (rank - 1) + F.col("_start"))
    copies = F.least(crossed, F.lit(2)).cast("long")
    joined = ranked.join(offsets, ranges)
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("_size")).alias("taken"),
        *[f"c_{c}" for c in carry],
    )


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), p AS (
  SELECT src, first(source) AS source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE AS s FROM d GROUP BY src
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM p
), r AS (SELECT *, 2.0::DOUBLE * s / w AS ratio FROM w), l AS (
  SELECT *, row_number() OVER o AS k,
    (1.5::DOUBLE * sum(s) OVER () - 2.0::DOUBLE * coalesce(sum(s) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)
), t AS (
  SELECT *, least(2.0::DOUBLE * s, w * coalesce((SELECT arg_min(level, k) FROM l WHERE ratio > level), 'inf'::DOUBLE)) AS target FROM l
), q AS (
  SELECT src, source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1' || src), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start FROM t
), k AS (
  SELECT d.*, q.source_size, q.target, q.rate, q.start,
    row_number() OVER (PARTITION BY d.src ORDER BY size // 16, coalesce(((doc_id % 64) + 64) % 64, -1), size, doc_id NULLS FIRST)::DOUBLE AS rank
  FROM d JOIN q USING (src)
)
SELECT doc_id, size, source_size, target,
  (least(floor(rate * rank + start) - floor(rate * (rank - 1) + start), 2) * size)::BIGINT AS taken FROM k
"""
