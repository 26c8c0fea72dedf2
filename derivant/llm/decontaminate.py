"""Benchmark decontamination: size-partitioned MinHash containment search.

DataFrame operations only. Test items are short and documents long, so their Jaccard
similarity says nothing; what counts is how much of an item a document contains.
Items are partitioned by size class (powers of two of their shingle counts). Each
class has a bottom-k MinHash sketch whose k follows from the class's upper size and
the threshold: of any (1 - t) n + 1 shingles at least one lies in a document that
holds t n of the n, so a document that holds none of an item's k smallest hashes
cannot contain it. The search therefore misses nothing. That holds for any order of the
hashes, so those that many items share come last, by powers of two: a phrase that opens
every question brings no candidates as long as an item has enough others. Every shingle of every
document, of any length, probes the sketches; candidates are then verified by
exact containment of the shingles as text. A text is split once, for all widths, and of
a candidate's shingles only those go on that are an item's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

WORDS, THRESHOLD = 5, 0.8
#: Sketches and items' shingles are broadcast up to this many rows; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of other characters than space and 0x09-0x0D."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _hash_at(ws: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(ws, i + k) for k in range(n)])


def _all_shingles(ws: Column, widths: list[int], name: str, shingle) -> Column:
    """The distinct (width, shingle(words, place, width)) of an array of words, for all widths at once."""

    def of(n: int) -> Column:
        at = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
        # distinct before they are structs, whose distinct is quadratic
        return F.transform(F.array_distinct(F.transform(at, lambda i: shingle(ws, i, n))), lambda x: F.struct(F.lit(n).alias("width"), x.alias(name)))

    return of(widths[0]) if len(widths) == 1 else F.concat(*map(of, widths))


def _text_at(ws: Column, i: Column, n: int) -> Column:
    return F.array_join(F.slice(ws, i + 1, F.lit(n)), " ")


def _items(benchmark: DataFrame, n: int, id_column: str, text_column: str) -> DataFrame:
    """(item_id, version, width, n_item, shingle, h): an item with fewer words is one shingle of its own width.

    Each distinct set of shingles of an item_id is a version of its own.
    """
    base = benchmark.select(F.col(id_column).cast("long").alias("item_id"), words(F.col(text_column).cast("string")).alias("ws")).where("size(ws) > 0")
    width = F.least(F.size("ws"), F.lit(n))
    cut = F.transform(F.sequence(F.lit(0), F.size("ws") - width), lambda i: F.struct(F.array_join(F.slice("ws", i + 1, width), " ").alias("shingle"), F.coalesce(*[F.when(width == k, _hash_at(F.col("ws"), i, k)) for k in range(1, n + 1)]).alias("h")))
    base = base.select("item_id", width.alias("width"), F.array_sort(F.array_distinct(cut)).alias("s")).where("item_id is not null").dropDuplicates()
    base = base.withColumn("version", F.row_number().over(Window.partitionBy("item_id").orderBy("width", "s")))
    return base.select("item_id", "version", "width", F.size("s").alias("n_item"), F.explode("s").alias("s")).select("item_id", "version", "width", "n_item", "s.shingle", "s.h")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _matches(base: DataFrame, benchmark: DataFrame, n: int, threshold: float, item_id: str, item_text: str) -> DataFrame:
    """(_k, _null, item_id, n_item, n_shared) of base(_k, _null, text)."""
    key = ["_k", "_null"]
    items = _items(benchmark, n, item_id, item_text)
    # k of the size class: enough for its largest member
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double"))))
    k = top - F.ceil(F.lit(threshold) * top - F.lit(1e-9)) + 1
    items = materialize(items.withColumn("k", k.cast("int")), "items")
    often = items.groupBy("width", "h").agg(F.floor(F.log2(F.count("*").cast("double"))).alias("often"))
    sketch = items.join(often, ["width", "h"]).groupBy("item_id", "version", "width", "n_item", "k")
    sketch = sketch.agg(F.sort_array(F.collect_set(F.struct("often", F.xxhash64("h").alias("order"), F.col("h")))).alias("s"))
    sketch = sketch.select("item_id", "version", "width", "n_item", F.explode(F.slice(F.col("s"), F.lit(1), F.col("k"))).alias("s")).select("width", F.col("s.h").alias("h"), "item_id", "version", "n_item")
    facts = items.agg(F.collect_set("width").alias("widths"), F.count("*").alias("rows")).first()
    widths, rows = sorted(facts["widths"]), facts["rows"]  # a sketch has no more rows than its items have shingles
    if not widths:
        return base.select(*key, F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_item"), F.lit(0).cast("long").alias("n_shared")).where(F.lit(False))
    split = base.where("text is not null").select(*key, words(F.col("text")).alias("ws"))
    probe = split.select(*key, F.explode(_all_shingles(F.col("ws"), widths, "h", _hash_at)).alias("s")).select(*key, "s.width", "s.h")
    candidates = materialize(probe.join(_small(sketch, rows), ["width", "h"]).select(*key, "item_id", "version", "width", "n_item").distinct(), "candidates")
    texts = split.join(candidates.select(*key).distinct(), key, "left_semi")
    exact = texts.select(*key, F.explode(_all_shingles(F.col("ws"), widths, "shingle", _text_at)).alias("s")).select(*key, "s.width", "s.shingle")
    exact = exact.join(_small(items.select("width", "shingle").distinct(), rows), ["width", "shingle"], "left_semi").distinct()
    wanted = candidates.join(items.select("item_id", "version", "width", "n_item", "shingle"), ["item_id", "version", "width", "n_item"])
    shared = exact.join(wanted, [*key, "width", "shingle"]).groupBy(*key, "item_id", "version", "n_item").agg(F.countDistinct("shingle").alias("n_shared"))
    good = shared.where(F.col("n_shared") * 1_000_000 >= F.col("n_item") * math.ceil(threshold * 1_000_000 - 1e-6))
    return good.groupBy(*key, "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("part"), "n_item", "n_shared")).alias("b")).select(*key, "item_id", "b.n_item", "b.n_shared")


def contained(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): the items of which a document holds threshold of the n-word shingles.

    A null or empty text on either side contains nothing and is contained in nothing;
    rows that repeat a doc_id or item_id are one document or several versions of one
    item (each is searched by itself, and the best one counts, of equal ones the longest); a null id is never reported; an empty table on
    either side gives no rows; further columns are ignored.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("_k"), F.lit(False).alias("_null"), F.col(doc_text).cast("string").alias("text")).where("_k is not null")
    return _matches(base, benchmark, n, threshold, item_id, item_text).select(F.col("_k").alias("doc_id"), "item_id", "n_item", "n_shared")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs whose document contains no item; all columns stay as they are.

    Rows that repeat a doc_id are one document, so they go or stay together; a row
    without a doc_id is a document by itself, known by its text; rows with a null or
    empty text stay; an item with a null item_id counts for nothing; with an empty
    benchmark all rows stay, and an empty table stays empty.
    """
    number, text = docs[doc_id].cast("long"), docs[doc_text].cast("string")
    key = F.coalesce(number, F.xxhash64(text)), number.isNull()
    base = docs.select(key[0].alias("_k"), key[1].alias("_null"), text.alias("text"))
    found = _matches(base, benchmark, n, threshold, item_id, item_text).select(F.col("_k").alias("_leak"), F.col("_null").alias("_leak_null")).distinct()
    found = materialize(found, "leaks")  # its size is known before the texts are joined with it
    return docs.join(_small(found, found.count()), (key[0] == F.col("_leak")) & (key[1] == F.col("_leak_null")), "left_anti")


#: The rows of contained(documents, benchmark) in DuckDB, by plain comparison of all shingles.
SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[k : k + least(len(w), 5) - 1], ' ') AS s FROM iw, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM dw, (SELECT DISTINCT n FROM i), unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
c AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_item::INTEGER AS n_item, count(*) AS n_shared FROM d JOIN i USING (n, s) JOIN c USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 10 >= n_item * 8
"""
