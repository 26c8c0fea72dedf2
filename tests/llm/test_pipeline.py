"""The pipeline against its stages done by brute force."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from derivant.llm import decontaminate, mixing, pii, quality

from .test_duplicates import brute_components, shingles


def test_stages_one_by_one(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = P.STAGES[0][1](spark, docs, sf)
    good = {r["doc_id"] for r in quality.score(docs, labels).where("predicted = 1").collect()}
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(rows) == good and kept.columns == docs.columns

    unique = P.STAGES[1][1](spark, kept, sf)
    expected = {i for i, _, c in brute_components(sorted(rows.items()), 5, 80) if i == c}
    rows = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert set(rows) == expected and unique.columns == docs.columns

    clean = P.STAGES[2][1](spark, unique, sf)
    items = [shingles(r["text"], 5) for r in benchmark.collect()]
    sets = {i: shingles(t, 5) for i, t in rows.items()}
    expected = {i for i, s in sets.items() if not any(q and len(q & s) >= 0.8 * len(q) for q in items)}
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(rows) == expected != set(sets) and clean.columns == docs.columns

    hidden = P.STAGES[3][1](spark, clean, sf)
    out = {r["doc_id"]: r for r in hidden.collect()}
    assert set(out) == expected and hidden.columns == docs.columns
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(clean).collect()}
    for i, r in out.items():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        assert (r["text"] == rows[i]) == (spans[i] == "")

    mixed = P.STAGES[4][1](spark, hidden, sf).collect()
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(hidden).collect() if r["copies"]}
    copies: dict = {}
    for r in mixed:
        assert r["text"] == out[r["doc_id"]]["text"]
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert {i: len(c) for i, c in copies.items()} == taken and all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())


def test_run_and_empty_tables(spark, sf, tmp_path):
    assert P.run(spark, sf).count() > 50
    assert [n for n, _ in P.STAGES] == ["quality", "ngram_join", "decontaminate", "pii", "mixing"]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_native_stages_run_no_python(spark, sf):
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    for df in (decontaminate.clean(docs, benchmark), mixing.mix(docs, carry=["text"]), docs.select(F.length("text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_rows_in_every_stage(spark, sf, tmp_path):
    """Null and repeated ids, null and empty texts, columns with clashing names: no stage fails or adds a column."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.where("length(text) > 300").orderBy("doc_id").first()["text"]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    odd = spark.createDataFrame([(None, text, None, None, 1), (None, None, "x", "y", None), (3, text + " more", None, "web", 5), (3, "", None, None, 0), (None, text + " " + item, None, None, 9), (900001, "mail a@b.com " + text, None, None, 2)], docs.schema)
    docs = docs.unionByName(odd)
    for extra in ("copy", "size", "_k", "block", "kinds"):
        docs = docs.withColumn(extra, F.lit("z"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").withColumn("text2", F.lit(1)).write.parquet(f"{tmp_path}/{t}.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == list(P.COLUMNS), name
        rows = kept.collect()
        kept = spark.createDataFrame(rows, kept.schema)
        for extra in ("id", "n", "hit", "text_", "s"):
            kept = kept.withColumn(extra, F.lit(1))
        assert not any(r["doc_id"] is None and item in (r["text"] or "") for r in rows) or name in ("quality", "ngram_join")
    assert P.STAGES[-1][1](spark, kept, str(tmp_path)).where("text is null or copy not in (1, 2)").count() == 0
