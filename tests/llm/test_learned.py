"""Quality and language: held-out accuracy, folds, edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from derivant.llm import langid, quality


def test_quality_on_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(docs, labels)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    pairs = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]]
    good, bad = [r["score"] for r, y in pairs if y == 1], [r["score"] for r, y in pairs if y == 0]
    assert sum((a > b) for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r["predicted"] == y for r, y in pairs) / len(pairs) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(["a b c", "", None, "x " * 50_000, "|||| ||| !!"])] + [(None, "a", 0), (1, "again", 0)], "doc_id long, text string, id int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(0, 1), (0, 1), (1, None), (3, 1), (3, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    rows = quality.score(docs, some).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert quality.score(docs.limit(0), some).count() == 0
    assert quality.keep_good(docs, some).columns == docs.columns and quality.keep_good(docs, none).count() == 7
    assert quality.keep_good(docs.limit(0), some).count() == 0
    odd = docs.withColumn("held_out", F.lit("q")).withColumn("x", F.lit(None).cast("int"))
    assert sorted(map(repr, quality.score(odd, some).collect())) == sorted(map(repr, rows))


def slow_quality(docs, labels):
    """The scores of (doc_id, text) rows: the same risk, on plain arrays of all learning rows at once."""
    x = quality.features(pa.array([t for _, t in docs], pa.string())).astype(np.float32).astype(float)
    learn = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in docs])
    positive = np.array([labels.get(i) == 1 for i, _ in docs])[learn]
    mean, scale = x[learn].mean(0), np.sqrt(np.maximum(x[learn].var(0), 1e-8))
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    u = z[learn]
    loss = lambda v: np.log1p(np.exp(-np.abs(v))) + np.maximum(v, 0)
    hold = lambda v: 1 / (1 + np.exp(-v))
    ridge = quality.RIDGE * np.eye(u.shape[1])
    ridge[-1, -1] = 0

    def fit(w, prior, rounds):
        for _ in range(rounds):
            s = hold(u @ w)
            curve = (u.T * (s * (1 - s))) @ u / len(u) + ridge + 1e-9 * np.eye(len(w))
            negatives = u.T @ s / len(u) - prior * u[positive].T @ s[positive] / positive.sum()
            if loss(u @ w).mean() < prior * loss(u[positive] @ w).mean():
                w = w + 0.5 * np.linalg.solve(curve, negatives)
                continue
            step = np.linalg.solve(curve, u.T @ s / len(u) - prior * u[positive].mean(0) + ridge @ w)
            step *= min(1, 4 / np.abs(step).max())
            w = w - step
            if np.abs(step).max() < 1e-3:
                break
        return w

    w = fit(np.zeros(u.shape[1]), 0.5, 5)
    s, best = hold(u @ w), (math.inf, None)
    slack = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(len(u)) + 1 / math.sqrt(positive.sum()))
    for edge in [-1.0, *hold(np.linspace(-12, 12, quality.BINS - 1))]:
        above, above_p = (s > edge).mean(), (s[positive] > edge).mean()
        if above_p > 0.01 and (above + slack) / above_p < best[0]:
            best = (above + slack) / above_p, above / above_p
    w = fit(w, min(max(best[1], 0.01), 0.99), quality.ROUNDS)
    return hold(z @ w)


def test_quality_against_plain_arrays(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = slow_quality(rows, {r["doc_id"]: r["quality"] for r in labels.collect()})
    found = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert max(abs(found[i]["score"] - p) for (i, _), p in zip(rows, expected.tolist(), strict=True)) < 0.01
    assert all(found[i]["predicted"] == (p >= 0.5) for (i, _), p in zip(rows, expected.tolist(), strict=True) if abs(p - 0.5) > 0.01)
    again = {r["doc_id"]: r for r in quality.score(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == found


def test_labels_of_held_out_rows_are_never_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(docs, x).collect())) for x in (labels, turned))
    assert [r[:2] for r in a] == [r[:2] for r in b] and all(x[2] == pytest.approx(y[2], abs=1e-6) for x, y in zip(a, b, strict=True))


def test_language_on_held_out_documents(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.join(langid.identify(docs), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_mixture_and_edges(spark):
    random.seed(2)
    words = {"aa": ["ababa", "bab", "abba", "baba"], "zz": ["zyx", "yzzy", "xyz", "zzx"]}
    text = lambda lang, n: " ".join(random.choice(words[lang]) for _ in range(n))
    learn = [(i, text(x, 40), x) for i, x in enumerate(["aa", "zz"] * 20)]
    odd = [(100, text("aa", 60) + " " + text("zz", 20), None), (101, "", "aa"), (102, None, "aa"), (103, "123 !?", "zz"), (None, text("zz", 9), "aa"), (104, "É", None), (0, text("zz", 30), None), (105, text("aa", 300_000), None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in learn + odd], "doc_id long, text string, lang string, held_out string, score int")
    rows = langid.identify(docs).collect()
    assert len(rows) == 48
    by = {r["doc_id"]: r for r in rows if r["doc_id"] != 0}
    assert by[100]["lang_pred"] == "aa" and by[100]["score"] == pytest.approx(0.75, abs=0.05)
    assert [by[i]["lang_pred"] for i in (101, 102, 103, 105, None)] == ["und", "und", "und", "aa", "zz"] and by[101]["score"] == 0
    assert by[104]["lang_pred"] in ("aa", "zz") and by[None]["held_out"]
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and langid.identify(docs.limit(0)).count() == 0


def test_a_text_does_not_depend_on_the_texts_beside_it(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, table = langid.train(docs)
    random.seed(3)
    by = {x: " ".join(r["text"] or "" for r in docs.where(F.col("lang") == x).limit(20).collect()).split() for x in langs}
    texts = [" ".join(random.choice(by[x]) for x in random.choices(langs, [random.random() ** 2 for _ in langs], k=random.randrange(4, 200))) for _ in range(300)]
    together = langid.predict_batch(pa.array(texts), langs, table)
    alone = [langid.predict_batch(pa.array([t]), langs, table) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.abs(together[1] - np.array([a[1][0] for a in alone])).max() < 1e-6
    assert [[x for x, _ in m] for m in together[2]] == [[x for x, _ in a[2][0]] for a in alone] and max(map(len, together[2])) > 1
    for name, score, mix in zip(*together, strict=True):
        assert mix[0] == (name, pytest.approx(score)) and sum(p for _, p in mix) == pytest.approx(1, abs=1e-3)


def slow_languages(docs):
    """(language, proportion) of each (doc_id, text, lang): counts and mixtures word by word, without arrays."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t).encode()

    def words(text):
        for w in lower(text or "").split():
            w = b" " + w + b" "
            yield [((w[i] << 16 | w[i + 1] << 8 | w[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - langid.BITS for i in range(len(w) - 2)]

    counts: dict = {}
    for i, text, lang in docs:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            mine = counts.setdefault(lang, {})
            for w in words(text):
                for c in w:
                    mine[c] = mine.get(c, 0) + 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + langid.SMOOTH * 2**langid.BITS for x in langs}
    out = []
    for _, text, _ in docs:
        like = []
        for w in words(text):
            log = [sum(math.log((counts[x].get(c, 0) + langid.SMOOTH) / total[x]) for c in w) for x in langs]
            like.append([math.exp(v - max(log)) + 1e-12 for v in log])
        if not langs or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue

        def mixture(share, rounds, like=like):
            for _ in range(rounds):
                new = [0.0] * len(langs)
                for row in like:
                    part = [p * q for p, q in zip(row, share, strict=True)]
                    new = [n + p / sum(part) / len(like) for n, p in zip(new, part, strict=True)]
                far = max(abs(a - b) for a, b in zip(new, share, strict=True))
                share = new
                if far < 2e-3:
                    break
            return share

        share = mixture([1 / len(langs)] * len(langs), langid.ROUNDS)
        order = sorted(range(len(langs)), key=lambda k: (-share[k], k))
        if len(langs) == 1 or share[order[1]] <= 0.02:
            out.append((langs[order[0]], 1.0))
            continue
        best = (-math.inf, None)
        for k in range(1, len(langs) + 1):
            s = [(share[j] + 1e-6) if j in order[:k] else 0.0 for j in range(len(langs))]
            s = [x / sum(s) for x in s]
            if k > 1:
                s = mixture(s, langid.REFINE)
            value = sum(math.log(sum(p * q for p, q in zip(row, s, strict=True))) for row in like) - (k - 1) * math.log(max(len(like), 2))
            if value > best[0]:
                best = value, s
        top = max(range(len(langs)), key=lambda j: (best[1][j], -j))
        out.append((langs[top], best[1][top]))
    return out


def test_language_word_by_word(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(90).collect()]
    rng = random.Random(6)
    docs += [(7000 + k, " ".join(" ".join(rng.choice(docs)[1].split()[:25]) for _ in range(3)), None) for k in range(30)] + [(8000, None, "xx"), (8001, "12 34", None), (8002, "", "yy")]
    expected = slow_languages(docs)
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    close = [abs(found[i]["score"] - p) < 0.02 and found[i]["lang_pred"] == x for (i, _, _), (x, p) in zip(docs, expected, strict=True)]
    assert sum(close) >= len(close) - 1  # two sets may be as likely as the other up to the last bit


def test_many_languages(spark, monkeypatch):
    """A smaller table for each of more languages, and a clear refusal beyond that."""
    monkeypatch.setattr(langid, "TABLE_NUMBERS", 40 << 10)
    assert [langid.bits_for(n) for n in (1, 3, 40, 160)] == [14, 13, 10, 8] and (langid.BITS, langid.LEAST_BITS) == (14, 8)
    docs = [(i, f"q{i % 100:03d}w " * 30, f"l{i % 100:03d}") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = frame.join(langid.identify(frame), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.9
    with pytest.raises(ValueError, match="161 languages"):
        langid.bits_for(161)
