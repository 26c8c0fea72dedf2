import hashlib
import math
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from derivant.llm import pii


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        double = [int(c) for c in digits[::-1]]
        double[1::2] = [2 * x - 9 * (x > 4) for x in double[1::2]]
        if 12 <= len(digits) <= 19 and sum(double) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a-.@1259+0 ()é%", max_size=60))
def test_base_spans(text):
    assert sorted((a, k, b) for k, a, b in pii.base_spans(text)) == brute(text)


def test_examples():
    text = "é 4111 1111 1111 1111, a.b@c.d@e.f.g +1 (555) 555-0100 1.2.3.4.5.6.7.255 00300.1.1.1 4111111111111112"
    assert sorted((a, k, b) for k, a, b in pii.base_spans(text)) == brute(text)
    assert pii.base_spans("a" * 300_000 + "@" * 1000 + "1" * 300_000) == []


DOCS = [
    (1, "mail x@y.com or call +1 (555) 555-0100, card 4111 1111 1111 1111 from 10.0.0.1"),
    (2, 'token = "0123456789abcdef0123456789abcdef" and 212-555-0187, phone 212-555-0188'),
    (3, None),
    (4, ""),
    (None, "x@y.com"),
    (4, "x@y.com " * 5000),
    (5, "nothing here"),
]


def test_find(spark):
    df = spark.createDataFrame([(*d, "kinds", 3) for d in DOCS], "doc_id long, text string, kinds string, id int")
    found = pii.find_pii(df).collect()
    assert len(found) == len(DOCS)
    by = {(r["doc_id"], r["n_email"]): r for r in found}
    one = by[(1, 1)]
    assert (one["n_ip"], one["n_card"], one["n_phone"]) == (1, 1, 1)
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute(DOCS[0][1]))
    assert one["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and base in one["spans"]
    assert "secret:9:41" in by[(2, 0)]["spans"]
    assert by[(3, 0)]["base_sha256"] == hashlib.sha256(b"").hexdigest() == by[(4, 0)]["base_sha256"]
    assert by[(4, 5000)]["n_email"] == 5000 and (None, 1) in by
    assert pii.find_pii(df.limit(0)).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, extra string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).where("doc_id < 4").collect()}
    assert out[1] == "mail <EMAIL> or call <PHONE>, card <CARD> from <IP>" and out[3] is None
    assert pii.redact(df).columns == df.columns and pii.redact(df).count() == len(DOCS)
    assert pii.redact(df.limit(0)).count() == 0
    odd = df.select("text", F.col("doc_id").alias("x"), F.lit(1).alias("kinds"), F.array(F.lit("q")).alias("a.b"))
    assert [r["text"] for r in pii.redact(odd, id_column="x").where("x < 2").collect()] == [out[1]] and pii.redact(odd, id_column="x").columns == odd.columns


def test_reliabilities():
    """Labelers that agree outweigh one that does not."""
    good, bad = pii._pattern(4, (1, 1, 1, 1, 1), 12), pii._pattern(4, (-1, -1, -1, -1, 1), 12)
    soft = pii.estimate({good: 50, bad: 50})
    assert soft[good] > 0.9 > 0.1 > soft[bad]


def slow_learner(texts):
    """The weights by kind, from every candidate by itself: votes, posteriors by repeated averaging, and plain gradient steps."""
    spans = [(t, *c) for t in texts for c in pii.candidates(t or "")]
    post = {}
    for kind in {s[1] for s in spans}:
        mine = [s for s in spans if s[1] == kind]
        votes = [pii.votes(s[0], *s[1:4]) for s in mine]
        p = [1 / (1 + math.exp(-sum(v))) for v in votes]
        for _ in range(100):
            prior = (sum(p) + 2) / (len(p) + 4)
            log = [math.log(prior / (1 - prior))] * len(p)
            for j in range(pii.LABELERS):
                yes = {v: sum(q for q, w in zip(p, votes, strict=True) if w[j] == v) + 1 + v / 2 for v in (-1, 0, 1)}
                no = {v: sum(1 - q for q, w in zip(p, votes, strict=True) if w[j] == v) + 1 - v / 2 for v in (-1, 0, 1)}
                for k, w in enumerate(votes):
                    log[k] += math.log(yes[w[j]] / sum(yes.values())) - math.log(no[w[j]] / sum(no.values()))
            p = [1 / (1 + math.exp(-max(-30, min(30, x)))) for x in log]
        for s, q in zip(mine, p, strict=True):
            post[s[:4]] = q
    weights = {}
    for kind in {s[1] for s in spans}:
        x = np.array([pii.span_features(s[0], *s[2:4]) for s in spans if s[1] == kind], np.float32).astype(float)
        y = np.array([post[s[:4]] for s in spans if s[1] == kind])
        w = np.zeros(pii.FEATURES)
        rate = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 / len(x) + pii.RIDGE)
        for _ in range(20_000):
            w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x) + pii.RIDGE * w)
        weights[kind] = w
    return weights


def test_added_spans_against_the_slow_learner(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    make = [
        lambda: f"call {rng.choice(['phone', 'tel', 'order', word()])} {number(3)}-{number(3)}-{number(4)}",
        lambda: f"{rng.choice(['ssn', 'page', word()])} {rng.choice(['000', number(3)])}-{number(2)}-{number(4)}",
        lambda: f"{word()} (at) {word()}.{rng.choice(['com', 'org', word()])}",
        lambda: f"{rng.choice(['token', 'password', 'api_key'])} = {rng.choice([number(20), word() * 4 + number(9), 'a' * 30, word() * 5])}",
        lambda: f"{word()}@{word()}.com",
    ]
    texts = [" ".join(rng.choice([word, word, *make])() for _ in range(rng.randrange(12))) for _ in range(60)] + [None, ""]
    found = pii.find_candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    w, slow = pii.learn(found), slow_learner(texts)
    for kind, expected in slow.items():
        x = np.array([pii.span_features(t, a, b) for t in texts for k, a, b, _ in pii.candidates(t or "") if k == kind])
        assert np.abs(x @ w[kind] - x @ expected).max() < 0.05
    rows = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = [(k, a, b, None if k < pii.BASE else float(np.dot(pii.span_features(t, a, b), slow[k]))) for k, a, b, _ in pii.candidates(t or "")]
        if all(z is None or abs(z) > 0.05 for *_, z in spans):
            assert rows[i]["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b, z in spans if z is None or z >= 0)
            assert rows[i]["n_spans"] == rows[i]["n_added"] + sum(rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone"))


def test_many_spans_take_time_in_proportion():
    """A list of contacts of two megabytes: no span is compared with all others."""
    text = "".join(f"a{i}@b.com 212-555-0{i % 1000:03d} token=abcdefgh{i:09d}x " for i in range(20_000))
    start = time.perf_counter()
    found = pii.candidates(text)
    assert len(found) == 60_000 and time.perf_counter() - start < 20
    some = pii.candidates(text[:3000])
    assert found[: len(some) - 2] == some[:-2]


def test_query_over_the_whole_table(spark, sf):
    from derivant.llm.queries import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op1_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [r[f"n_{pii.KINDS[k]}"] for k in range(4)] == [sum(s[1] == k for s in base) for k in range(4)]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r["spans"].split(","))


def test_loose_spans_of_any_length(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    card = "4111111111111111"
    for value in ("Ab3" * 200, jwt, "a1.b2.c3.d4.e5.f6", "Zz9" * 100 + "/" + card + "/" + "Zz9" * 20):
        text = f'the token = "{value}", and more'
        assert (7, 13, 13 + len(value)) in [c[:3] for c in pii.candidates(text)]
        assert (7, 7, 7 + len(value)) in [c[:3] for c in pii.candidates(f"token: {value}. Next")]
    assert [c for c in pii.candidates("token: abcdefghijklmno. short") if c[0] == 7] == []
    assert [c[:3] for c in pii.candidates("token:secret = 0123456789abcdef")] == [(7, 15, 31)]
    name, domain = "n" * 300, ".".join(["d" * 70] * 6) + ".com"
    assert [c[:3] for c in pii.candidates(f"mail {name} (at) {domain}")] == [(6, 5, 5 + 300 + 6 + len(domain))]
    assert pii.candidates("n" * 500_000 + "(at) " * 10_000 + "key=" + "." * 500_000) == []
    long = "Ab3" * 200
    docs = [(i, f"call api_key={long} now") for i in range(20)]
    out = pii.redact(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["text"] for r in out} == {"call api_key=<SECRET> now"}
