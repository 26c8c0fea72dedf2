"""Operators with the same rows in SQL, and their edges."""

import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from derivant.llm import decontaminate, mixing, token_counts, warc
from derivant.llm.queries import oracle_sql, queries

DOCS = [(i, ("Word " * (i * 7 % 40)).strip() or None, s) for i, s in enumerate(["b", "a", None, "c", "a", "", "z"] * 30)]


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return sorted((tuple(r[k] for k in sorted(range(len(columns)), key=columns.__getitem__)) for r in got.fetchall()), key=repr)


def spark_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages", "benchmark", "embeddings")}
    assert spark_rows(queries()[name](spark, sf)) == duck(oracle_sql()[name], **tables)


def test_mixing(spark):
    df = spark.createDataFrame([(*d, 1, 2) for d in [*DOCS, (None, "x y", "a"), (3, "x y", "a"), (3, "x y", "a")]], "doc_id long, text string, source string, size int, target int")
    out = mixing.mix(df)
    assert spark_rows(out.drop("copies")) == duck(mixing.SQL, documents=df.select("doc_id", "text", "source"))
    assert spark_rows(out) == spark_rows(mixing.mix(df.repartition(7)))
    total, by = 0, {}
    for r in out.collect():
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"]
        total += r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 45
    assert mixing.mix(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(empty).collect()} == {(0, 0.0, 0)}


def test_mixing_of_one_hot_size(spark):
    """A third of all rows with one source and size, ids that are multiples of 64 or negative or missing."""
    docs = [((i - 500) * 6400, f"alpha beta gamma {i}", "hot") for i in range(1000)]
    docs += [(None, f"delta {i % 90} epsilon", "hot" if i % 2 else None) for i in range(700)]
    docs += [(i * 3 - 900, "w " * (i % 50), "abc"[i % 3]) for i in range(1300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(df, carry=["text"])
    assert spark_rows(out.drop("copies", "c_text")) == duck(mixing.SQL, documents=df)
    assert spark_rows(out) == spark_rows(mixing.mix(df.repartition(9).orderBy(F.desc("text")), carry=["text"]))
    window = mixing.ID_RANGE // 64
    assert max(sum(d[0] is not None and d[0] >> mixing.RANGE_BITS == k for d in docs[:1000]) for k in range(-60, 60)) < window


def test_word_count(spark):
    df = spark.createDataFrame([("a\x0bb\x1fc d e",), (None,), (" \t\n",), ("w " * 100_000,)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [3, 0, 0, 100_000]


ITEM = "one two Three four five six seven eight nine ten eleven twelve"


def test_contained(spark):
    docs = [
        (1, "before " * 30 + ITEM.upper() + " after" * 3000),
        (2, "x " + ITEM.replace("twelve", "end") + " y"),  # 7 of 8 shingles
        (3, "x " + ITEM.replace("six", "other") + " y"),  # 3 of 8
        (4, None),
        (5, ""),
        (6, "just a short item here"),
        (7, "a short"),
        (1, "a second row"),
        (None, ITEM),
    ]
    items = [(10, ITEM), (11, "short item"), (12, None), (13, ""), (10, ITEM), (14, "never seen in any of these texts"), (None, ITEM)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, h int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    found = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contained(d, b).collect())
    assert found == [(1, 10, 8, 8), (2, 10, 8, 7), (6, 11, 1, 1)]
    assert sorted(r["doc_id"] or 0 for r in decontaminate.clean(d, b).collect()) == [3, 4, 5, 7]  # what has no id is looked at, too
    nulls = spark.createDataFrame([(None, "clean text of some words here"), (None, None), (None, ""), (None, "so " + ITEM), (8, None)], "doc_id long, text string")
    assert sorted(r["text"] or "" for r in decontaminate.clean(nulls, b).collect()) == ["", "", "", "clean text of some words here"]
    assert decontaminate.clean(d.limit(0), b).count() == 0
    assert decontaminate.contained(d.limit(0), b).count() == decontaminate.contained(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)


def test_items_that_share_a_phrase(spark):
    """A phrase in every item makes no candidates where items have shingles of their own, and is still found where it is all there is."""
    phrase = "what is the right answer to this question about"
    items = [(i, f"{phrase} " + " ".join(f"t{i}w{k}" for k in range(12))) for i in range(200)] + [(999, phrase)]
    docs = [(1, phrase), (2, f"so {phrase} nothing"), (3, f"see: {items[7][1]} end"), (4, items[8][1].replace("what is the right answer", "x")), (5, "no such words")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contained(d, b)
    assert spark_rows(out) == duck(decontaminate.SQL, documents=d, benchmark=b)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {(1, 999), (2, 999), (3, 7), (3, 999)}


def test_versions_of_an_item(spark):
    """A document holds an item if it holds one of its versions, not parts of several."""
    text = lambda i, v: " ".join(f"i{i}v{v}w{k}" for k in range(12))
    items = [(i, text(i, v)) for i in range(60) for v in (0, 1)] + [(i, text(i, 0)) for i in range(60)]
    docs = [(i, "x " + text(i, i % 2)) for i in range(60)]
    docs += [(100 + i, " ".join(text(i, 0).split()[:8]) + " y " + " ".join(text(i, 1).split()[4:])) for i in range(60)]
    found = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert spark_rows(found.select("doc_id", "item_id", "n_item", "n_shared")) == sorted(((i, i, 8, 8) for i in range(60)), key=repr)


def test_contained_by_shuffle(spark, sf, monkeypatch):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = spark_rows(decontaminate.contained(d, b))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert expected and spark_rows(decontaminate.contained(d, b)) == expected


PAGES = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, "ünique\r\n\r\n" * 3), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "same"), (2, "http://g", "same"), (6, "u", "big " * 300_000), (7, "", "tiny")]


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 1000)
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, key string, last int")
    bundles = warc.write_bundles(df)
    found = warc.read_bundles(bundles)
    assert spark_rows(found) == duck(warc.SQL, pages=df)
    for r in found.collect():
        if r["page_id"] == 3:
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(PAGES[2][2].encode()).digest()).decode()
    assert sum(r["record_type"] == "revisit" for r in found.collect()) == 3
    record = warc.find_record(bundles, 3)
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and PAGES[2][2].encode() in record
    assert warc.find_record(bundles, 12345) is None
    assert {r["record_type"] for r in warc.read_bundles(warc.write_bundles(df, 1 << 30)).collect()} == {"response"}
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


@pytest.mark.parametrize("most", [0, 200_000])
def test_warc_records_have_ids_of_their_own(spark, monkeypatch, tmp_path, most):
    """Rows that repeat a page_id, or have none, are told apart; a revisit names one record or none."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    pages = [*PAGES, (None, "n", "null one"), (None, "n", "null two"), (9, "t", "twice"), (9, "t", "twice"), (8, "t", "twice"), (6, "other", "another payload"), (10, "long", "é" * 400_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, bundle string")
    for least in (0, 6):
        bundles = warc.write_bundles(df, least)
        records = []
        for r in bundles.collect():
            reader = warc.BundleReader(bytes(r["archive"]))
            records += [warc.fields(reader.record(f, o).partition(b"\r\n\r\n")[0]) for f, o in zip(r["frames"], r["offsets"], strict=True)]
        ids = {f[b"WARC-Record-ID"]: f for f in records}
        assert len(ids) == len(records) == len(pages)
        for f in records:
            if b"WARC-Refers-To" in f:
                to = ids[f[b"WARC-Refers-To"]]
                assert to[b"WARC-Type"] == b"response" and to[b"X-Page"] == f[b"X-Refers-To-Page"] and to[b"WARC-Payload-Digest"] == f[b"WARC-Payload-Digest"]
    bundles = warc.write_bundles(df)
    found = spark_rows(warc.read_bundles(bundles))
    assert found == duck(warc.SQL, pages=df)
    assert warc.export_files(bundles, str(tmp_path / "out")).count() == bundles.count() > 1
    assert spark_rows(warc.read_files(spark, str(tmp_path / "out"))) == found
    index = warc.write_index(bundles)
    assert index.count() == len(pages)
    for page in (7, 10):
        assert warc.find_record(bundles, page, index) == warc.find_record(bundles, page) and f"X-Page: {page}\r".encode() in warc.find_record(bundles, page)
    assert warc.find_record(bundles, -5, index) is None


def test_seek_table():
    writer = warc.BundleWriter(frame_bytes=50)
    records = [warc.make_record(i, f"http://{i}", b"x" * (i * 13 % 90), "D" * 32, None) for i in range(40)]
    for i, r in enumerate(records):
        writer.add(i, r)
    archive = writer.finish()
    reader = warc.BundleReader(archive)
    assert len(reader.sizes) > 10
    assert [reader.record(f, o) for f, o in zip(writer.frames, writer.offsets, strict=True)] == records
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read() == b"".join(records)


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_token_counts(spark, sf, block):
    odd = [(900, None), (901, ""), (None, "hello world"), (902, "word " * 3000), (903, "<|endoftext|>"), (900, "again")]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(5 if block == 3 else 200).collect()] + odd
    encode = token_counts._tokenizer(token_counts.VOCABULARY).encode_ordinary
    expected = sorted(((i, len(encode(t or ""))) for i, t in docs), key=repr)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, file int")
    assert sorted(map(tuple, token_counts.token_counts(df, block=block).collect()), key=repr) == expected
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_any_text_is_encoded(spark):
    """Long runs of white space are cut where the pattern would cut them; 5 MB of one character pass."""
    encode = token_counts._tokenizer(token_counts.VOCABULARY).encode_ordinary
    for text in ("a" + " " * 30 + "b", " " * 30 + "\n" * 9 + "x", "x \t" + "\u3000" * 20 + "é", "1" + "\n" * 15, " " * 12, "a  b" + " " * 11 + "\x1cb   'll", "\x85" * 15 + "'s", ""):
        for long in (2, 10):
            assert "".join(x for x, _ in token_counts.pieces(text, long)) == text
            assert [t for x in token_counts.encoder(token_counts.VOCABULARY, long)(text) for t in x.tolist()] == encode(text)
    n = 5_000_000
    docs = [(1, " " * n + "a"), (2, "\n" * n + "b"), (3, "a" * n), (4, ("x" + " " * 999) * 2000)]
    found = dict(map(tuple, token_counts.token_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    parts = {k: [len(encode(c * m)) for c, m in x] for k, x in {1: ((" ", 200_000), (" a", 1)), 2: (("\n", 200_000), ("\n", 1), ("b", 1)), 3: (("a", 200_000),)}.items()}
    scale = (n - 1) / 200_000  # all but the last of a run of white space
    assert abs(found[1] - parts[1][0] * scale - 1) <= 2 and abs(found[2] - parts[2][0] * scale - 2) <= 2 and abs(found[3] - parts[3][0] * n / 200_000) <= 1
    assert found[4] == 1 + 1999 * (len(encode(" " * 998)) + len(encode(" x"))) + len(encode(" " * 999))


def test_wide_vocabularies(spark, tmp_path):
    """Numbers above 16 bits, and a separator that is a token."""
    import base64 as b64

    import numpy as np

    path = str(tmp_path / "wide")
    with open(path, "wb") as f:
        for k in range(256):
            f.write(b64.b64encode(bytes([k])) + b" %d\n" % (k + 70_000))
        f.write(b64.b64encode(b"ab") + b" 131072\n")
    assert token_counts.separator_of(path) == (131_073, np.uint32) and token_counts.separator_of(token_counts.VOCABULARY) == (50_256, np.uint16)
    with pytest.raises(ValueError, match="token of the vocabulary"):
        token_counts.separator_of(path, 70_005)
    df = spark.createDataFrame([(1, "abab c"), (2, ""), (3, "b" * 70)], "doc_id long, text string")
    assert dict(map(tuple, token_counts.token_counts(df, path, block=7).collect())) == {1: 4, 2: 0, 3: 70}


def test_separators_in_any_place(spark, rows):
    s = 50_256
    import numpy as np

    flat = [s, 1, 2, s, s, 3, 4, 5, 6, 7, s, 8]
    for size in (1, 2, 5, 12):
        files = [(f, k, bytes(np.array(flat[i : i + size], np.uint16))) for f in (0, 1) for k, i in enumerate(range(0, 12, size))]
        df = spark.createDataFrame(files, "file long, block long, tokens binary")
        assert rows(token_counts.count_tokens(df, s)) == [(f, k, n) for f in (0, 1) for k, n in enumerate([0, 2, 0, 5, 1])]
