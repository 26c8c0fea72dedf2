"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the principal components is learned on a bounded sample so that the
signs, cut at the medians, are balanced codes. Their recall is measured by comparing
some vectors with all others, by bands of the cosine; where it is short, signs without
centring are tried, and if these fall short too, every pair is compared. Every vector
is indexed in ``TABLES`` tables under its substring of the code and all
substrings one bit away; two vectors whose substrings differ by two bits at most in some table therefore share a key. Of
the keys that a pair shares one owns it (the first table, the smallest key), so each
pair is looked at once and counted once. Pairs within ``HAMMING`` bits are reranked by
the cosine of the original vectors in double precision.

Equal vectors are one class from the start, known by two hashes of 64 bits and counted
by its size, so a vector that occurs a million times is indexed once.

Codes travel to all keys, vectors only to keys where they have such a pair. Keys with
many vectors are cut into pairs of chunks; what leaves a task is a count per vector
and a star of each component of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import materialize, partitions

SAMPLE, BITS, TABLES, ROUNDS, HAMMING, COSINE, CHUNK = 20_000, 64, 4, 50, 20, 0.9, 1024
#: Recall is measured with PROBES vectors; a band needs TRUSTED pairs to count without planted ones.
PROBES, TRUSTED, ENOUGH, FLOOR = 500, 100, 0.97, 0.9
WIDTH = BITS // TABLES
#: Of a length that is not the most frequent, up to so many vectors are compared without codes.
SMALL = 10_000
_LINKS = "id long, other long, n long"
_U = np.uint64


def _rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """The projection of rows of x whose signs lose least: principal directions, rotated by alternation."""
    rng = np.random.Generator(np.random.PCG64(seed))
    _, vectors = np.linalg.eigh(x.T @ x)
    base = vectors[:, ::-1][:, :BITS]
    if base.shape[1] < BITS:
        base = np.hstack([base, base @ np.linalg.qr(rng.normal(size=(base.shape[1],) * 2))[0]] * -(-BITS // base.shape[1]))[:, :BITS]
    v = x @ base
    r = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return base @ r


def fit(sample: np.ndarray, seed: int = 7) -> list[dict[str, np.ndarray]]:
    """mean, projection and cut of the code bits, in two ways: balanced codes of the centred vectors, and signs of the vectors as they are.

    Where vectors have a large common part, centring takes it from the cosine and leaves
    noise; ``choose`` decides between the two by their measured recall.
    """
    models = []
    for centred in (True, False):
        mean = sample.mean(0) * centred
        projection = _rotation(sample - mean, seed)
        models.append({"mean": mean, "projection": projection, "cut": np.median((sample - mean) @ projection, axis=0) * centred})
    return models


def _edges(cosine: float) -> np.ndarray:
    """The lower ends of the bands of cosines in which recall is measured."""
    return cosine + (1 - cosine) * np.array([0, 0.2, 0.5, 0.8])


def _meet(a: np.ndarray, b: np.ndarray, hamming: int) -> np.ndarray:
    return (np.bitwise_count(a ^ b) <= hamming) & (owner(a, b) < np.iinfo(np.uint64).max)


def _measure(ids: np.ndarray, probes: np.ndarray, models: list[dict[str, np.ndarray]], hamming: int, cosine: float):
    """(model, band, pairs, found) of the probes against all other vectors of a batch."""
    codes = [encode(probes, m) for m in models]
    edges = _edges(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(models), len(edges)), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x = np.frombuffer(b"".join(b["unit"].to_pylist()), float).reshape(b.num_rows, -1)
                near = probes @ x.T
                i, j = np.nonzero((near >= cosine) & (ids[:, None] != np.asarray(b["id"])[None, :]))
                band = np.searchsorted(edges, near[i, j], "right") - 1
                for m, mine in enumerate(codes):
                    found = _meet(mine[i], np.asarray(b[f"code{m}"]).view(_U)[j], hamming)
                    total[0, m] += np.bincount(band, minlength=len(edges))
                    total[1, m] += np.bincount(band[found], minlength=len(edges))
        m, band = np.indices(total.shape[1:]).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(band), pa.array(total[0].ravel()), pa.array(total[1].ravel())], ["model", "band", "pairs", "found"])

    return run


def planted(probes: np.ndarray, sample: np.ndarray, model: dict[str, np.ndarray], hamming: int, cosine: float, seed: int = 7) -> np.ndarray:
    """The recall, by band, of pairs of each probe and a vector made for it, turned toward another one of the sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    edges = _edges(cosine)
    codes, recall = encode(probes, model), np.ones(len(edges))
    for k, (low, high) in enumerate(zip(edges, [*edges[1:], 1.0], strict=True)):
        aside = sample[rng.integers(len(sample), size=len(probes))]
        aside = aside - (aside * probes).sum(1, keepdims=True) * probes
        norm = np.sqrt((aside * aside).sum(1, keepdims=True))
        fine = norm[:, 0] > 1e-6
        if fine.any():
            c = rng.uniform(low, high, (int(fine.sum()), 1))
            made = c * probes[fine] + np.sqrt(1 - c * c) * aside[fine] / norm[fine]
            recall[k] = _meet(codes[fine], encode(made, model), hamming).mean()
    return recall


def choose(counts: np.ndarray, made: np.ndarray) -> tuple[int | None, np.ndarray]:
    """(the model to use, each one's recall in its worst band) from (model, band, pairs and found) and planted recalls.

    A band counts by the pairs found in the table if there are enough of them, and by the
    planted ones if not. Centred codes are balanced, so they are taken if they are good
    enough; None if no model reaches ``FLOOR``.
    """
    pairs, found = counts[..., 0], counts[..., 1]
    worst = np.where(pairs >= TRUSTED, found / np.maximum(pairs, 1), made).min(1)
    best = 0 if worst[0] >= ENOUGH else int(worst.argmax())
    return best if worst[best] >= FLOOR else None, worst


def encode(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    bits = (x - model["mean"]) @ model["projection"] > model["cut"]
    return np.packbits(bits, axis=1).view(_U).ravel()


def _parts(codes: np.ndarray) -> np.ndarray:
    """Row t has the substrings of table t."""
    return np.stack([(codes >> _U(WIDTH * t)) & _U((1 << WIDTH) - 1) for t in range(TABLES)])


_FLIPS = np.array([0, *(1 << i for i in range(WIDTH))], _U)


def owner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key (table, substring) that owns each pair of codes, or the largest number if they share none."""
    out = np.full(np.broadcast(a, b).shape, np.iinfo(np.uint64).max, _U)
    for t in range(TABLES - 1, -1, -1):
        x, y = (a >> _U(WIDTH * t)) & _U((1 << WIDTH) - 1), (b >> _U(WIDTH * t)) & _U((1 << WIDTH) - 1)
        d = x ^ y
        n = np.bitwise_count(d)
        low = d & (~d + _U(1))
        # one bit apart: x and y are both shared; two bits apart: the two between them
        key = np.where(n == 0, x, np.where(n == 1, np.minimum(x, y), np.minimum(x ^ low, y ^ low)))
        out = np.where(n <= 2, key + _U(t << WIDTH), out)
    return out


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their unit vectors in double precision)."""
    rows = column.to_pylist()
    good = np.array([r is not None and len(r) == width and None not in r for r in rows], bool)
    x = np.array([r for r, ok in zip(rows, good, strict=True) if ok], float).reshape(-1, width)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(1, keepdims=True, initial=0)
        norm = np.sqrt((x * x).sum(1))
        fine = np.isfinite(x).all(1) & (norm > 0) & np.isfinite(norm)
        good[np.flatnonzero(good)[~fine]] = False
        return good, (x / norm[:, None])[fine]


def _encode(models: list[dict[str, np.ndarray]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = _matrix(b["vector"], width)
            ids = b["id"].filter(pa.array(good))
            codes = [pa.array(encode(x, m).view(np.int64) if len(x) else np.zeros(0, np.int64)) for m in models]
            yield pa.RecordBatch.from_arrays([ids, b["size"].filter(pa.array(good)), *codes, pa.array([r.tobytes() for r in x], pa.binary())], ["id", "size", *(f"code{m}" for m in range(len(models))), "unit"])

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, size, code, unit): the length as key and no code."""
    for b in batches:
        width = np.array([len(v) for v in b["vector"].to_pylist()], np.int64)
        for d in np.unique(width):
            part = b.filter(pa.array(width == d))
            good, x = _matrix(part["vector"], int(d))
            n = len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d)), *(part[c].filter(pa.array(good)) for c in ("id", "size")), pa.array(np.zeros(n, np.int64)), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "id", "size", "code", "unit"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, codes = np.asarray(b["id"]), np.asarray(b["code"]).view(_U)
        for at in range(0, len(ids), 4096):
            part = codes[at : at + 4096]
            keys = (_parts(part)[:, :, None] ^ _FLIPS) + (np.arange(TABLES, dtype=_U) << _U(WIDTH))[:, None, None]
            keys = keys.transpose(1, 0, 2).reshape(len(part), -1)
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[at : at + 4096], n)), pa.array(np.repeat(part, n).view(np.int64))], ["key", "id", "code"])


def _meetings(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Whole runs of rows with equal (key, ca, cb), several at a time: numpy columns and the units."""
    rest = None
    for b in batches:
        rest = pa.Table.from_batches([b.select(names)]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b.select(names)])])
        if rest.num_rows > 1:
            group = [np.asarray(rest[c]) for c in ("key", "ca", "cb")]
            new = np.flatnonzero(np.logical_or.reduce([g[1:] != g[:-1] for g in group]))
            if len(new):
                yield rest.slice(0, int(new[-1]) + 1)
                rest = rest.slice(int(new[-1]) + 1)
    if rest is not None and rest.num_rows:
        yield rest


def _runs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    group = [np.asarray(t[c]) for c in ("key", "ca", "cb")]
    new = np.concatenate([[True], np.logical_or.reduce([g[1:] != g[:-1] for g in group])])
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(new))


def _near(hamming: int):
    """The (key, id) that have a pair within the bound which the key owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _meetings(batches, ("key", "ca", "cb", "chunk", "id", "code")):
            start, end = _runs(t)
            key, code, chunk = np.asarray(t["key"]).view(_U), np.asarray(t["code"]).view(_U), np.asarray(t["chunk"])
            across = np.asarray(t["ca"]) != np.asarray(t["cb"])
            last = np.repeat(end, end - start)
            hit = np.zeros(len(key), bool)
            at, step = np.arange(len(key)), 1
            while len(at):
                at = at[at + step < last[at]]
                for p in range(0, len(at), 1 << 16):
                    i = at[p : p + (1 << 16)]
                    j = i + step
                    ok = np.bitwise_count(code[i] ^ code[j]) <= hamming
                    i, j = i[ok], j[ok]
                    ok = (owner(code[i], code[j]) == key[i]) & (~across[i] | (chunk[i] != chunk[j]))
                    hit[i[ok]] = hit[j[ok]] = True
                step += 1
            found = t.select(["key", "id"]).filter(pa.array(hit))
            yield from found.to_batches() or [pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["key", "id"])]

    return run


def _pairs(code: np.ndarray, unit: np.ndarray, chunk: np.ndarray | None, key: np.uint64 | None, hamming: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of one meeting that its key owns (without a key, all of them), by blocks of rows."""
    left, right = [], []
    for a in range(0, len(code) - 1, 256):
        b = min(a + 256, len(code))
        near = (np.bitwise_count(code[a:b, None] ^ code[None, a:]) <= hamming) & (unit[a:b] @ unit[a:].T >= cosine)
        if chunk is not None:
            near &= chunk[a:b, None] != chunk[None, a:]
        i, j = np.nonzero(np.triu(near, 1))
        own = np.ones(len(i), bool) if key is None else owner(code[a + i], code[a + j]) == key
        left.append(a + i[own])
        right.append(a + j[own])
    return np.concatenate(left), np.concatenate(right)


def _labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of n by the pairs."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, x, old[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == old).all():
            return label


def _rerank(hamming: int, cosine: float, whole: bool = False):
    """(id, other, n): the number of vectors linked to each class that its key owns, and a star of each component (n null).

    If the meetings are whole, each pair meets at one key only, which owns it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _meetings(batches, ("key", "ca", "cb", "chunk", "id", "size", "code", "unit")):
            start, end = _runs(t)
            key, codes, chunks, ids = np.asarray(t["key"]).view(_U), np.asarray(t["code"]).view(_U), np.asarray(t["chunk"]), np.asarray(t["id"])
            size = np.asarray(t["size"])
            across = np.asarray(t["ca"]) != np.asarray(t["cb"])
            unit = t["unit"].to_pylist()
            a, b, n = [], [], []
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                if e - s < 2:
                    continue
                units = np.frombuffer(b"".join(unit[s:e]), float).reshape(e - s, -1)
                x, y = _pairs(codes[s:e], units, chunks[s:e] if across[s] else None, None if whole else key[s], hamming, cosine)
                if not len(x):
                    continue
                many = size[s:e]
                links = (np.bincount(x, many[y], e - s) + np.bincount(y, many[x], e - s)).astype(np.int64)
                label = _labels(x, y, e - s)
                id_, some, moved = ids[s:e], np.flatnonzero(links), np.flatnonzero(label != np.arange(e - s))
                a += id_[moved].tolist() + id_[some].tolist()
                b += id_[label[moved]].tolist() + [None] * len(some)
                n += [None] * len(moved) + links[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["id", "other", "n"])

    return run


def _chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """rows(key, id, ..) with chunk, ca and cb: keys of many rows become pairs of chunks."""
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows).select("key", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
    rows = rows.join(large, "key", "left")
    one = F.coalesce(F.col("chunks"), F.lit(1))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), one).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), one - 1)))
    return rows.withColumn("ca", F.least("chunk", "other")).withColumn("cb", F.greatest("chunk", "other")).drop("chunks", "other")


def _met(rows: DataFrame) -> DataFrame:
    """rows(key, id, ..) dealt by meeting, each meeting's rows next to each other."""
    return _chunked(rows, CHUNK).repartition(partitions(rows.sparkSession), "key", "ca", "cb").sortWithinPartitions("key", "ca", "cb")


def _own(known: DataFrame) -> DataFrame:
    """The links within classes(id, size) of equal vectors."""
    return known.where("size > 1").select("id", F.lit(None).cast("long").alias("other"), (F.col("size") - 1).alias("n"))


def _all_links(vectors: DataFrame, hamming: int, cosine: float) -> DataFrame:
    """The links among all vectors(id, vector, size) of equal length: the length is the key where they meet."""
    units = materialize(vectors.select("id", "vector", "size").mapInArrow(_units, "key long, id long, size long, code long, unit binary"), "units")
    return _met(units).mapInArrow(_rerank(hamming, cosine, True), _LINKS).unionByName(_own(units))


def _coded_links(vectors: DataFrame, width: int, cosine: float, hamming: int, sample: int) -> tuple[DataFrame, tuple[int | None, list[float]] | None]:
    """The links among vectors(id, vector, size) of one length; (the codes taken, each one's recall in its worst band)."""
    # the rotation is learned on at most ``sample`` vectors, those with the smallest hashes of their ids
    few = vectors.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    good, x = _matrix(few["vector"].combine_chunks() if few.num_rows else pa.array([], pa.list_(pa.float64())), width)
    if not len(x):
        return _all_links(vectors, hamming, cosine), None
    models = fit(x)
    probes, ids = x[:PROBES], np.asarray(few["id"])[good][:PROBES]
    coded = materialize(vectors.select("id", "size", "vector").mapInArrow(_encode(models, width), "id long, size long, code0 long, code1 long, unit binary"), "codes")
    counts = np.zeros((len(models), len(_edges(cosine)), 2), np.int64)
    for r in coded.mapInArrow(_measure(ids, probes, models, hamming, cosine), "model long, band long, pairs long, found long").groupBy("model", "band").agg(F.sum("pairs").alias("pairs"), F.sum("found").alias("found")).collect():
        counts[r["model"], r["band"]] = r["pairs"], r["found"]
    best, worst = choose(counts, np.array([planted(probes, x, m, hamming, cosine) for m in models]))
    recall = best, worst.tolist()
    if best is None:
        return _all_links(vectors, hamming, cosine), recall
    coded = coded.select("id", "size", F.col(f"code{best}").alias("code"), "unit")
    keys = coded.select("id", "code").mapInArrow(_keys, "key long, id long, code long")
    near = materialize(_met(keys).mapInArrow(_near(hamming), "key long, id long").distinct(), "near")
    full = _chunked(near, CHUNK).join(coded, "id").repartition(partitions(vectors.sparkSession), "key", "ca", "cb").sortWithinPartitions("key", "ca", "cb")
    return full.mapInArrow(_rerank(hamming, cosine), _LINKS).unionByName(_own(coded)), recall


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", hamming: int = HAMMING, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors.

    Vectors that are null, empty, zero, or hold a null or non-finite number link with
    nothing; others link with vectors of their own length. The most frequent length and
    all lengths of more than ``SMALL`` vectors have codes of their own; of each other
    length all pairs are compared. Rows that repeat a vec_id are one vector (the smallest
    content counts) and report the same; a null vec_id links with nothing; an empty
    table gives no rows; further columns are ignored.
    """
    return measured_duplicates(vectors, cosine, id_column, vector_column, hamming, sample)[0]


def measured_duplicates(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", hamming: int = HAMMING, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, tuple[int | None, list[float]]]]:
    """The rows of ``near_duplicates``, and for each length with codes (the codes taken, each one's measured recall in its worst band).

    The codes taken are 0 (balanced), 1 (not centred) or None: all pairs were compared.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    distinct = rows.where("id is not null and vector is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    distinct = materialize(distinct.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit("second"), "vector")), "vectors")
    slim = distinct.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    classes = materialize(distinct.select("id", "vector").join(slim, "id"), "classes")
    sizes = classes.where("size(vector) > 0").groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    widths = [r["d"] for r in sizes.orderBy(F.desc("n"), "d").limit(1).collect()]
    widths += [r["d"] for r in sizes.where(F.col("n") > SMALL).orderBy("d").collect() if r["d"] not in widths]
    if not widths:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")), {}
    parts, recall = [], {}
    for d in widths:
        part, recall[d] = _coded_links(classes.where(F.size("vector") == d), d, cosine, hamming, sample)
        parts.append(part)
    rest = classes.where((F.size("vector") > 0) & ~F.size("vector").isin(widths))
    links = materialize(reduce(DataFrame.unionByName, [*parts, _all_links(rest, hamming, cosine)]), "links")
    counts = links.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    found = components(links.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    # of a class without links (not a usable vector) every member is on its own
    linked = counts.join(found.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("class"), "n", F.coalesce("component", "id").alias("component"))
    named = distinct.select("id", "h1", "h2").join(classes.select("h1", "h2", F.col("id").alias("class")), ["h1", "h2"]).join(linked, "class").select("id", "n", "component")
    out = rows.select("id").join(named, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")), {d: r for d, r in recall.items() if r is not None}
