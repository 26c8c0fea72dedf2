"""Size-aware heavy-light Jaccard join on word shingles, and its connected components.

Equal sets are collapsed first (one class, its smallest doc_id stands for it). The
rest is joined in two ways, with the boundary between them chosen by cost from the
histogram of set sizes:

* light: two sets of sizes a <= b link exactly if they share a subset of o(a, b)
  shingles, o being the least overlap that reaches the threshold. Sets up to the
  boundary enumerate these subsets; sets meet at the hashes of a subset, and a star
  around the smallest set of each meeting keeps all connectivity, so a meeting of any
  size costs one aggregation.
* heavy: pairs with a larger set scan inverted lists. A set's rarest shingles, as
  many as two sets above the threshold cannot both miss, are its list entries;
  frequencies are counted over all sets. Sets that share a list meet at the list's
  smallest id, and what is not connected yet is verified by exact intersection, in three
  steps. Meetings above ``CHUNK`` sets or ``CHUNK_MEMBERS`` members are cut into chunks.
  First the sets of a chunk are compared. Then one set stands for the largest component
  of each chunk, and these are compared with each other. At last, in each meeting, the
  sets outside its largest component are compared with all sets of other components,
  pairs of chunks at a time. So g near copies of one text are shipped once or twice each,
  and only sets that a meeting holds in vain are shipped once for each chunk of it.

Shingles are hashed twice, from words hashed twice, by lanes that are independent of
each other: sets are equal, and subsets are, if 128 bits are, and links of large sets
are counted on the 64 bits of each of their shingles.

Only edges of a spanning forest of the links are emitted: as many rows as sets, and
never all pairs of a group, while no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._graph import components
from ._shared import blocks_for, discard, materialize, partitions

SHINGLE, PERCENT = 3, 90
#: Meetings of more sets, or of more members of sets, are cut into chunks.
CHUNK, CHUNK_MEMBERS = 512, 1 << 20
#: Largest set size that may count as light.
MOST_LIGHT = 64
_U = np.uint64


def overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of sets of sizes a and b with Jaccard similarity of percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """The overlaps at which a light set of size n can link with another light set of another content."""
    sizes = {overlap(m, n, percent) for m in range(max(1, -(-percent * n // 100)), min(boundary, n * 100 // percent) + 1)}
    return sorted(c for c in sizes if c <= n and (c < n or any(overlap(m, n, percent) == n for m in range(n + 1, min(boundary, n * 100 // percent) + 1))))


def choose_boundary(histogram: dict[int, int], percent: int) -> int:
    """The largest light size: enumerated subsets against list entries and shipped sets."""

    def cost(x: int) -> int:
        light = sum(k * sum(comb(n, c) for c in subset_sizes(n, x, percent)) for n, k in histogram.items() if n <= x)
        low = -(-percent * (x + 1) // 100)
        return light + sum(k * (n + n - -(-percent * n // 100) + 1) for n, k in histogram.items() if n >= low)

    return min(range(1, MOST_LIGHT + 1), key=lambda x: (cost(x), -x))


def _segments(text: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1))


def _signatures(lanes: tuple[np.ndarray, np.ndarray], cut: np.ndarray) -> np.ndarray:
    """A 64-bit sum of each lane's hashes of each set, whatever the order of its members."""
    out = np.zeros((2, len(cut) - 1), np.uint64)
    for i, (keys, salt) in enumerate(zip(lanes, (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3), strict=True)):
        total = np.concatenate([[_U(0)], np.cumsum(W.mix(keys ^ _U(salt)))])
        out[i] = total[cut[1:]] - total[cut[:-1]]
    return out.view(np.int64)


def _sign(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, body, _ = W.flat(b["text"])
            n = np.zeros(b.num_rows, np.int64)
            s = np.zeros((2, b.num_rows), np.int64)
            for i, j, h, where in W.word_groups(offsets, body, lower=True, lanes=2):
                keys, text, other = W.shingle_sets(h[0], where, shingle, h[1])
                cut = _segments(text, j - i)
                n[i:j], s[:, i:j] = np.diff(cut), _signatures((keys, other), cut)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n), pa.array(s[0]), pa.array(s[1])], ["id", "n", "s1", "s2"])

    return sign


class _Sets:
    """The sets of a block's representatives of at least low members."""

    def __init__(self, docs: pa.Table, reps: pa.Table, shingle: int, low: int) -> None:
        wanted = {}
        for i, n, a, b in zip(*(reps[c].to_pylist() for c in ("id", "n", "s1", "s2")), strict=True):
            if n is not None and n >= low:
                wanted.setdefault(i, set()).add((n, a, b))
        ids = docs["id"].to_pylist()
        rows = [k for k, i in enumerate(ids) if i in wanted]
        docs = docs.take(pa.array(rows, pa.int64()))
        ids = np.array([ids[k] for k in rows], np.int64)
        offsets, body, _ = W.flat(docs["text"])
        self.ids, self.sets, self.others = [], [], []
        for i, j, h, where in W.word_groups(offsets, body, lower=True, lanes=2):
            keys, text, other = W.shingle_sets(h[0], where, shingle, h[1])
            cut = _segments(text, j - i)
            sums = _signatures((keys, other), cut)
            for k in range(j - i):
                of = (int(cut[k + 1] - cut[k]), int(sums[0, k]), int(sums[1, k]))
                if of in wanted[int(ids[i + k])]:
                    wanted[int(ids[i + k])].discard(of)  # a repeated row counts once
                    self.ids.append(int(ids[i + k]))
                    self.sets.append(keys[cut[k] : cut[k + 1]])
                    self.others.append(other[cut[k] : cut[k + 1]] if cut[k + 1] - cut[k] <= MOST_LIGHT else None)

    def entries(self, buckets: int, low: int):
        """Of sets of low members at least, distinct keys by bucket: short keys, counts, slices; and each key's place."""
        keys = [s for s in self.sets if len(s) >= low]
        short = W.mix((np.concatenate(keys) if keys else np.zeros(0, np.uint64)) ^ _U(0xE7037ED1A0B428DB))
        distinct, inverse, counts = np.unique(short, return_inverse=True, return_counts=True)
        bucket = ((distinct >> _U(32)) % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[by])) + 1, [len(by)]]) if len(by) else np.zeros(1, np.int64)
        slices = [(int(bucket[by[a]]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return (distinct[by] & _U(0xFFFFFFFF)).astype(np.uint32), np.minimum(counts[by], 255).astype(np.uint8), slices, rank[inverse]


_ASK = "block long, bucket long, keys binary, counts binary"
_TELL = "block long, bucket long, hit binary, df binary"
_CANDIDATES = "id long, n int, lists array<long>, members binary, subsets array<long>, others array<long>, sizes array<int>"


def _ask(shingle: int, low: int, buckets: int):
    def ask(key: tuple[pa.Scalar, ...], docs: pa.Table, reps: pa.Table) -> pa.Table:
        keys, counts, slices, _ = _Sets(docs, reps, shingle, low).entries(buckets, low)
        return pa.table({"block": pa.array([key[0].as_py()] * len(slices), pa.int64()), "bucket": pa.array([s[0] for s in slices], pa.int64()), "keys": pa.array([keys[a:b].tobytes() for _, a, b in slices], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for _, a, b in slices], pa.binary())})

    return ask


def _count(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
    """Of one bucket: in how many sets each key is, told to the blocks that share it.

    The count orders the keys and nothing else, so it may be of a truncated key.
    """
    keys = [np.frombuffer(x, np.uint32) for x in asked["keys"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in asked["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(inverse, counts)[inverse]
    df = np.minimum(df, 0xFFFFFFFF).astype(np.uint32)
    out, a = [], 0
    for block, k in zip(asked["block"].to_pylist(), keys, strict=True):
        mine = df[a : a + len(k)]
        a += len(k)
        hit = mine > 1
        if hit.any():
            out.append((block, np.packbits(hit).tobytes(), mine[hit].tobytes()))
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int64()), "hit": pa.array(cols[1], pa.binary()), "df": pa.array(cols[2], pa.binary())})


def _subsets(lanes: tuple[np.ndarray, np.ndarray], boundary: int, percent: int) -> tuple[list[list[int]], list[int]]:
    """Hashes, of both lanes, and sizes of the fixed-size subsets of a light set."""
    hashes, sizes, n = [[], []], [], len(lanes[0])
    parts = [W.mix(keys ^ _U(0x1D8E4E27C47D124F)) for keys in lanes]
    for c in subset_sizes(n, boundary, percent):
        gone = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
        for k, p in enumerate(parts):
            hashes[k].append(np.add.reduce(p, keepdims=True) - np.add.reduce(p[gone], axis=1))
        sizes += [c] * len(gone)
    if not sizes:
        return [[], []], []
    return [W.mix(np.concatenate(x) + np.array(sizes, np.uint64) * _U(0xEB44ACCAB455D165)).view(np.int64).tolist() for x in hashes], sizes


def _candidates(shingle: int, low: int, boundary: int, buckets: int, percent: int):
    def find(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        is_rep = np.asarray(told["id"].combine_chunks().is_valid(), dtype=bool) if told.num_rows else np.zeros(0, bool)
        sets = _Sets(docs, told.filter(pa.array(is_rep)), shingle, min(low, 2))
        _, counts, slices, place = sets.entries(buckets, low)
        df = counts.astype(np.uint32)
        where = {bucket: (a, b) for bucket, a, b in slices}
        answers = told.filter(pa.array(~is_rep))
        for bucket, hit, many in zip(*(answers[c].to_pylist() for c in ("bucket", "hit", "df")), strict=True):
            if bucket in where:
                a, b = where[bucket]
                df[a:b][np.unpackbits(np.frombuffer(hit, np.uint8), count=b - a).astype(bool)] = np.frombuffer(many, np.uint32)
        often = df[place]
        rows, a = [], 0
        for i, members, other in zip(sets.ids, sets.sets, sets.others, strict=True):
            n, lists = len(members), []
            if n >= low:
                mine = often[a : a + n]
                a += n
                prefix = n + percent * n // -100 + 1
                first = np.lexsort((members, mine))[:prefix]
                lists = members[first[mine[first] > 1]].view(np.int64).tolist()
            subsets, sizes = _subsets((members, other), boundary, percent) if n <= boundary else ([[], []], [])
            if lists or sizes:
                rows.append((i, n, lists, members.tobytes() if lists else None, *subsets, sizes))
        longs = pa.list_(pa.int64())
        cols = list(zip(*rows, strict=True)) or [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), longs, pa.binary(), longs, longs, pa.list_(pa.int32())), strict=True)], names=["id", "n", "lists", "members", "subsets", "others", "sizes"])

    return find


def _forest(ids: list[int], chunk: list[int], known: list[int], sets: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that connect the sets of one meeting, of which those with one known component are connected; across: only between its two chunks."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, chunk, sets = [ids[i] for i in order], np.array([chunk[i] for i in order]), [sets[i] for i in order]
    label = np.unique([known[i] for i in order], return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    mark = np.zeros(len(distinct), bool)
    found = []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        rest = np.arange(i + 1, end)
        rest = rest[label[rest] != label[i]]
        if across:
            rest = rest[chunk[rest] != chunk[i]]
        if not len(rest):
            continue
        mark[number[start[i] : start[i + 1]]] = True
        if 4 * len(rest) < end - i:
            at = np.concatenate([np.arange(start[j], start[j + 1]) for j in rest])
        else:
            at = np.arange(start[rest[0]], start[rest[-1] + 1])
        shared = np.bincount(owner[at], mark[number[at]], len(sets))[rest].astype(np.int64)
        mark[number[start[i] : start[i + 1]]] = False
        for j in rest[100 * shared >= percent * (sizes[i] + sizes[rest] - shared)]:
            if label[j] != label[i]:
                found.append((ids[i], ids[int(j)]))
                label[label == label[j]] = label[i]
    return found


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"key": None, "ids": [], "chunk": [], "known": [], "sets": []}
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(held["ids"]) > 1:
                found.extend(_forest(held["ids"], held["chunk"], held["known"], held["sets"], percent, held["key"][1] != held["key"][2]))

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
            found.clear()
            return rows

        for batch in batches:
            for pivot, a, b, i, c, label, members in zip(*(batch[x].to_pylist() for x in ("pivot", "ca", "cb", "id", "chunk", "label", "members")), strict=True):
                if (pivot, a, b) != held["key"]:
                    close()
                    held.update(key=(pivot, a, b), ids=[], chunk=[], known=[], sets=[])
                held["ids"].append(i)
                held["chunk"].append(c)
                held["known"].append(label)
                held["sets"].append(np.frombuffer(members, np.uint64))
            yield out()
        close()
        yield out()

    return verify


def _chunks(many: Column, members: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(many / CHUNK, members / CHUNK_MEMBERS))).cast("int")


def _side(chunks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), chunks).cast("int")


def _in_pairs(meets: DataFrame) -> DataFrame:
    """meets(pivot, id, n, label) with chunk, ca and cb: each pair of a meeting's chunks, and each chunk with itself."""
    chunks = meets.groupBy("pivot").agg(_chunks(F.count("*"), F.sum("n")).alias("chunks"))
    rows = meets.join(chunks, "pivot").withColumn("chunk", _side(F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("pivot", "id", "label", "chunk", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb"))


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The verified links of rows(pivot, ca, cb, id, label, chunk)."""
    shipped = rows.join(sets.where("members is not null").select("id", "members"), "id")
    shipped = shipped.repartition(partitions(rows.sparkSession), "pivot", "ca", "cb").sortWithinPartitions("pivot", "ca", "cb")
    return shipped.mapInArrow(_verify(percent), "a long, b long")


def _connected(meets: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(node, component) by the known links and those among meets(pivot, id, n)."""
    chunks = meets.groupBy("pivot").agg(_chunks(F.count("*"), F.sum("n")).alias("chunks"))
    meets = materialize(meets.join(chunks, "pivot").withColumn("chunk", _side(F.col("chunks"))), "chunked")
    within = meets.select("pivot", "id", F.col("id").alias("label"), "chunk", F.col("chunk").alias("ca"), F.col("chunk").alias("cb"))
    found = components(known.unionByName(_links(within, sets, percent)))
    large = meets.where("chunks > 1").select("pivot", "id", "n", "chunk")
    if large.isEmpty():
        discard(meets)
        return found

    def labelled() -> DataFrame:
        return large.join(found.withColumnRenamed("node", "id"), "id", "left").select("pivot", "id", "n", "chunk", F.coalesce("component", "id").alias("label"))

    def grown(links: DataFrame) -> DataFrame:
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    first = labelled().groupBy("pivot", "chunk", "label").agg(F.count("*").alias("k"), F.min(F.struct("id", "n")).alias("one"))
    ones = first.groupBy("pivot", "chunk").agg(F.max(F.struct("k", "label", "one")).alias("m")).select("pivot", F.col("m.one.id").alias("id"), F.col("m.one.n").alias("n"), F.col("m.label").alias("label"))
    found = grown(_links(_in_pairs(ones), sets, percent))

    mine = labelled()
    main = mine.groupBy("pivot", "label").agg(F.count("*").alias("k")).groupBy("pivot").agg(F.max(F.struct("k", "label")).alias("m")).select("pivot", F.col("m.label").alias("main"))
    mine = materialize(mine.join(main, "pivot").withColumn("outside", F.col("label") != F.col("main")).drop("main", "chunk"), "outside")
    size = lambda which: _chunks(F.count(F.when(which, 1)), F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)))
    sides = mine.groupBy("pivot").agg(F.count(F.when(F.col("outside"), 1)).alias("k"), size(F.col("outside")).alias("few"), size(~F.col("outside")).alias("many")).where("k > 0").drop("k")
    rows = mine.join(sides, "pivot")
    chunk = F.when(F.col("outside"), _side(F.col("few"))).otherwise(F.col("few") + _side(F.col("many")))
    other = F.when(F.col("outside"), F.sequence(F.col("few"), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(other))
    across = rows.select("pivot", "id", "label", "chunk", F.least("chunk", "other").alias("ca"), F.greatest("chunk", "other").alias("cb"))
    found = grown(_links(across, sets, percent).unionByName(_links(_in_pairs(mine.where("outside").select("pivot", "id", "n", "label")), sets, percent)))
    discard(meets, mine)
    return found


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    Two documents link when their sets of distinct shingle-word shingles (of texts
    with A-Z lower-cased) have a Jaccard similarity of percent / 100 at least;
    component_id is the smallest doc_id reachable by links. A null or empty text, or
    one without words, has no shingles and links with nothing, not even its like;
    a text with fewer words is one shingle; rows that repeat a doc_id are one node of
    the graph with several sets; a row with a null doc_id is linked with nothing and
    has a null component; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_sign(shingle), "id long, n long, s1 long, s2 long"), "signed")
    classes = materialize(signed.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("id")), "classes")
    histogram = {r["n"]: r["k"] for r in classes.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count("*").alias("k")).collect()}
    boundary = choose_boundary(histogram, percent)
    low = -(-percent * (boundary + 1) // 100)

    blocks = blocks_for(docs, "text")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    dealt = docs.where("id is not null").withColumn("block", block)
    reps = classes.withColumn("block", block)
    asked = dealt.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(_ask(shingle, low, blocks), _ASK)
    told = asked.groupBy("bucket").applyInArrow(_count, _TELL)
    both = reps.unionByName(told, allowMissingColumns=True)
    sets = materialize(dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_candidates(shingle, low, boundary, blocks, percent), _CANDIDATES), "sets")

    light = sets.select("id", "n", F.explode(F.arrays_zip("subsets", "others", "sizes")).alias("s")).select("id", "n", F.col("s.subsets").alias("key"), F.col("s.others").alias("other"), F.col("s.sizes").alias("c"))
    hub = light.groupBy("key", "other", "c").agg(F.min(F.struct("n", "id")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("hub.n")) / F.lit(100 + percent))
    light_links = light.join(hub, ["key", "other", "c"]).where((F.col("id") != F.col("hub.id")) & (need <= F.col("c"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()

    entries = sets.select("id", "n", F.explode("lists").alias("key"))
    pivots = entries.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").drop("last")
    meets = materialize(entries.join(pivots, "key").select("pivot", "id", "n").distinct(), "meets")
    known = signed.where("n > 0 and id is not null")
    several = known.groupBy("id").agg(F.min(F.struct("n", "s1", "s2")).alias("a"), F.max(F.struct("n", "s1", "s2")).alias("b")).where("a <> b").select("id")
    own_links = known.join(several, "id").join(classes.withColumnRenamed("id", "a"), ["n", "s1", "s2"]).select("a", F.col("id").alias("b"))

    found = _connected(meets, sets, light_links.unionByName(own_links), percent)
    discard(sets, meets)
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    out = signed.join(named, ["n", "s1", "s2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each group of near duplicates does: the smallest doc_id.

    All rows of that doc_id stay, as do rows without a doc_id or without words, which are
    linked with nothing; all columns stay as they are; an empty table stays empty.
    """
    found = jaccard_components(docs, shingle, percent, id_column, text_column)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_column] == F.col("_gone"), "left_anti")
