"""Substring de-duplication by relative Lempel-Ziv parsing.

Every document is a reference for all documents with a larger doc_id. The corpus is
dealt into blocks of documents, and every window of ``window`` words is a seed of a
distributed index over all reference blocks, which tells where it occurs first: the
smallest document that has it, and the place there. A document is factored greedily
from left to right: a factor begins at a seed with an earlier reference and grows as
long as the reference goes on word by word, so a factor's words stand contiguously in
its reference. Factors have ``window`` words at least. A factor ends where its
reference stops to go on; the seeds that straddle this boundary are looked up like all
others, and the next factor begins where the last one ends.

The index is asked twice. First with 32 bits of each distinct window of a block, which
tells all but a few windows that occur once in the corpus; then, for the others, with
a seed of 64 bits, independent of the first 32 and of the bucket, and its first place.
A passage that many documents share is sent once per block, not once per document.
Texts are shuffled once, and all phases read that shuffle.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import blocks_for, partitions

WINDOW = 13
NO_ID = np.iinfo(np.int64).max
_ASK = "block long, bucket long, prints binary"
_SEEN = "block long, bucket long, seen binary"
_OFFER = "block long, bucket long, seeds binary, ids binary, rows binary, counts binary, places binary"
_TELL = "block long, bucket long, hit binary, ids binary, rows binary, codes binary, places binary"
_BASE_1, _BASE_2 = 0xC2B2AE3D27D4EB4F | 1, 0x165667B19E3779F9 | 1
_U = np.uint64


def _whole(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _cut(changes: np.ndarray) -> np.ndarray:
    """The starts of the runs of a sorted array, from the mask of its changes, and its length."""
    return np.concatenate([[0], np.flatnonzero(changes) + 1, [len(changes) + 1]])


class _Block:
    """The windows of a block's documents, which are in order of (id, row): seed, print with bucket, document, place."""

    def __init__(self, docs: pa.Table, window: int, buckets: int) -> None:
        ids = docs["id"].combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        ids = np.asarray(ids.fill_null(int(NO_ID)), dtype=np.int64)
        rows = np.asarray(docs["row"].combine_chunks() if docs.num_rows else [], dtype=np.int64)
        order = np.lexsort((rows, ids))
        self.docs = docs = docs.take(pa.array(order))
        self.ids, self.rows = ids[order], rows[order]
        self.offsets, self.body, _ = W.flat(docs["text"])
        self.words = np.zeros(len(self.ids), np.int64)
        seeds, prints, owner, at, base = [], [], [], [], 0
        for i, j, h, where in W.word_groups(self.offsets, self.body, lanes=2):
            self.words[i:j] = np.diff(where)
            start, text = W.window_starts(where, window)
            if len(start):
                seeds.append(W.window_hashes(h[0], window, _BASE_1)[start])
                x = W.window_hashes(h[1], window, _BASE_2)[start]
                prints.append((x & _U(0xFFFFFFFF)) % _U(buckets) << _U(32) | x >> _U(32))
                owner.append((text + i).astype(np.int32))
                at.append(start + base)
            base += h.shape[1]
        self.base = np.concatenate([[0], np.cumsum(self.words)])
        self.seeds, self.prints = _whole(seeds, np.uint64), _whole(prints, np.uint64)
        self.doc, self.at = _whole(owner, np.int32), _whole(at, np.int64)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct prints, and the starts of their buckets."""
        distinct = np.unique(self.prints)
        return distinct, _cut(np.diff(distinct >> _U(32)) > 0) if len(distinct) else np.zeros(1, np.int64)

    def candidates(self, seen: pa.Table) -> None:
        """Keeps the windows that occur elsewhere, too, in this block or in another one."""
        distinct, inverse, counts = np.unique(self.prints, return_inverse=True, return_counts=True)
        often = counts > 1
        cut = _cut(np.diff(distinct >> _U(32)) > 0) if len(distinct) else np.zeros(1, np.int64)
        where = {int(distinct[a] >> _U(32)): (a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)}
        for bucket, bits in zip(seen["bucket"].to_pylist(), seen["seen"].to_pylist(), strict=True):
            a, b = where[bucket]
            often[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        keep = often[inverse]
        bucket = (self.prints[keep] >> _U(32)).astype(np.int64)
        self.prints = None
        self.seeds, self.doc, self.at = self.seeds[keep], self.doc[keep], self.at[keep]
        # distinct windows by their first place; equal ones keep their order
        by = np.lexsort((self.seeds, bucket))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(self.seeds[by]) != 0) | (np.diff(bucket[by]) != 0)
        first, number = by[new], np.empty(len(by), np.int64)
        number[by] = np.cumsum(new) - 1
        rank = np.lexsort((first, bucket[first]))
        self.first, self.bucket = first[rank], bucket[first][rank]
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        self.number = back[number]
        self.cut = _cut(np.diff(self.bucket) > 0) if len(self.bucket) else np.zeros(1, np.int64)

    def place(self, windows: np.ndarray) -> np.ndarray:
        """The places of windows in their documents."""
        return self.at[windows] - self.base[self.doc[windows]]


def _table(block: int, names: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in names.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * (len(fields) - 1)
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array([block] * len(rows), pa.int64()), *(pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields[1:], strict=True))], names=[n for n, _ in fields])


def _ask(window: int, buckets: int):
    def ask(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        distinct, cut = _Block(docs, window, buckets).asked()
        prints = (distinct & _U(0xFFFFFFFF)).astype(np.uint32)
        rows = [(int(distinct[a] >> _U(32)), prints[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return _table(key[0].as_py(), _ASK, rows)

    return ask


def _seen(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its prints other blocks have, too."""
    prints = [np.frombuffer(x, np.uint32) for x in asked["prints"].to_pylist()]
    every = np.concatenate(prints)
    by = np.argsort(every, kind="stable")
    same = np.diff(every[by]) == 0
    hit = np.zeros(len(by), bool)
    hit[by[1:][same]] = hit[by[:-1][same]] = True
    rows, a = [], 0
    for block, p in zip(asked["block"].to_pylist(), prints, strict=True):
        mine = hit[a : a + len(p)]
        a += len(p)
        if mine.any():
            rows.append((block, np.packbits(mine).tobytes()))
    cols = list(zip(*rows, strict=True)) or [(), ()]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()), "seen": pa.array(cols[1], pa.binary())})


def _offer(window: int, buckets: int):
    def offer(key: tuple[pa.Scalar, ...], docs: pa.Table, seen: pa.Table) -> pa.Table:
        block = _Block(docs, window, buckets)
        block.candidates(seen)
        doc, place = block.doc[block.first], block.place(block.first).astype(np.uint32)
        rows = []
        for a, b in zip(block.cut[:-1].tolist(), block.cut[1:].tolist(), strict=True):
            runs = _cut(np.diff(doc[a:b]) != 0)
            of = doc[a:b][runs[:-1]]
            rows.append((int(block.bucket[a]), block.seeds[block.first[a:b]].tobytes(), block.ids[of].tobytes(), block.rows[of].tobytes(), np.diff(runs).astype(np.uint32).tobytes(), place[a:b].tobytes()))
        return _table(key[0].as_py(), _OFFER, rows)

    return offer


def _index(key: tuple[pa.Scalar, ...], offered: pa.Table) -> pa.Table:
    """Of one bucket: for each block, which of its seeds a smaller document has, and where that is."""
    read = lambda c, kind: [np.frombuffer(x, kind) for x in offered[c].to_pylist()]
    sizes = [len(x) for x in read("seeds", np.uint64)]
    seeds, place = np.concatenate(read("seeds", np.uint64)), np.concatenate(read("places", np.uint32))
    id_, row, many = (np.concatenate(read(c, kind)) for c, kind in (("ids", np.int64), ("rows", np.int64), ("counts", np.uint32)))
    run = np.repeat(np.arange(len(id_), dtype=np.int32), many)
    rank = np.empty(len(id_), np.int64)  # of the runs' documents, in the order in which they are references
    rank[np.lexsort((row, id_))] = np.arange(len(id_))
    by = np.lexsort((place, rank[run], seeds))
    head = np.ones(len(by), bool)
    head[1:] = np.diff(seeds[by]) != 0
    owner = np.empty(len(by), np.int64)
    owner[by] = by[head][np.cumsum(head) - 1]
    hit = id_[run[owner]] < id_[run]
    rows, a = [], 0
    for block, n in zip(offered["block"].to_pylist(), sizes, strict=True):
        mine = hit[a : a + n]
        if mine.any():
            of = owner[a : a + n][mine]
            known, code = np.unique(run[of], return_inverse=True)
            rows.append((block, key[0].as_py(), np.packbits(mine).tobytes(), id_[known].tobytes(), row[known].tobytes(), code.astype(np.uint32).tobytes(), place[of].tobytes()))
        a += n
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.table([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(cols)], names=[x.split()[0] for x in _TELL.split(", ")])


def _factors(block: _Block, told: pa.Table, window: int) -> tuple[np.ndarray, ...]:
    """(document, first word, end, reference id, first word there) of each factor, words counted within documents."""
    ids, rows = block.ids[block.doc[block.first]], block.rows[block.doc[block.first]]
    places = block.place(block.first)
    where = {int(block.bucket[a]): (a, b) for a, b in zip(block.cut[:-1].tolist(), block.cut[1:].tolist(), strict=True)}
    for bucket, hit, i, r, code, place in zip(*(told[c].to_pylist() for c in ("bucket", "hit", "ids", "rows", "codes", "places")), strict=True):
        a, b = where[bucket]
        mine, code = np.unpackbits(np.frombuffer(hit, np.uint8), count=b - a).astype(bool), np.frombuffer(code, np.uint32)
        ids[a:b][mine], rows[a:b][mine] = np.frombuffer(i, np.int64)[code], np.frombuffer(r, np.int64)[code]
        places[a:b][mine] = np.frombuffer(place, np.uint32)
    at = np.flatnonzero(ids[block.number] < block.ids[block.doc]) if len(block.number) else np.zeros(0, np.int64)
    doc, word, n = block.doc[at].astype(np.int64), block.place(at) if len(at) else at, block.number[at]
    ref, row, there = ids[n], rows[n], places[n]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(word) != 1) | (np.diff(ref) != 0) | (np.diff(row) != 0) | (np.diff(there) != 1)
    a = np.flatnonzero(new)
    last = np.append(a[1:], len(at))[: len(a)] - 1
    doc, start, end, ref, there = doc[a], word[a], word[last] + window, ref[a], there[a]
    # where two factors overlap, the windows straddle a boundary: the words are the earlier one's
    begin = start.copy()
    begin[1:] = np.where(np.diff(doc) == 0, np.maximum(start[1:], end[:-1]), start[1:])
    return doc, begin, end, ref, there + begin - start


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_TEXT = "doc_id long, n_words long, n_removed long, kept string"
_SPANS = "doc_id long, word_start long, word_end long, ref_doc_id long, ref_start long"


def _parse(window: int, buckets: int, schema: str):
    def parse(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs, window, buckets)
        second = np.asarray(answers["hit"].combine_chunks().is_valid(), dtype=bool) if answers.num_rows else np.zeros(0, bool)
        block.candidates(answers.filter(pa.array(~second)))
        doc, start, end, ref, there = _factors(block, answers.filter(pa.array(second)), window)
        named = block.docs["id"].combine_chunks() if block.docs.num_rows else pa.array([], pa.int64())
        if schema == _SPANS:
            return pa.table({"doc_id": named.take(pa.array(doc)), "word_start": pa.array(start), "word_end": pa.array(end), "ref_doc_id": pa.array(ref, pa.int64()), "ref_start": pa.array(there, pa.int64())})
        gone = np.bincount(doc, end - start, len(block.ids)).astype(np.int64)
        first = np.searchsorted(doc, np.arange(len(block.ids) + 1))
        out = []
        for i in range(len(block.ids)):
            words = block.body[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
            if gone[i]:
                stay = np.ones(len(words), bool)
                for k in range(first[i], first[i + 1]):
                    stay[start[k] : end[k]] = False
                words = compress(words, stay.tolist())
            kept = b" ".join(words)
            out.append(hashlib.sha256(kept).hexdigest() if schema == _KEPT else kept.decode())
        return pa.table([named, pa.array(block.words, pa.int64()), pa.array(gone), pa.array(out, pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    return parse


def _run(docs: DataFrame, window: int, schema: str, id_column: str, text_column: str) -> DataFrame:
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    blocks = blocks_for(docs, "text")
    buckets = max(partitions(docs.sparkSession), blocks // 4)
    # rows without an id, or with one id, go to many blocks
    dealt = docs.withColumn("row", F.xxhash64("text")).withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)))
    groups = dealt.groupBy("block")
    seen = groups.applyInArrow(_ask(window, buckets), _ASK).groupBy("bucket").applyInArrow(_seen, _SEEN)
    told = groups.cogroup(seen.groupBy("block")).applyInArrow(_offer(window, buckets), _OFFER).groupBy("bucket").applyInArrow(_index, _TELL)
    answers = seen.unionByName(told, allowMissingColumns=True)
    return groups.cogroup(answers.groupBy("block")).applyInArrow(_parse(window, buckets, schema), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what is left of each document without its factors.

    One row per input row. A null text is empty; texts with fewer than window words
    keep all; a null doc_id counts as larger than any other and is never a
    reference; rows that repeat a doc_id are no reference for each other; an empty
    table gives no rows; further columns are ignored.
    """
    return _run(docs, window, _KEPT, id_column, text_column)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``remove_repeats`` with the words that are left, joined by one space."""
    return _run(docs, window, _TEXT, id_column, text_column)


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, word_start, word_end, ref_doc_id, ref_start): the factors of each document, ends exclusive.

    The words of a factor stand in the reference from ref_start on. Of several texts with
    the reference's doc_id it is in one of them. Nulls, short and empty texts have no
    factors or are treated as in ``remove_repeats``; an empty table gives no rows.
    """
    return _run(docs, window, _SPANS, id_column, text_column)
