"""Token counts by a separator scan of flat token files.

A token file is a flat run of identifiers in blocks of a table in shared storage, each
document closed by the end-of-document identifier; there is no index. Identifiers have
16 bits, or 32 if the vocabulary needs them. The scan compares whole blocks with that identifier at once. Documents that cross
blocks are stitched by a prefix scan over one small row a block: the place of the last
separator before the block and the number of separators so far.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK, ROWS = 1 << 16, 256
#: Runs of white space from this length on are encoded apart, as the pattern would backtrack over them.
LONG_SPACE = 1000
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_FILE = "file long, block long, tokens binary, ids array<long>"


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _tokenizer(path: str):
    import tiktoken

    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def separator_of(path: str, separator: int | None = None) -> tuple[int, type]:
    """The end-of-document identifier, by default the first one after the vocabulary's, and the numbers' type."""
    ranks = set(_ranks(path).values())
    top = max(ranks, default=-1)
    separator = top + 1 if separator is None else separator
    if separator in ranks or not 0 <= separator < 1 << 32:
        raise ValueError(f"{separator} is a token of the vocabulary or no identifier")
    return separator, np.uint16 if max(top, separator) < 1 << 16 else np.uint32


@lru_cache(2)
def _piece_tokenizer(path: str):
    """Encodes a text as one piece of the pattern."""
    import tiktoken

    return tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})


def pieces(text: str, long: int = LONG_SPACE) -> Iterator[tuple[str, bool]]:
    """Parts of the text whose tokens, one part after the other, are the text's, and whether each is one piece of the pattern.

    Of a run of white space before something else the pattern takes all but the last
    character as one piece, and of one at the end all.
    """
    at = 0
    for m in re.finditer(f"(?<![{_SPACES}])[{_SPACES}]{{{long},}}+", text):
        end = m.end() - (m.end() < len(text))
        yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    yield text[at:], False


def encoder(path: str, long: int = LONG_SPACE):
    """A function that gives the tokens of a text of any length as arrays, part by part."""
    whole, piece = _tokenizer(path).encode_to_numpy, _piece_tokenizer(path).encode_to_numpy

    def encode(text: str) -> Iterator[np.ndarray]:
        for part, single in pieces(text, long):
            if part:
                yield (piece if single else whole)(part)

    return encode


def _tokenize(path: str, block: int, separator: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        task, made, held, parts, ids = TaskContext.get().partitionId(), 0, 0, [], []
        end = np.array([separator], kind)

        def emit(data: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([made], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "tokens", "ids"])

        for part in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            for i, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids.append(i)
                for tokens in encode(text or ""):
                    parts.append(tokens.astype(kind))
                    held += len(tokens)
                parts.append(end)
                held += 1
                if held >= block:
                    data = np.concatenate(parts)
                    while len(data) >= block:
                        yield emit(data[:block])
                        made, ids, data = made + 1, [], data[block:]
                    parts, held = [data], len(data)
        if held or ids:
            yield emit(np.concatenate(parts))

    return run


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text", separator: int | None = None) -> DataFrame:
    """The written token files: file, block, tokens; ids lists the documents in the order of the file."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_tokenize(vocabulary, block, *separator_of(vocabulary, separator)), _FILE), "tokens")


def _scan(separator: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                data = np.frombuffer(b["tokens"][k].as_buffer(), kind)
                at = np.flatnonzero(data == separator)
                last = int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_arrays([b["file"].slice(k, 1), b["block"].slice(k, 1), pa.array([len(data)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([last], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "n", "ends", "last", "at"])

    return run


def count_tokens(files: DataFrame, separator: int, kind: type = np.uint16) -> DataFrame:
    """(file, ordinal, n_tokens) of each document of files(file, block, tokens), without separators.

    kind is the type of the numbers in tokens, little-endian. What follows a file's last separator, if anything does, is one more document.
    """
    found = materialize(files.select("file", "block", "tokens").mapInArrow(_scan(separator, kind), "file long, block long, n long, ends long, last long, at array<long>"), "ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("file", "block", "n", "ends", "last")
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    slim = slim.select("*", start.alias("start"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ordinal"))
    slim = slim.select("*", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1)).alias("open"))
    rows = found.select("file", "block", "at").join(slim, ["file", "block"])
    # within a block: the distance from each end to the one before it
    length = F.transform("at", lambda e, i: F.when(i == 0, F.col("start") + e - F.col("open") - 1).otherwise(e - F.get("at", i - 1) - 1))
    closed = rows.select("file", F.col("ordinal").alias("first"), F.posexplode(length).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")
    total = slim.groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("ordinal"), F.coalesce(F.max(F.col("start") + F.col("last")), F.lit(-1)).alias("open"))
    rest = total.where("n - open - 1 > 0").select("file", "ordinal", (F.col("n") - F.col("open") - 1).alias("n_tokens"))
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of each row of docs, by way of flat token files.

    A null or empty text has no tokens; texts of any length and content are encoded whole;
    a vocabulary that has the separator raises ValueError, as does an empty one; null and repeated ids are carried along, row by
    row; an empty table gives no rows; further columns are ignored.
    """
    if not _ranks(vocabulary):
        raise ValueError("an empty vocabulary")
    files = write_tokens(docs, vocabulary, block, id_column, text_column)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lists = files.select("file", "block", "ids")
    first = lists.select("file", "block", F.size("ids").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    names = lists.join(first, ["file", "block"]).select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(count_tokens(files, *separator_of(vocabulary)), ["file", "ordinal"]).select("doc_id", "n_tokens")
