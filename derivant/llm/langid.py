"""Language identification by mixture inference.

Character trigrams (of bytes, inside words and their bounds) are counted by language
over all documents of the learning folds. A document is a mixture of languages: each
word has a likelihood under every language from its trigrams, and
expectation-maximisation over the document's words estimates the proportions. The set
of languages is chosen by penalised likelihood among the nested sets of the largest
proportions; the largest proportion within that set is the prediction and its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import held_out

#: The model has a table of 2**bits numbers for each language: BITS of them for up to
#: TABLE_NUMBERS in all, and as many fewer as more languages need, but LEAST_BITS.
BITS, LEAST_BITS, TABLE_NUMBERS = 14, 8, 1 << 24
ROUNDS, REFINE, SMOOTH, PIECE = 12, 4, 0.5, 1 << 18
UNKNOWN = "und"
_MIX = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def bits_for(languages: int) -> int:
    """The bits of a trigram code, such that the model fits into a worker whatever the number of languages."""
    bits = BITS
    while languages << bits > TABLE_NUMBERS and bits > LEAST_BITS:
        bits -= 1
    if languages << bits > TABLE_NUMBERS:
        raise ValueError(f"{languages} languages: a table of {1 << LEAST_BITS} numbers for each has more than {TABLE_NUMBERS}")
    return bits


def _trigrams(offsets: np.ndarray, body: np.ndarray, bits: int = BITS, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, codes, first code of each word, words' offsets by text) for runs of texts.

    Texts are set apart by spaces, so no trigram spans two of them.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + piece, "right")) - 1, i + 1), n)
        rel = offsets[i : j + 1] - offsets[i]
        d = j - i
        buf = np.full(int(rel[-1]) + d + 2, 0x20, np.uint8)
        row = np.repeat(np.arange(d), np.diff(rel))
        buf[np.arange(int(rel[-1])) + row + 1] = W._LOWER[body[offsets[i] : offsets[j]]]
        space = W._SPACE[buf]
        buf[space] = 0x20
        wide = buf.astype(np.uint32)
        codes = ((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
        # the codes of a word are those whose middle byte is in it
        inner = ~space[1:-1]
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        starts = np.flatnonzero(first)
        yield i, j, np.where(inner, codes, np.uint32(1 << bits)), starts, np.searchsorted(starts, rel + np.arange(d + 1))
        i = j


def _count(bits: int):
    size = (1 << bits) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def out(names: list[str]) -> pa.RecordBatch:
            rows = [(x, np.flatnonzero(counts[x][:-1])) for x in names]
            codes = np.concatenate([at for _, at in rows])
            n = np.concatenate([counts[x][at] for x, at in rows])
            langs = pa.array([x for x, _ in rows]).take(pa.array(np.repeat(np.arange(len(rows)), [len(at) for _, at in rows])))
            for x in names:
                del counts[x]
            return pa.RecordBatch.from_arrays([langs, pa.array(codes, pa.int32()), pa.array(n, pa.int64())], ["lang", "code", "n"])

        for b in batches:
            langs = b["lang"].to_pylist()
            offsets, body, _ = W.flat(b["text"])
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            of = np.array([number[x] for x in langs], np.int64)
            for x in names:
                counts.setdefault(x, np.zeros(size, np.int64))
            for i, j, codes, _, _ in _trigrams(offsets, body, bits):
                rel = offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1)
                here, lang = np.unique(of[i:j], return_inverse=True)
                lang = np.repeat(lang, np.diff(rel))
                both = np.bincount(lang * size + codes[: len(lang)], minlength=len(here) * size).reshape(len(here), -1)
                for k, c in zip(here.tolist(), both, strict=True):
                    counts[names[k]] += c
            while len(counts) * size > TABLE_NUMBERS:  # what is held is bounded; the rest is summed later
                yield out(list(counts)[: max(1, len(counts) // 2)])
        if counts:
            yield out(list(counts))

    return run


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and their log likelihoods of the trigram codes, from all rows of docs with a language.

    More than TABLE_NUMBERS >> LEAST_BITS languages (65,536) raise ValueError: that many are
    no languages, and a model that has them would not fit into a worker.
    """
    rows = docs.select(F.col(lang_column).cast("string").alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).where("lang is not null")
    names = rows.select("lang").distinct()
    bits = bits_for(names.count())
    langs = sorted(r["lang"] for r in names.collect())
    if not langs:
        return [], np.zeros((1 << bits, 0), np.float32)
    number = {x: k for k, x in enumerate(langs)}
    counts = np.zeros((1 << bits, len(langs)))
    summed = rows.mapInArrow(_count(bits), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = summed.groupBy("lang").agg(F.collect_list("code").alias("codes"), F.collect_list("n").alias("counts")).toArrow()  # 2**bits pairs a language at most
    for x, codes, n in zip(table["lang"].to_pylist(), table["codes"], table["counts"], strict=True):
        counts[np.asarray(codes.values), number[x]] = np.asarray(n.values)
    return langs, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * (1 << bits))).astype(np.float32)


def _em(like: np.ndarray, text: np.ndarray, cut: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """The proportions of each text, which settle text by text; like has the words' likelihoods, every text has words."""
    n = np.diff(cut)[:, None]
    settled = np.zeros(len(n), bool)
    for _ in range(rounds):
        part = like * share[text]
        part /= part.sum(1, keepdims=True)
        old, new = share, np.add.reduceat(part, cut[:-1]) / n
        share = np.where(settled[:, None], old, new)
        settled |= np.abs(share - old).max(1) < 2e-3
        if settled.all():
            break
    return share


def infer(log: np.ndarray, text: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its proportion, the chosen set's proportions) of each text from the log likelihoods of its words.

    No text's result depends on the texts beside it: all nested sets are tried, up to the
    size from which a text's penalty alone outweighs what it has.
    """
    d, n_lang = len(cut) - 1, log.shape[1]
    like = np.exp(log - log.max(1, keepdims=True)) + np.float32(1e-12)
    share = _em(like, text, cut, np.full((d, n_lang), 1 / n_lang, np.float32), ROUNDS)
    best = share.argmax(1)
    order = np.argsort(-share, 1, kind="stable")
    second = share[np.arange(d), order[:, 1]] if n_lang > 1 else np.zeros(d)
    score = np.ones(d)
    sets = np.zeros((d, n_lang), np.float32)
    sets[np.arange(d), best] = 1
    mixed = np.flatnonzero(second > 0.02)
    if len(mixed):
        pick = np.isin(text, mixed)
        sub, of = like[pick], np.searchsorted(mixed, text[pick])
        words = np.diff(cut)[mixed]
        at = np.concatenate([[0], np.cumsum(words)])
        value, chosen = np.full(len(mixed), -np.inf), np.zeros((len(mixed), n_lang), np.float32)
        penalty = np.log(np.maximum(words, 2))
        for k in range(1, n_lang + 1):
            # a word's likelihood is about 1 at most, so no set of k has more than this
            if not (value <= words * 1e-5 - (k - 1) * penalty).any():
                break
            inside = np.zeros((len(mixed), n_lang), np.float32)
            np.put_along_axis(inside, order[mixed, :k], 1, 1)
            s = share[mixed] * inside + inside * np.float32(1e-6)
            s /= s.sum(1, keepdims=True)
            if k > 1:
                s = _em(sub, of, at, s, REFINE)
            total = np.add.reduceat(np.log((sub * s[of]).sum(1)), at[:-1]) - (k - 1) * penalty
            better = total > value
            value[better], chosen[better] = total[better], s[better]
        best[mixed] = chosen.argmax(1)
        score[mixed] = chosen.max(1)
        sets[mixed] = chosen
    return best, np.clip(score, 0, 1), sets


def _word_likelihoods(padded: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The log likelihoods of words, some at a time, as their codes take more room than they do."""
    step = max(1, (1 << 23) // padded.shape[1])
    out, ends = [], np.append(starts[1:], len(codes))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, "right")))
        out.append(np.add.reduceat(padded[codes[starts[a] : ends[b - 1]]], starts[a:b] - starts[a]))
        a = b
    return np.concatenate(out)


def predict_batch(column: pa.Array, langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray, list[list[tuple[str, float]]]]:
    """The language, score and chosen set, with the largest proportion first, of each text."""
    offsets, body, _ = W.flat(column)
    names, scores = [UNKNOWN] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
    mixes: list[list[tuple[str, float]]] = [[] for _ in names]
    if not langs:
        return names, scores, mixes
    padded = np.vstack([table, np.zeros((1, len(langs)), np.float32)])
    # a word has a number for each language, so many languages take shorter runs of texts
    piece = max(1 << 10, min(PIECE, (PIECE << 5) // len(langs)))
    for i, j, codes, starts, cut in _trigrams(offsets, body, len(table).bit_length() - 1, piece):
        letters = np.diff(np.searchsorted(np.flatnonzero(_LETTER[body[offsets[i] : offsets[j]]]), offsets[i : j + 1] - offsets[i])) > 0
        for k in np.flatnonzero(~letters):
            raw = body[offsets[i + k] : offsets[i + k + 1]]
            if (raw >= 0x80).any():
                letters[k] = any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
        if not len(starts) or not letters.any():
            continue
        log = _word_likelihoods(padded, codes, starts)
        words = np.diff(cut)
        some = np.flatnonzero(words > 0)
        best, score, sets = infer(log, np.repeat(np.arange(len(some)), words[some]), np.concatenate([[0], np.cumsum(words[some])]))
        for k, x, s, mix in zip(some.tolist(), best.tolist(), score.tolist(), sets, strict=True):
            if letters[k]:
                names[i + k], scores[i + k] = langs[x], s
                inside = np.flatnonzero(mix)
                mixes[i + k] = [(langs[m], float(mix[m])) for m in inside[np.argsort(-mix[inside], kind="stable")]]
    return names, scores, mixes


def _predict(langs: list[str], table: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, mixes = predict_batch(b["text"], langs, table)
            mix = pa.array([[{"lang": x, "share": p} for x, p in m] for m in mixes], _MIX)
            yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array(names, pa.string()), pa.array(scores), mix], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    return predict


def mixtures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of each row of docs; languages is the chosen set.

    It lists (lang, share), the largest share first. Texts that are null or have no
    letter are ``und`` with score 0 and no languages, as is every text if there is nothing
    to learn from; null languages teach nothing; a null id is held out; repeated rows are
    predicted one by one; ties go to the first language by code point; an empty table
    gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).withColumn("held_out", held_out("id"))
    langs, table = train(rows.where("not held_out"))
    return rows.select("id", "held_out", "text").mapInArrow(_predict(langs, table), "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs: ``mixtures`` without the set.

    What it says of nulls, ties, repeated rows, empty tables and further columns holds here,
    as does the bound of ``train`` on the number of languages.
    """
    return mixtures(docs, id_column, text_column, lang_column).drop("languages")
