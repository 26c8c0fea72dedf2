"""Personal data by weak supervision.

Candidates are the base matches (email, ip, card, phone) and looser ones (numbers
without a plus sign, social security numbers, spelled-out addresses, secrets).
Labelers vote for or against each candidate or abstain: the strict pattern with its
checksum, gazetteers of prefixes and domains, context words before the candidate,
its boundaries, and the variety of its characters. Expectation-maximisation over the
counts of all vote patterns of the whole corpus estimates each labeler's reliability
by kind; its posteriors then train a logistic classifier of spans, which decides about
the looser candidates. The classifier sees no vote but the span itself and what is
around it (its make-up of characters, its length and variety, the words before and
after, the characters beside it), so it carries over to spans that the labelers judge
wrongly or not at all. Base matches always stay. Vote patterns are bounded by
construction, and the classifier's steps sum moments, so what reaches the driver does
not grow with the corpus; no candidate is sampled.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import materialize

#: In the order in which spans with the same start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "local_phone", "ssn", "spelled_email", "secret")
BASE = 4

# The lookbehinds change nothing but the time: a match never begins inside a run of digits.
# Possessive runs are of any length and read once. A secret goes on over dots inside it.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?(?:\(at\)|\[at\])[\x20]?[A-Za-z0-9-]++(?:[\x20]?(?:\.|\(dot\)|\[dot\])[\x20]?[A-Za-z0-9-]{2,}+)++", re.I)
_SECRET = re.compile(r"""\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\x20]{0,2}[=:][\x20]{0,2}["']?((?=[A-Za-z0-9+/_=.-]{16})[A-Za-z0-9+/_=-]++(?:\.++[A-Za-z0-9+/_=-]++)*+)["']?""", re.I)
_LOCAL_PART = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

DOMAINS = frozenset("com org net edu gov mil int info io ai co biz de fr es it uk us eu ch at be nl pl pt se no dk fi ru jp cn in br mx ca au nz".split())
CONTEXT = {
    "email": "mail email e-mail contact contacto kontakt courriel correo write",
    "ip": "ip host server address adresse addr login from client",
    "card": "card visa mastercard amex credit karte carte tarjeta payment pay",
    "phone": "phone tel telephone call fax mobile cell telefon telefono",
    "local_phone": "phone tel telephone call fax mobile cell telefon telefono",
    "ssn": "ssn social security sozialversicherung",
    "spelled_email": "mail email e-mail contact contacto kontakt courriel correo write",
    "secret": "token secret password passwd key",
}
AGAINST = frozenset("version isbn issn doi order page chapter section figure table license revision release".split())
_ASK = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
LABELERS = 5
LENGTHS = (8, 14, 24)
#: Words before and after a span are hashed to so many numbers each.
WORD_BITS = 4
FEATURES = 20 + 2 * (1 << WORD_BITS)
RIDGE, ROUNDS = 1e-3, 8
_SPANS = "kinds array<int>, starts array<int>, ends array<int>, patterns array<int>, x binary"
_SCHEMA = f"doc_id long, {_SPANS}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: from each @ to both sides, in linear time."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL_PART:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = end = m.end()
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches that hold, in code points."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def _loose_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(k, *m.span()) for k, rx in ((4, _LOCAL), (5, _SSN)) for m in rx.finditer(text)]
    lower = text.lower()
    if "at)" in lower or "at]" in lower:
        found += [(6, *m.span()) for m in _SPELLED.finditer(text)]
    if any(x in lower for x in ("token", "secret", "passw", "key")):
        found += [(7, *m.span(1)) for m in _SECRET.finditer(text) if m.end(1) - m.start(1) >= 16]
    return found


def votes(text: str, kind: int, a: int, b: int) -> tuple[int, ...]:
    """The labelers' votes (1 for, -1 against, 0 abstains) on text[a:b]."""
    span, name = text[a:b], KINDS[kind]
    digits = re.sub("[^0-9]", "", span)
    if kind == 5:
        strict = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
    elif kind == 7:
        strict = 1 if re.search("[0-9]", span) and re.search("[A-Za-z]", span) else -1
    else:
        strict = 1 if kind < BASE or kind == 6 else 0
    if kind in (0, 6):
        known = 1 if re.split(r"[.\s\])]+", span.lower())[-1] in DOMAINS else -1
    elif kind == 1:
        known = -1 if span.split(".")[0] in ("0", "127", "255") else 1
    elif kind == 2:
        known = 1 if digits[0] in "3456" else -1
    elif kind in (3, 4):
        known = -1 if len(set(digits)) < 3 else 1
    else:
        known = 0
    before = [w.lower() for w in _WORD.findall(text[max(0, a - 40) : a])][-4:]
    context = 1 if _ASK[name].intersection(before) else -1 if AGAINST.intersection(before) else 0
    bound = -1 if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()) else 1
    variety = len(set(digits if kind in (1, 2, 3, 4, 5) else span))
    return strict, known, context, bound, (1 if variety >= 4 else -1 if variety <= 2 else 0)


def _pattern(kind: int, given: tuple[int, ...], length: int) -> int:
    code = kind
    for v in given:
        code = code * 3 + v + 1
    return code * (len(LENGTHS) + 1) + sum(length > x for x in LENGTHS)


def _features(pattern: int) -> tuple[int, tuple[int, ...], int]:
    pattern, length = divmod(pattern, len(LENGTHS) + 1)
    given = []
    for _ in range(LABELERS):
        pattern, v = divmod(pattern, 3)
        given.append(v - 1)
    return pattern, tuple(reversed(given)), length


def _word_number(word: str) -> int:
    return zlib.crc32(word.lower().encode()) & ((1 << WORD_BITS) - 1)


def span_features(text: str, a: int, b: int) -> list[float]:
    """What the classifier knows of text[a:b]: the span and its surroundings, no votes."""
    span, n = text[a:b], b - a
    ascii_ = [ord(c) for c in span]
    digits = sum(48 <= c <= 57 for c in ascii_)
    upper, lower = sum(65 <= c <= 90 for c in ascii_), sum(97 <= c <= 122 for c in ascii_)
    groups = re.findall("[0-9]+", span)
    turns = sum((x.isdigit(), x.isalpha()) != (y.isdigit(), y.isalpha()) for x, y in zip(span, span[1:], strict=False))
    before, after = text[a - 1] if a else "", text[b] if b < len(text) else ""
    x = [1.0, digits / n, upper / n, lower / n, 1 - (digits + upper + lower) / n, math.log(n) / 5, len(set(span)) / n, len(set(span)) / 32, turns / n, min(len(groups), 8) / 8]
    x += [max(map(len, groups), default=0) / n, float(upper > 0 < lower), float(digits > 0 < upper + lower), float(span[:1].isdigit()), float(span[-1:].isdigit()), float(before.isalnum()), float(after.isalnum()), float(before in "\"'=:"), float(before.isspace() or not before), float(after.isspace() or not after or after in ",.;:!?)\"'")]
    words = [0.0] * (2 << WORD_BITS)
    for w in _WORD.findall(text[max(0, a - 40) : a])[-3:]:
        words[_word_number(w)] = 1.0
    for w in _WORD.findall(text[b : b + 24])[:1]:
        words[(1 << WORD_BITS) + _word_number(w)] = 1.0
    return x + words


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, vote pattern): base matches, and looser ones that overlap none of them.

    A secret stays whole also where a base match lies in it.
    """
    out = base_spans(text)
    starts, ends = [], []  # of what base matches take, put together
    for a, b in sorted((a, b) for _, a, b in out):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    loose_end = 0
    for kind, a, b in sorted(_loose_spans(text), key=lambda s: (s[1], s[0])):
        k = bisect_right(ends, a)  # the first that ends after a
        if a >= loose_end and (kind == 7 or k == len(ends) or starts[k] >= b):
            out.append((kind, a, b))
            loose_end = b
    return sorted(((k, a, b, _pattern(k, votes(text, k, a, b), b - a)) for k, a, b in out), key=lambda s: (s[1], s[0]))


_DIGIT_OR_AT = np.zeros(256, bool)
_DIGIT_OR_AT[[*range(0x30, 0x3A), 0x40]] = True


def _texts(column: pa.Array) -> Iterator[str | None]:
    """Each text that can hold a candidate; None for the others."""
    offsets, body, _ = W.flat(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(max(int(np.searchsorted(offsets, offsets[i] + W.PIECE, "right")) - 1, i + 1), n)
        part = body[offsets[i] : offsets[j]]
        at = np.flatnonzero(_DIGIT_OR_AT[part]) + offsets[i]
        some = np.diff(np.searchsorted(at, offsets[i : j + 1])) > 0
        lower = part.tobytes().lower()
        words = any(x in lower for x in (b"token", b"secret", b"passw", b"key", b"at)", b"at]"))
        for k in range(i, j):
            if some[k - i] or words:
                yield body[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            else:
                yield None
        i = j


def _found(column: pa.Array) -> list[pa.Array]:
    """kinds, starts, ends, patterns and features of the candidates of each text."""
    rows, features = [], []
    for t in _texts(column):
        mine = candidates(t) if t else []
        rows.append(mine)
        features.append(np.array([span_features(t, a, b) for _, a, b, _ in mine], np.float32).tobytes())
    return [*(pa.array([[s[k] for s in r] for r in rows], pa.list_(pa.int32())) for k in range(4)), pa.array(features, pa.binary())]


_NAMES = ["kinds", "starts", "ends", "patterns", "x"]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["id"], *_found(b["text"])], ["doc_id", *_NAMES])


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """The posterior of each vote pattern: reliabilities by kind and labeler from expectation-maximisation."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        mine = sorted(p for p in counts if _features(p)[0] == kind)
        if not mine:
            continue
        n = np.array([counts[p] for p in mine], float)
        v = np.array([_features(p)[1] for p in mine]) + 1
        post = 1 / (1 + np.exp(-(v - 1).sum(1).astype(float)))  # a majority vote to begin with
        for _ in range(rounds):
            old = post
            prior = ((n * post).sum() + 2) / (n.sum() + 4)
            log = np.log(prior) - np.log(1 - prior) + np.zeros(len(mine))
            for j in range(LABELERS):
                for_ = np.bincount(v[:, j], n * post, 3) + (0.5, 1.0, 1.5)  # labelers are better than chance
                against = np.bincount(v[:, j], n * (1 - post), 3) + (1.5, 1.0, 0.5)
                log += np.log(for_ / for_.sum())[v[:, j]] - np.log(against / against.sum())[v[:, j]]
            post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            if np.abs(post - old).max() < 1e-9:
                break
        out.update(zip(mine, post.tolist(), strict=True))
    return out


def _spans_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, kind, pattern, features) of the candidates of a batch."""
    kinds = b["kinds"]
    text = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(kinds.offsets)))
    x = np.frombuffer(b"".join(b["x"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
    return text, np.asarray(kinds.flatten()), np.asarray(b["patterns"].flatten()), x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _moments(soft: dict[int, float], w: np.ndarray):
    """Gradient and curvature, by kind, of the logistic loss against the posteriors."""
    size = FEATURES * (FEATURES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(KINDS), size))
        for b in batches:
            _, kind, pattern, x = _spans_of(b)
            y = np.array([soft[p] for p in pattern.tolist()])
            for k in np.unique(kind):
                m = x[kind == k]
                p = _sigmoid(m @ w[k])
                total[k] += np.concatenate([m.T @ (p - y[kind == k]), ((m.T * (p * (1 - p))) @ m).ravel()])
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["kind", "m"])

    return run


def _step(w: np.ndarray, n: float, m: np.ndarray) -> np.ndarray:
    """A Newton step for one kind, from its summed moments over n candidates."""
    curve = m[FEATURES:].reshape(FEATURES, FEATURES) / n + RIDGE * np.eye(FEATURES)
    step = np.linalg.solve(curve, m[:FEATURES] / n + RIDGE * w)
    return w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))


def learn(found: DataFrame) -> np.ndarray:
    """A row of weights for each kind, from the candidates in found.

    Vote patterns and moments reach the driver, no candidates. Weights are rounded, so the
    order in which moments are summed does not show.
    """
    some = found.where("size(patterns) > 0")
    rows = some.select(F.explode("patterns").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    counts = {r["p"]: r["n"] for r in rows}
    soft, w = estimate(counts), np.zeros((len(KINDS), FEATURES))
    many = np.bincount([_features(p)[0] for p in counts], list(counts.values()), len(KINDS)) if counts else np.zeros(len(KINDS))
    for _ in range(ROUNDS if counts else 0):
        parts = some.select("kinds", "patterns", "x").mapInArrow(_moments(soft, w), "kind int, m array<double>")
        total = parts.select("kind", F.posexplode("m").alias("i", "v")).groupBy("kind", "i").agg(F.sum("v").alias("v")).toArrow()
        m = np.zeros((len(KINDS), FEATURES * (FEATURES + 1)))
        m[np.asarray(total["kind"]), np.asarray(total["i"])] = np.asarray(total["v"])
        old = w
        w = np.array([_step(w[k], many[k], m[k]) if many[k] else w[k] for k in range(len(KINDS))])
        if np.abs(w - old).max() < 1e-4:
            break
    return np.round(w, 6)


def _kept(b: pa.RecordBatch, w: np.ndarray, threshold: float) -> list[list[tuple[int, int, int]]]:
    """The spans of each row that stay: base matches, and those that the classifier takes."""
    text, kind, _, x = _spans_of(b)
    take = (kind < BASE) | (_sigmoid((x * w[kind]).sum(1)) >= threshold)
    starts, ends = np.asarray(b["starts"].flatten()), np.asarray(b["ends"].flatten())
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(b.num_rows)]
    for t, k, a, e in zip(text[take].tolist(), kind[take].tolist(), starts[take].tolist(), ends[take].tolist(), strict=True):
        out[t].append((k, a, e))
    return out


def _digest(w: np.ndarray, threshold: float):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, spans, added = [[], [], [], []], [], [], []
            for kept in _kept(b, w, threshold):
                base = [s for s in kept if s[0] < BASE]
                for k in range(BASE):
                    counts[k].append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{e}" for k, a, e in base).encode()).hexdigest())
                spans.append(",".join(f"{KINDS[k]}:{a}:{e}" for k, a, e in kept))
                added.append(len(kept) - len(base))
            total = [sum(x) + n for x, n in zip(zip(*counts, strict=True), added, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(total, pa.int64())], [*_DIGEST])

    return digest


_DIGEST = {"doc_id": "long", "n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long", "base_sha256": "string", "spans": "string", "n_added": "long", "n_spans": "long"}


def find_candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(_find, _SCHEMA)


def find_pii(docs: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) of each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind.
    A null text is empty; an empty text has no spans (base_sha256 is that of nothing);
    null and repeated ids are carried along, row by row; an empty table gives no rows;
    further columns are ignored.
    """
    found = materialize(find_candidates(docs, id_column, text_column), "pii")
    return found.mapInArrow(_digest(learn(found), threshold), ", ".join(f"{n} {t}" for n, t in _DIGEST.items()))


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["row"], *_found(b["text"])], ["row", *_NAMES])


def _redact(w: np.ndarray, threshold: float, k: int):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b["row"]
            column = row.field(k)
            out = column.to_pylist()
            for i, kept in enumerate(_kept(b, w, threshold)):
                if not kept:
                    continue
                text, parts, at = out[i], [], 0
                for kind, a, e in kept:
                    if a >= at:
                        parts += [text[at:a], f"<{KINDS[kind].upper()}>"]
                    at = max(at, e)
                out[i] = "".join([*parts, text[at:]])
            names = [row.type.field(j).name for j in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays([pa.array(out, column.type) if j == k else row.field(j) for j in range(len(names))], names)

    return redact


def redact(docs: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans become one.

    All rows and columns stay, with whatever names and ids; null and empty texts stay as
    they are; repeated rows are redacted alike; an empty table stays empty. The texts are
    searched once and written with what was found.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(docs.columns)]).alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType
    found = materialize(rows.mapInArrow(_carry, f"row {kind.simpleString()}, {_SPANS}"), "pii")
    k = docs.columns.index(text_column)
    out = found.mapInArrow(_redact(learn(found), threshold, k), kind)
    return out.select(*[F.col(f"c{j}").alias(c) for j, c in enumerate(docs.columns)])
