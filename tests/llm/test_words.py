"""Word hashing against splitting, whatever the pieces."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from derivant.llm import _words as W

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x0c\r\x1f😀", max_size=40)), max_size=12)


@settings(max_examples=600, deadline=None)
@given(texts, st.integers(4, 50))
def test_word_groups(values, piece):
    offsets, body, null = W.flat(pa.array(values, pa.string()))
    assert null.tolist() == [v is None for v in values]
    seen: dict[int, bytes] = {}
    done = 0
    for i, j, h, where in W.word_groups(offsets, body, piece=piece):
        assert i == done
        done = j
        for k in range(i, j):
            words = (values[k] or "").encode().split()
            assert words == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", values[k] or "")]
            mine = h[where[k - i] : where[k - i + 1]].tolist()
            assert len(mine) == len(words)
            for a, w in zip(mine, words, strict=True):
                assert seen.setdefault(a, w) == w
    assert done == len(values) and len(set(seen.values())) == len(seen)


def test_lower_case_and_slices():
    column = pa.array(["x", "Ab É", None, "aB É", ""]).slice(1)
    offsets, body, _ = W.flat(column)
    (_, _, h, where), = W.word_groups(offsets, body, lower=True)
    assert where.tolist() == [0, 2, 2, 4, 4] and h[:2].tolist() == h[2:].tolist()


def test_windows_and_shingles():
    h = np.arange(10, dtype=np.uint64)
    w = W.window_hashes(np.tile(h, 2), 3, 12345678901)
    assert w[0] == w[10] and len(set(w.tolist())) == 10
    at, text = W.window_starts(np.array([0, 2, 2, 7, 10]), 3)
    assert at.tolist() == [2, 3, 4, 7] and text.tolist() == [2, 2, 2, 3]
    keys, text = W.shingle_sets(np.array([1, 2, 1, 2, 1, 2, 5, 6], np.uint64), np.array([0, 6, 6, 8]), 3)
    assert text.tolist() == [0, 0, 2]


def test_a_long_text_ends_where_it_ends():
    """The last piece of a long text has no white space; what follows belongs to the next text."""
    offsets, body, _ = W.flat(pa.array(["x" * 9 + " " + "y" * 5, "z z", "y" * 5]))
    found = {}
    for i, j, h, where in W.word_groups(offsets, body, piece=4):
        for k in range(i, j):
            found[k] = h[where[k - i] : where[k - i + 1]].tolist()
    assert [len(found[k]) for k in range(3)] == [2, 2, 1] and found[0][1] == found[2][0] and found[1][0] == found[1][1]


def doubling(n, a="a", b="b"):
    """n letters of the word that repeats itself with a and b exchanged, again and again."""
    w = a
    while len(w) < n:
        w += w.translate(str.maketrans(a + b, b + a))
    return w[:n]


def test_patterns_do_not_collide():
    values = [doubling(1 << k, *ab) for k in range(13) for ab in (("a", "b"), ("b", "a"))]
    values += ["ab" * 8 + "ba" * 8, "ba" * 8 + "ab" * 8, "a" * 16 + "b" * 16, "b" * 16 + "a" * 16, "x" * 8, "x" * 9, "x" * 16, "x" * 17, "\0", "\0\0", "\0" * 8, "\0" * 9]
    offsets, body, _ = W.flat(pa.array(values))
    for lane in range(2):
        found = {}
        for i, j, h, where in W.word_groups(offsets, body, lanes=2):
            for k in range(i, j):
                found[k] = h[lane][where[k - i]]
        assert len(set(found.values())) == len(set(values))


def test_lanes_give_the_same_sets():
    column = pa.array(["a b c d e f g", "x", None, "a b c a b c", "long-word-of-many-letters b c"])
    offsets, body, _ = W.flat(column)
    (_, _, h, where), = W.word_groups(offsets, body, lanes=2)
    (_, _, one, _), = W.word_groups(offsets, body)
    assert (h[0] == one).all() and not (h[0] == h[1]).any()
    keys, text, other = W.shingle_sets(h[0], where, 3, h[1])
    plain, plain_text = W.shingle_sets(one, where, 3)
    assert keys.tolist() == plain.tolist() and text.tolist() == plain_text.tolist() and len(set(other.tolist())) == len(set(keys.tolist()))
