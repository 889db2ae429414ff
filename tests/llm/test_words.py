"""Words and hashes of blocks of texts against plain splitting."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfold.llm import _words as W

TEXTS = st.lists(st.none() | st.text(alphabet="ab éẞ1A-Z\t\n\x0b\x0c\r.\x1c\x85", max_size=40), max_size=12)


def plain(text, lower):
    data = (text or "").encode()
    return data.lower().split() if lower else re.findall(rb"[0-9a-z\x80-\xff]+", data.lower())


@given(TEXTS, st.booleans(), st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_words_of_blocks(texts, spaces, most):
    separators = W.SPACE if spaces else W.NOT_ALNUM
    got, hashes = [], {}
    for lo, hi, buf, bounds in W.blocks(pa.array(texts, pa.string()), most):
        h, starts, ends, first = W.words(buf, bounds, separators, W.LOWER)
        low = W.LOWER[buf].tobytes()
        for a, b in zip(first[:-1], first[1:]):
            got.append([low[s:e] for s, e in zip(starts[a:b], ends[a:b])])
        for s, e, x in zip(starts, ends, h):
            assert hashes.setdefault(low[s:e], x) == x
    assert got == [plain(t, spaces) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_long_words_and_texts():
    long_ = "x" * (3 * W.BLOCK + 5)
    text = f"{long_} y {long_}z {long_}"
    for lo, hi, buf, bounds in W.blocks(pa.array([text, "y"])):
        h, _, _, first = W.words(buf, bounds, W.SPACE)
        if lo == 0:
            assert len(h) == 4 and h[0] == h[3] != h[2]
            y = h[1]
        else:
            assert h[0] == y


def test_grams():
    h = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    again = np.concatenate([h, h])
    for f in (W.grams, W.window_hash):
        g = f(again, 7)
        assert len(g) == 94 and (g[:44] == g[50:94]).all() and len(np.unique(g)) == 50
        assert len(f(h[:3], 7)) == 0
