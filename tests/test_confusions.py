"""Alignments with few rows held against the whole table of costs."""

import random

import numpy as np
import pytest

from quillspark.functions.text import aligned_confusions


def whole_table(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    found, i, j = {}, len(a), len(b)
    while i or j:
        if i and d[i, j] == d[i - 1, j] + 1:
            key, i = (a[i - 1], ""), i - 1
        elif j and d[i, j] == d[i, j - 1] + 1:
            key, j = ("", b[j - 1]), j - 1
        else:
            key, i, j = (a[i - 1], b[j - 1]), i - 1, j - 1
            if key[0] == key[1]:
                continue
        found[key] = found.get(key, 0) + 1
    return found


@pytest.mark.parametrize("kept", [None, 1, 2, 7, 1000])
def test_equal_to_the_whole_table(kept):
    rng = random.Random(1)
    for _ in range(120):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        assert aligned_confusions(a, b, kept) == whole_table(a, b)


def test_long_texts():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    b = a[:5000] + "Q" + a[5001:15_000] + a[15_003:]
    found = aligned_confusions(a, b)
    assert found[a[5000], "Q"] == 1
    assert sum(n for (t, p), n in found.items() if p == "") == 3
    assert sum(found.values()) == 4
