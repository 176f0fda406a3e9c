import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm.suffixes import suffix_array


def naive(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("text", [b"", b"a", b"aa", b"aaaaaa", b"banana", b"mississippi", b"gccttaacattattacgccta", b"abababab", b"zyxw", b"abcd", b"abacabadabacaba"])
def test_known(text):
    assert suffix_array(text) == naive(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_small_alphabet(values):
    assert suffix_array(values) == naive(values)


def test_random_long():
    rng = random.Random(1)
    for k in (2, 4, 200):
        t = [rng.randrange(k) for _ in range(3000)]
        assert suffix_array(t) == naive(t)
