import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.gsaca import suffix_arrays


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=25), min_size=1, max_size=40))
def test_suffix_arrays_of_many_strings(strings):
    text = np.array([ord(c) for s in strings for c in s + "\0"])
    size = np.array([len(s) + 1 for s in strings])
    got, at, want = suffix_arrays(text, size), 0, []
    for s in strings:
        want += [at + i for i in sorted(range(len(s) + 1), key=lambda i: s[i:])]
        at += len(s) + 1
    assert got.tolist() == want
