import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import words


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5), st.integers(1, 4))
def test_gram_sets(texts, k):
    h, n = words.gram_sets(texts, k)
    at = 0
    for t, m in zip(texts, n):
        w = words.words(t)
        assert m == len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
        assert (np.diff(h[at : at + m].astype(object)) > 0).all()
        at += m


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abB1_ é\u0130ßΣ工。\n", max_size=30)), max_size=6), st.sampled_from([1, 20, 1 << 21]))
def test_word_hashes_are_equal_for_equal_words(texts, at_once):
    words.AT_ONCE, kept = at_once, words.AT_ONCE
    try:
        h, n = words.word_hashes(texts)
    finally:
        words.AT_ONCE = kept
    lists = [words.words(t) for t in texts]
    assert n.tolist() == [len(x) for x in lists]
    flat = [w for x in lists for w in x]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
