from hypothesis import given
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from memquarry.llm import common as C


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=40))
def test_disjoint_is_greedy(pairs):
    spans = [(a, a + n) for a, n in pairs]
    want = []
    for s in spans:
        if all(s[1] <= o[0] or s[0] >= o[1] for o in want):
            want.append(s)
    assert C.disjoint(spans, lambda s: s[0], lambda s: s[1]) == want


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=30), st.integers(1, 50))
def test_slices_cover_all_rows(texts, most):
    found = list(C.slices(texts, most))
    assert [k for i, j in found for k in range(i, j)] == list(range(len(texts)))
    assert all(j == i + 1 or sum(len(t or "") for t in texts[i:j]) <= most for i, j in found)


def test_regrouped_keeps_rows_and_order():
    batches = [pa.RecordBatch.from_arrays([pa.array([i, i + 1]), pa.array(["x" * 10, None])], names=["id", "t"]) for i in range(0, 20, 2)]
    out = list(C.regrouped(iter(batches), 1, 35))
    assert [v for b in out for v in b.column(0).to_pylist()] == list(range(20)) and len(out) < 10
    assert list(C.regrouped(iter([]), 1)) == []


def test_gathered():
    pool = np.arange(10)
    assert C.gathered(pool, np.array([3, 0, 5]), np.array([2, 0, 3])).tolist() == [3, 4, 5, 6, 7]
    assert C.gathered(pool, np.array([], np.int64), np.array([], np.int64)).tolist() == []
