"""Windows are ordered by name alone, and by name and check only where one name has two checks."""

import numpy as np

from transferlens.llm.window_doubling import _joined, _name_order


def test_order_by_name_then_check():
    names, checks = np.array([5, 1, 5, 1, 9], np.uint64), np.array([2, 7, 1, 7, 0], np.uint32)
    order = _name_order(names, checks)
    assert list(zip(names[order].tolist(), checks[order].tolist())) == [(1, 7), (1, 7), (5, 1), (5, 2), (9, 0)]
    assert sorted(_name_order(names, np.zeros(5, np.uint32)).tolist()) == [0, 1, 2, 3, 4]
    assert len(_name_order(names[:0], checks[:0])) == 0


def test_joining_leaves_its_inputs():
    a, b = np.arange(3, dtype=np.uint64), np.arange(3, 6, dtype=np.uint64)
    assert _joined(a, b).tolist() == _joined(a[:], b).tolist() and a.tolist() == [0, 1, 2] and b.tolist() == [3, 4, 5]
