"""Anchors do not depend on what else is in a slice."""

import numpy as np

from kmerloom.llm import recompression as R


def test_anchors_are_the_same_in_any_slice():
    draw = np.random.default_rng(5)
    for size in [50, 51, 52, 53, 55] * 8:
        text = draw.integers(1, 1 << 62, size).astype(np.uint64)
        other = draw.integers(1, 1 << 62, 400).astype(np.uint64)
        end = np.zeros(1, np.uint64)
        found = []
        for parts in ([text], [text, other]):
            hashes = np.concatenate([x for p in parts for x in (p, end)])
            barrier = np.zeros(len(hashes), bool)
            barrier[np.cumsum([len(p) + 1 for p in parts]) - 1] = True
            name, begin, count, offset = R.anchors(hashes, barrier)
            mine = begin < size
            found.append(list(zip(*(x[mine].tolist() for x in (name, begin, count, offset)))))
        assert found[0] == found[1]
