"""Words and shingles of whole columns: the same for chunks of any size, however many texts and however long ones a chunk has."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import common, jaccard_join


def texts(rng, n, most):
    return [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("n, most", [(200, 30), (70_000, 2), (3, 200_000)])
def test_sets_are_sorted_and_those_of_single_texts(n, most):
    """sorted without comparing texts, with powers that chunks share; longer texts and more texts than short numbers have too."""
    made = texts(random.Random(n), n, most)
    assert max(map(len, made)) > (common.MOST if most > 1000 else 0)
    held = {}
    for lo, first, hashes in jaccard_join.shingle_sets(pa.array(made), 5):
        for i in range(len(first) - 1):
            held[lo + i] = hashes[first[i] : first[i + 1]]
    assert sorted(held) == list(range(n))
    for i in random.Random(1).sample(range(n), min(n, 60)):
        assert (np.diff(held[i].astype(object)) > 0).all()
        (_, first, alone), *_ = jaccard_join.shingle_sets(pa.array([made[i]]), 5)
        w = made[i].split()
        assert held[i].tolist() == alone.tolist() and len(alone) == (len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))
