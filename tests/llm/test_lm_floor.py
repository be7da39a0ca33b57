"""Probabilities of rare successors of very common words."""

import numpy as np
import pytest

from satchel.llm import op04_lm


def test_common_contexts(spark):
    """A word seen 4e8 times, with successors seen once, 9 and 3e8 times, and one not seen in training."""
    total, counts = 400_000_000, [1, 9, 300_000_000, 0]
    data = [op04_lm.pack(np.array([5]), np.array([4]), np.array([total]), np.arange(4), np.array(c)) for c in (counts, [0, 0, 0, 0])]
    blobs = spark.createDataFrame([(0, 7 + i, op04_lm._GRAMS, bytearray(x)) for i, x in enumerate(data)], op04_lm._BLOB)
    answers = {r.target: op04_lm.unpack(bytes(r.data)) for r in op04_lm._look_up(blobs, 2).collect()}
    elsewhere, codes, gaps = answers[8]
    assert elsewhere.tolist() == counts and gaps.tolist() == [1, 1, 1] and not answers[7][0].any()
    got = op04_lm.unquantised(codes)
    share = float(op04_lm.context_weight(np.array([total]))[0])
    want = [(1 - share) * c / total for c in counts]
    assert got == pytest.approx(want[:3], rel=10 ** (0.5 / op04_lm.STEPS) - 1 + 1e-9)
