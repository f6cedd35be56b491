"""Padding of packed sequences on short, equal and mixed pieces."""

import numpy as np
import pytest

from helixlake.llm import packing as P


def _plan(lengths, capacity=4096, bins=256):
    """(sequences, share of padding) by the same steps as ``pack``, without Spark."""
    unit = -(-capacity // bins)
    values, counts = np.unique(lengths, return_counts=True)
    by = {}
    for n, k in zip(values.tolist(), counts.tolist(), strict=True):
        c = n if n <= 8 * unit else -(-(-n // unit))
        by[c] = by.get(c, 0) + k
    _, held = P.item_ranks(by, unit, 8 * unit, max(8 * unit, capacity // 8))
    demand = np.array([held.get(b, 0) for b in range(1, bins + 1)], float)
    n = sum(k for _, k in P.rounded(demand, P.column_generation(demand)))
    return n, 1 - lengths.sum() / (n * capacity)


@pytest.mark.parametrize("length", [1, 2, 3, 13, 17, 31, 57, 64, 100, 127])
def test_equal_short_pieces(length):
    assert _plan(np.full(300_000, length))[1] < 0.05


def test_mixed_pieces():
    rng = np.random.default_rng(0)
    for mean in (2, 3, 4, 5):
        lengths = np.clip(rng.lognormal(mean, 1, 40_000).astype(int) + 1, 1, 4096)
        assert _plan(lengths)[1] < 0.05


def test_bundles():
    assert [P.bundle_size(n, 16, 512) for n in (1, 2, 3, 8, 16, 24)] == [16, 8, 16, 2, 1, 2]
    items, held = P.item_ranks({1: 35, 16: 4, -9: 2}, 16, 128, 512)
    assert items == {-9: (0, 1, 9, 0, 9, 0), 1: (32, 16, 1, 0, 1, 2), 16: (0, 1, 1, 5, 1, 5)} and held == {9: 2, 1: 9}


@pytest.mark.parametrize("rows", [20_000, 37])
def test_short_documents(spark, rows):
    """Two tokens each, packed by Spark: every piece once, without gaps or overflow."""
    pieces = spark.range(rows).selectExpr("id AS row", "id AS doc_id", "0L AS start", "2L AS length")
    got = P.pack(pieces).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.row))
    assert sorted(r.row for r in got) == list(range(rows))
    assert all(sorted(o for o, _ in x) == list(range(0, 2 * len(x), 2)) and len(x) <= 2048 for x in by.values())
    assert rows < 100 or 1 - 2 * rows / (4096 * len(by)) < 0.05
