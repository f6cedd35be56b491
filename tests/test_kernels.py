from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.functions import kernels as K

RNG = np.random.default_rng(3)


def test_basis_is_orthonormal():
    for n in (1, 2, 7, 34):
        b = K.cosine_basis(n)
        assert np.allclose(b @ b.T, np.eye(n))


def test_spectrum_keeps_energy():
    x = RNG.normal(size=(34, 6))
    assert np.isclose(((K.cosine_basis(34) @ x) ** 2).sum(), (x**2).sum())


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 60), st.integers(2, 6))
def test_pair_blocks_count_every_pair(rows, width, letters):
    codes = np.random.default_rng(rows * width).integers(-1, letters, (rows, width)).astype(np.int8)
    got = {}
    for i, j, a, b, n in K.pair_blocks(codes, letters, block=7):
        for key in zip(i.tolist(), j.tolist(), a.tolist(), b.tolist(), n.tolist(), strict=True):
            assert key[:4] not in got
            got[key[:4]] = key[4]
    want = {}
    for r in codes:
        for i in range(width):
            for j in range(i + 1, width):
                if r[i] >= 0 and r[j] >= 0:
                    k = (i, j, int(r[i]), int(r[j]))
                    want[k] = want.get(k, 0) + 1
    assert got == want


def test_average_linkage_finds_two_groups():
    points = np.array([0, 0.1, 0.2, 5, 5.1, 0.15])
    groups = K.average_linkage_split(abs(points[:, None] - points[None]))
    assert groups.tolist() == [0, 0, 0, 1, 1, 0]


def _planted(n_main=6, n_iso=2, dim=16):
    main, iso = np.zeros(dim), np.zeros(dim)
    main[0], iso[1] = 1, 1
    v = np.array([iso if h < n_iso else main for h in range(n_main + n_iso)]) + RNG.normal(size=(n_main + n_iso, dim)) * 0.01
    return v


def test_split_heads_finds_the_planted_group():
    found = K.split_heads(_planted()[None])[0]
    assert found[0].tolist() == [0, 1] and abs(found[2]) < 0.05


def test_split_heads_needs_four_heads_and_size():
    assert K.split_heads(_planted(2, 1)[None]) == [None]
    assert K.split_heads(_planted()[None] * 0.2) == [None]


def test_anchor_split_finds_the_planted_head():
    size, cos, split = K.anchor_split(_planted(18, 1))
    assert split[0] == 0 and split[1].tolist() == [0] and len(split[2]) == 18
    assert K.anchor_split(np.zeros((4, 3))) is None


def test_consistent_core():
    groups = [({0, 1}, {2, 3, 4, 5}), ({0, 1}, {2, 3, 4, 5}), ({0, 1, 5}, {2, 3, 4}), ({2, 3}, {0, 1, 4, 5})]
    core, consistency = K.consistent_core(groups)
    assert core == [0, 1] and consistency == 1.0
    assert K.consistent_core(groups[:2]) is None


def test_best_of_rows_keeps_ties():
    r, c = K.best_of_rows(np.array([[3.0, 1.0, 3.0, 2.0], [0.0, 0.0, 0.0, 0.0]]), 1)
    assert list(zip(r.tolist(), c.tolist(), strict=True)) == [(0, 0), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3)]
    assert len(K.best_of_rows(np.zeros((2, 3)), 9)[0]) == 6


def test_fast_cosine_transform():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 33):
        x = rng.normal(size=(4, n, 5))
        assert np.allclose(K.cosine_transform(x), np.einsum("kn,snd->skd", K.cosine_basis(n), x))


def test_stacked_linkage_equals_one_by_one():
    """Small whole distances, so that ties abound; groups of several sizes in one stack."""
    rng = np.random.default_rng(7)
    d = rng.integers(1, 5, (200, 9, 9)).astype(float)
    d = np.minimum(d, d.transpose(0, 2, 1))
    alive = rng.random((200, 9)) < 0.7
    got = K.average_linkage_splits(d, alive)
    for g in range(200):
        live = np.flatnonzero(alive[g])
        assert (got[g][~alive[g]] == -1).all()
        if len(live) > 1:
            assert got[g][live].tolist() == K.average_linkage_split(d[g][np.ix_(live, live)]).tolist()


def test_pair_tables_count_one_or_four_pairs_at_once():
    rng = np.random.default_rng(1)
    for width in (0, 1, 2, 5, 6):
        for size in (0, 7, 90):
            grid = rng.integers(0, 4, (width, size)).astype(np.uint8)
            got = {(i, j): n for i, j, n in K.pair_tables(grid, 3)}
            assert sorted(got) == [(i, j) for i in range(width) for j in range(i + 1, width)]
            for (i, j), n in got.items():
                assert all(n[a, b] == ((grid[i] == a + 1) & (grid[j] == b + 1)).sum() for a in range(3) for b in range(3))


def test_repeated_pairs_count_every_meeting():
    rng = np.random.default_rng(2)
    seq, pos, letter = rng.integers(9, size=120), rng.integers(6, size=120), rng.integers(3, size=120)
    all_ = list(zip(seq.tolist(), pos.tolist(), letter.tolist(), strict=True))
    want = Counter((x[1], y[1], x[2], y[2]) for x in all_ for y in all_ if x[0] == y[0] and x[1] < y[1])
    for most in (1, 10, 1 << 22):
        got = Counter()
        for part in K.repeated_pairs(seq, pos, letter, 3, most):
            for i, j, a, b, n in zip(*(x.tolist() for x in part), strict=True):
                got[i, j, a, b] += n
        assert got == want
