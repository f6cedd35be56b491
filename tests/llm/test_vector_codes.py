"""Product codes against a full comparison in every round."""

import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label string, ints string, code string, part string, error string"


def brute(rows, parts, entries, rounds, scale=256):
    """Per kept row (vec_id, label) -> (code, error), and the codebooks; plain loops over rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, now, strict=True) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, label, bytes(k for _, k in a), sum(d for d, _ in a)) for (i, _, label), a in zip(kept, assign(), strict=True)], books


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_renew_is_a_full_comparison(data):
    """Small integers, so that ties abound."""
    whole = lambda n: np.array(data.draw(st.lists(st.lists(st.integers(-2, 2), min_size=2, max_size=2), min_size=n, max_size=n)), np.int64)
    x, old, fresh = whole(12), whole(5), whole(5)
    flags = np.array(data.draw(st.lists(st.booleans(), min_size=5, max_size=5)))
    new = np.where(flags[:, None], fresh, old)
    code, far = V.nearest(x, old)
    got, d, work = V.renew(x, code, far, new, (new != old).any(1))
    want, best = V.nearest(x, new)
    assert got.tolist() == want.tolist() and d.tolist() == best.tolist()
    assert work <= len(x) * len(new)


def test_only_moved_entries_are_compared():
    x = np.arange(100)[:, None]
    old, new = np.array([[0], [50], [99]]), np.array([[0], [50], [98]])
    code, far = V.nearest(x, old)
    got, _, work = V.renew(x, code, far, new, np.array([False, False, True]))
    assert got.tolist() == V.nearest(x, new)[0].tolist() and work == int((code != 2).sum()) + 3 * int((code == 2).sum())
    assert V.renew(x, code, far, old, np.zeros(3, bool))[2] == 0


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "i", "c", "p", "e") for i, v, label in rows], SCHEMA)


def check(spark, rows, **kw):
    codes, books = V.compress_vectors(frame(spark, rows), **kw)
    want, want_books = brute(rows, kw["parts"], kw["entries"], kw["rounds"])
    got = V.with_label_error(codes).collect()
    assert books.tolist() == want_books
    assert Counter((r.vec_id, r.label, bytes(r.code), r.error) for r in got) == Counter(want)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert all(r.label_error == sums[r.label] for r in got)
    return codes, books


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.02, 8)], [None, "a", "b"][i % 3]) for i in rng.permutation(150)]
    rows += [(3, rows[0][1], "a"), (3, rows[0][1], "a"), (None, rows[1][1], None), (None, rows[2][1], "b")]
    rows += [(-5, None, "a"), (-4, [], "a"), (-3, [1.0, None] + [0.0] * 6, "a"), (-2, [math.nan] + [0.0] * 7, "a"), (-1, [math.inf] + [0.0] * 7, "b")]
    for rounds in (0, 1, 2, 5):
        codes, books = check(spark, rows, parts=4, entries=6, rounds=rounds)
    back = codes.withColumn("back", V.decoded(codes["code"], books)).collect()
    assert all(len(r.back) == 8 for r in back) and sum(abs(x) for x in back[0].back) < 1
    check(spark, rows[:4], parts=4, entries=64, rounds=2)  # fewer vectors than entries
    check(spark, [(i, [1.0, -0.5], "a") for i in range(300)], parts=2, entries=64, rounds=2)  # one vector, many times


def test_other_lengths_and_large_values(spark):
    rows = [(1, [1e30, -1e30], "a"), (2, [0.5, 0.25], "a"), (3, [1.0, 2.0, 3.0], "a"), (4, [1.0], "a")]
    codes, books = V.compress_vectors(frame(spark, rows), parts=2, entries=2, rounds=1)
    assert sorted(r.vec_id for r in codes.collect()) == [1, 2] and books[:, 0, 0].tolist() == [V.MOST, -V.MOST]


def test_empty(spark):
    codes, books = V.compress_vectors(frame(spark, []))
    assert V.with_label_error(codes).count() == 0 and books.size == 0
