"""Near duplicates: large groups, tiles, repeated and missing ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.llm import jaccard_join as J
from tests.llm.test_llm import SCHEMA, brute, docs_of, empty  # noqa: F401


def _copies(r, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for k in r.integers(0, len(base), r.integers(0, most)):
            w[k] = f"x{r.integers(0, 100_000)}"
        out.append(" ".join(w))
    return out


def _texts(seed, n=150):
    r = np.random.default_rng(seed)
    one, two = ([f"{c}{i}" for i in range(90)] for c in "pq")
    chain = [f"c{i}" for i in range(60 + n)]
    texts = _copies(r, one, n, 8) + _copies(r, one[:60] + two[:30], n, 4) + _copies(r, two, 20, 6)
    texts += [" ".join(chain[i : i + 60]) for i in range(n)]  # each links with its neighbours alone
    return [texts[i] for i in r.permutation(len(texts))] + [None, "", "a b", "A B", texts[0], texts[0]]


@pytest.mark.parametrize("tiles", [False, True])
def test_groups_with_unlinked_members_equal_brute_force(spark, monkeypatch, tiles):
    if tiles:  # families and buckets in many cells
        monkeypatch.setattr(J, "TILE", 1500)
        monkeypatch.setattr(J, "ROWS", 7)
    texts = _texts(3 + tiles)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs_of(spark, texts), width=4, percent=85).collect()}
    assert got == brute(texts, 4, 85)


def test_repeated_and_missing_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    data = [(5, base), (5, base + " end"), (5, "other words here that link with none"), (None, base), (None, ""), (None, "left alone with no id at all"), (3, base + " more"), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, *["x"] * 10) for i, t in data], SCHEMA.replace("n_chars long", "n_chars string"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 36, 3), (5, 37, 3), (5, 3, 5), (None, 36, 3), (None, 0, None), (None, 3, None), (3, 37, 3), (9, 0, 9), (9, 0, 9)], key=repr)
    stay = J.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in stay.collect()]
    assert (3, base + " more") in kept and (5, data[2][1]) in kept and (None, data[5][1]) in kept and len(kept) == 6  # texts without words are not linked
    assert sum(t and t.startswith("w0 ") or False for _, t in kept) == 1


def test_drop_near_duplicates(spark, empty):  # noqa: F811
    texts = _texts(8, 40)
    want = {i for i, (_, c) in brute(texts, 5, 80).items() if i == c}
    docs = docs_of(spark, texts)
    got = J.drop_near_duplicates(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want
    assert J.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("split", [0, 37])
def test_signature_trees_lose_no_pair(split):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 400, r.integers(20, 120))) for _ in range(70)]
    sets += [np.unique(np.concatenate([s[:-2], [999]])) for s in sets[:30]]
    maps = np.stack([J.bitmap(s.astype(np.uint64), 256) for s in sets])
    n, own = np.array([len(s) for s in sets]), np.arange(len(sets))
    one, two = J.SignatureTree(n[split:], maps[split:], own[split:], own[split:]), J.SignatureTree(n[:split], maps[:split], own[:split], own[:split]) if split else None
    found = {tuple(sorted((a, b))) for i, j in one.pairs(two or one, 85) for a, b in zip((i + split).tolist(), (j if split else j + split).tolist(), strict=True)}
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if not split or i < split <= j]
    want = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want and want <= found
    none = np.zeros(len(sets), int)
    assert not list(J.SignatureTree(n, maps, own, none).pairs(J.SignatureTree(n, maps, own, none), 85)) if split else True


def test_cell_links_join_what_is_linked():
    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 1 << 40, 200).astype(np.uint64))
    sets = [base] + [np.unique(np.concatenate([base[r.random(len(base)) < p], r.integers(0, 1 << 40, 9).astype(np.uint64)])) for p in r.uniform(0.75, 1, 80)]
    links = J.cell_links(sets, np.zeros(len(sets), int), 85)
    assert len(links) < len(sets)

    def groups(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            root = [root[a] if x == root[b] else x for x in root]
        return {frozenset(i for i, x in enumerate(root) if x == y) for y in root}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if J.linked(sets[i], sets[j], 85)]
    assert groups(links) == groups(every) and 1 < len(groups(every)) < len(sets)
