"""Roots and proofs against a plain tree in memory."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from helixlake.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, hash string, `rank` string, size string, path string, nodes string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, fan):
    """(root, siblings of each node: per level those before and behind it)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = place // fan * fan
            paths[k].append((nodes[run:place], nodes[place + 1 : run + fan]))
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        at = [p // fan for p in at]
    return nodes[0], paths


def folded(node, path):
    for before, after in path:
        node = sha("".join([*before, node, *after]))
    return node


def brute(rows, fan=8):
    """All result rows of rows (doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for i, t, lang, source, n in rows:
        by[lang].append((i is not None, i or 0, leaf(i, source, lang, n, t), (i, t, source, n)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [climb([r[2] for r in sorted(by[x], key=lambda r: r[:3])], fan) for x in langs]
    root, tops = climb([t[0] for t in trees], fan)
    out = []
    for lang, (subroot, paths), top in zip(langs, trees, tops, strict=True):
        for (_, _, h, (i, t, source, n)), path in zip(sorted(by[lang], key=lambda r: r[:3]), paths, strict=True):
            whole = path + top
            changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
            low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            got = folded(leaf(i, source, lang, n, low) if changed else h, whole)
            out.append((i, h, subroot, root, sha("".join("".join(a + b) for a, b in whole)), got, got == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", "r", "s", "p", "n") for r in rows], SCHEMA)


@pytest.fixture
def answer(spark, tmp_path):
    def run(rows):
        frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return M.op11_merkle_manifest(spark, str(tmp_path)).collect()

    return run


def case(counts):
    """Rows of groups of the given sizes, mixed, every third one with capitals."""
    return [(1000 * g + k, ("Some Text" if k % 3 else "plain") + f" {k} é", lang, None if k % 5 == 0 else "src", k) for g, (lang, n) in enumerate(counts.items()) for k in range(n)]


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 8, "de": 9, None: 1}, {"en": 1200, "é": 65, "": 64, "z": 3, None: 17, **{f"l{i}": i for i in range(1, 10)}}])
def test_against_brute_force(answer, counts):
    rows = case(counts)
    assert Counter(map(tuple, answer(rows))) == Counter(brute(rows))


def test_many_stored_levels(answer, monkeypatch):
    """Narrow trees, so that several levels are stored."""
    for name, value in {"FAN": 2, "BLOCK": 8}.items():
        monkeypatch.setattr(M, name, value)
    rows = case({"en": 150, "de": 64, "fr": 2, None: 1, **{f"l{i}": 1 for i in range(20)}})
    assert Counter(map(tuple, answer(rows))) == Counter(brute(rows, fan=2))


def test_repeated_and_missing(answer):
    same = (3, "Same", "en", None, None)
    rows = [same, same, same, (3, None, "en", "x", 1), (None, "A", "en", None, None), (None, None, None, None, None), (None, None, None, None, None), (5, "", "en", "x", 0), (6, "LONG word " * 200_000, "en", "x", 9)]
    assert Counter(map(tuple, answer(rows))) == Counter(brute(rows))


def test_empty(spark, answer):
    assert answer([]) == []
    manifest = M.build_manifest(M.document_leaves(frame(spark, [])), "lang", "doc_id")
    assert manifest.root() is None


def test_only_tampered_rows_fail(spark, sf):
    for r in M.op11_merkle_manifest(spark, sf).collect():
        assert r.verified or zlib.crc32(str(r.doc_id).encode()) % 3 == 0
