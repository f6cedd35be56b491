"""The quality classifier: brute force, junk in several scripts, rows without ids."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from helixlake.llm import quality

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def sentences(r, n):
    who, does, what = ["the old man", "my little sister", "a tired doctor", "our new teacher"], ["never reads", "often buys", "slowly paints", "quietly sells"], ["green apples", "long letters", "small houses", "wooden boats"]
    return " ".join(f"{r.choice(who)} {r.choice(does)} {r.choice(what)}." for _ in range(n))


def brute(texts, order=4):
    """Interpolated modified Kneser-Ney over code points: a function (gram, without what occurs once) -> probability."""
    counts = {order: Counter()}
    times = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = "\n" * (order - 1) + t
        counts[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    times[order] = counts[order]
    for k in range(order - 1, 0, -1):
        for g, n in times[k + 1].items():
            times[k][g[1:]] += n
    total, cut, met, discount = {}, {}, {}, {}
    for k in counts:
        n = Counter(counts[k].values())
        y = n[1] / max(1, n[1] + 2 * n[2])
        discount[k] = [0] + [max(0.05, min(i * 0.95, i - (i + 1) * y * n[i + 1] / max(1, n[i]))) for i in (1, 2, 3)]
        total[k], cut[k], met[k] = Counter(), Counter(), Counter()
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            cut[k][g[:-1]] += discount[k][min(c, 3)]
            met[k][g[:-1]] += times[k][g]

    def full(g):  # the probability of a gram that has been counted
        if not g:
            return 1 / (len(counts[1]) + 1)
        c, h, k = counts[len(g)][g], g[:-1], len(g)
        return (c - discount[k][min(c, 3)] + cut[k][h] * full(g[1:])) / total[k][h]

    once = lambda g: max(times[len(g)][g] if g else 9, met[len(g) + 1][g] if len(g) < order else 0) == 1

    def prob(g, without):
        if not g:
            return full(g)
        k, h = len(g), g[:-1]
        if counts[k][g] and not (without and once(g)):
            return full(g)
        known = total[k][h] and not (without and k > 1 and once(h))
        return (cut[k][h] / total[k][h] if known else 1.0) * prob(g[1:], without)

    return prob


def test_scores_equal_brute_force(spark):
    texts = ["the cat sat on the mat", "the cat ran", "a dog sat on a log", "the cat sat", "a zebra ran", "caf\u00e9 \U0001f600 \u4eca\u5929\u5929", "q", "", " \n", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(90, "the cat", "xx")], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)], LABELS)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got[90].perplexity is None and got[90].threshold is None and got[90].kept
    prob = brute(texts[:4])
    assert sum(prob("cat"[-2:] + c, False) for c in {c for t in texts[:4] for c in t}) == pytest.approx(1 - prob("at\u4e00", False), abs=1e-9)
    for i, t in enumerate(texts):
        if not t:
            assert got[i].perplexity is None and not got[i].kept
            continue
        padded = "\n\n\n" + t
        logp = sum(math.log(prob(padded[k : k + 4], i < 4)) for k in range(len(t)))
        assert got[i].perplexity == pytest.approx(math.exp(-logp / len(t)), rel=1e-4), t


def test_distinct_grams(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("ab c\u00e9\u6f22\U0001f600\n") for _ in range(r.randrange(40))) for _ in range(30)]
    want = [("\n\n\n" + t)[k : k + 4] for t in texts for k in range(len(t))]
    for dense in (1 << 25, 8):
        monkeypatch.setattr(quality, "_DENSE", dense)
        grams, now = quality.distinct_grams("".join(texts), np.array([len(t) for t in texts]))
        strings = ["".join(map(chr, g)) for g in grams]
        assert [strings[k] for k in now] == want and len(set(strings)) == len(strings)
    assert quality.distinct_grams("", np.array([0, 0]))[0].shape == (0, 4)


def test_word_salad_and_scrambled_scripts_read_worse(spark):
    r = random.Random(3)
    good = [sentences(r, 12) for _ in range(60)]
    salad = [" ".join(r.sample(t.split(), len(t.split()))) for t in good[:15]]
    cjk = ["".join(r.choice(["今天天气很好。", "我们一起去学校。", "他在家里看书。", "明天可能会下雨。"]) for _ in range(12)) for _ in range(60)]
    mixed = ["".join(r.sample(t, len(t))) for t in cjk[:15]]
    rows = [(t, lang) for part, lang in ((good, "en"), (cjk, "zh"), (salad, "en"), (mixed, "zh")) for t in part]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], LABELS)
    got = {row.doc_id: row.kept for row in quality.classify(docs, labels).collect()}
    assert sum(got[i] for i in range(120)) >= 115
    assert not any(got[i] for i in range(120, 150))


def test_tables_grow_with_the_text(spark):
    r = random.Random(1)
    word = lambda: "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(9))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(50)), "zh") for i in range(40)], SCHEMA)
    sizes = [quality.kneser_ney(quality.gram_counts(docs.filter(f"doc_id < {n}"))).count() for n in (20, 40)]
    assert sizes[1] > 1.9 * sizes[0]


def test_null_and_repeated_ids_are_judged_by_row(spark):
    r = random.Random(2)
    good = sentences(r, 12)
    junk = "".join(r.choice("xqzjkv#%&") for _ in range(400))
    docs = spark.createDataFrame([(i, sentences(r, 12), "en") for i in range(30)] + [(None, good, "en"), (None, junk, "en"), (100, good, None), (101, good, "en"), (101, junk, "en"), (101, good, "en")], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    rest = [(x.doc_id, x.text == good) for x in quality.keep_good(docs, labels).collect() if x.doc_id is None or x.doc_id >= 100]
    assert sorted(rest, key=str) == sorted([(None, True), (100, True), (101, True), (101, True)], key=str)


def test_hashes_are_spread():
    grams = np.random.default_rng(1).integers(32, 0x3000, (200_000, 4)).astype(np.uint32)
    assert len(np.unique(quality.gram_keys("en", grams))) == len(np.unique(grams, axis=0))
    assert not set(quality.gram_keys("en", grams[:100]).tolist()) & set(quality.gram_keys("de", grams[:100]).tolist())
    assert not set(quality.gram_keys("en", grams[:100, :3]).tolist()) & set(quality.gram_keys("en", grams[:100]).tolist())
