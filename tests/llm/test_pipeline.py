"""The pipeline against a brute-force version of each stage, on its own input."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from helixlake.llm.common import stored
from tests.llm.test_llm import WORD, words
from tests.llm.test_llm import brute as brute_near
from tests.llm.test_quality import brute as brute_model
from tests.llm.test_quality import sentences


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    rows = []
    for i in range(60):
        t = sentences(r, 14)
        rows.append((i, t, "en", "abc"[i % 3] if i % 7 else None))
    near = rows[3][1].split()
    for k in range(8):
        rows.append((100 + k, " ".join(near[:-1] + [f"{near[k]}"]), "en", "a"))
    rows += [(200 + k, rows[5][1], "en", "b") for k in range(5)]
    rows += [(300 + k, "".join(r.choice("xqzjkv#%&") for _ in range(300)), "en", "c") for k in range(6)]
    rows += [(400, None, "en", "a"), (401, "", None, None), (402, "no model for this one", None, "c")]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(300, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = [docs]
    for name, stage in pipeline.STAGES:
        held.append(stored(stage(spark, held[-1], folder), name))
    assert all(d.columns == docs.columns for d in held[:-1])
    every, judged, exact, near, mixed, packed = [d.collect() for d in held]

    text = {x.doc_id: x.text for x in every}
    trusted = [i for i in sorted(text) if i < 40]
    prob = brute_model([text[i] for i in trusted])
    read = {}
    for i, t in text.items():
        padded = "\n\n\n" + (t or "")
        if t:
            read[i] = math.exp(-sum(math.log(prob(padded[k : k + 4], i in trusted)) for k in range(len(t))) / len(t))
    limit = 1.4 * sorted(read[i] for i in trusted)[math.ceil(0.9 * len(trusted)) - 1]
    lang = {x.doc_id: x.lang for x in every}
    assert {x.doc_id for x in judged} == {i for i, t in text.items() if t and (lang[i] is None or read[i] <= limit)}
    assert not any(300 <= x.doc_id < 400 for x in judged)

    assert {x.doc_id for x in exact} == {max(y.doc_id for y in judged if y.text == x.text) for x in judged}

    order = sorted(x.doc_id for x in exact)
    groups = brute_near([text[i] for i in order], 5, 80)
    assert {x.doc_id for x in near} == {order[i] for i, (_, c) in groups.items() if i == c} and len(near) < len(exact)

    times = Counter(x.doc_id for x in mixed)
    assert set(times) <= {x.doc_id for x in near} and max(times.values()) <= 3
    assert sum(len(words(x.text)) for x in mixed) == pytest.approx(sum(len(words(x.text)) for x in near), rel=0.15)

    tok = Tokenizer.from_file(WORD)
    pieces, by_sequence = defaultdict(list), defaultdict(list)
    for x in packed:
        pieces[x.row].append(x)
        by_sequence[x.sequence_id].append(x)
    assert Counter(mine[0].doc_id for mine in pieces.values()) == times
    for mine in pieces.values():
        ids = np.array([*tok.encode(text[mine[0].doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for x in sorted(mine, key=lambda x: x.start):
            assert x.start == at and x.ids_crc32 == zlib.crc32(ids[at : at + x.length].tobytes())
            at += x.length
        assert at == len(ids)
    for mine in by_sequence.values():
        at = 0
        for x in sorted(mine, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 4096
    assert sorted(map(str, pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(str(x) for x in held[-1].select("doc_id", "start", "length", "ids_crc32").collect())


def test_stages_take_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
