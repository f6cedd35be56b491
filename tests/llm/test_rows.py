"""Stages of the pipeline and repeated or missing ids, columns with inner names, empty tables."""

import hashlib

import public_tokenizers
import pytest

from helixlake.llm import exact_dedup, line_dedup, media, mixing, packing, secret_scan, token_files

NAMES = ("row", "doc", "copy", "copies", "hash", "bucket", "lines", "drop", "hashes", "_row", "_cell", "threshold", "kept_text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, *NAMES) for i, t, s in rows], SCHEMA)


ROWS = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "other words", "y"), (None, "no id", None), (None, None, None), (None, "no id", "x"), (7, "", "y"), (8, None, "y")] + [(100 + i, f"w{i} " * 30, "xyz"[i % 3]) for i in range(30)]


def test_mixing_knows_rows(spark):
    docs = frame(spark, ROWS)
    got = mixing.repeat_by_mix(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in NAMES)
    often = lambda i, t: sum(r.doc_id == i and r.text == t for r in rows)
    assert often(None, None) == often(7, "") == often(8, None) == 1
    assert sum(len((r.text or "").split()) for r in rows) == pytest.approx(sum(len((t or "").split()) for _, t, _ in ROWS), rel=0.35)
    assert sorted(map(str, mixing.repeat_by_mix(docs).collect())) == sorted(map(str, rows))
    assert mixing.repeat_by_mix(docs.filter("false")).count() == 0


def test_exact_dedup_and_lines_keep_columns(spark):
    docs = frame(spark, ROWS)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.text or "") for r in rows) == sorted({t or "" for _, t, _ in ROWS}) and all(r[c] == c for r in rows for c in NAMES)
    lines = line_dedup.drop_common_lines(docs, min_docs=2)
    assert lines.columns == [c for c in docs.columns if c != "kept_text"] + ["n_lines", "n_dropped", "kept_text"]
    found = {(r.doc_id, r.text): (r.n_dropped, r.kept_text) for r in lines.collect()}
    assert found[1, "a b c"] == (1, "") and found[1, "other words"] == (0, "other words") and found[None, None] == (0, "")


def test_slots_come_from_quotas(spark):
    docs = frame(spark, ROWS)
    taken, slots = mixing.mix_sources(docs, block_words=4, shard_slots=5)
    by = {}
    for r in slots.collect():
        by.setdefault(r.source_no, []).append(r)
    for mine in by.values():
        numbers = sorted(r.slot for r in mine)
        assert len(set(numbers)) == len(numbers)
        for shard in {r.shard for r in mine}:
            own = sorted(r.slot for r in mine if r.shard == shard)
            assert own[-1] - own[0] < len(mine) + 5
    total = {r.source_no: sum(x.words for x in by[r.source_no]) for rows in by.values() for r in rows}
    assert sum(total.values()) == sum(r.taken for r in taken.collect())


NULL_IDS = [(None, "one a", "x"), (None, None, None), (None, "one a", "x")]


def test_null_and_repeated_ids_of_rows_by_themselves(spark):
    """Also with no id in a whole batch."""
    for rows in (ROWS, NULL_IDS):
        docs = frame(spark, rows).coalesce(1)
        want = sorted((str(i), hashlib.sha256((t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 192)) * 192, b" ")).hexdigest()) for i, t, _ in rows)
        assert sorted((str(r.doc_id), r.payload_sha256) for r in media.media_columns(docs).collect()) == want
        assert sorted(str(r.doc_id) for r in secret_scan.find_secrets(docs).collect()) == sorted(str(i) for i, _, _ in rows)
        packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=64).collect()
        assert sorted(str(r.doc_id) for r in packed if r.start == 0) == sorted(str(i) for i, _, _ in rows)


def test_token_files_put_rows_without_ids_first(spark, tmp_path):
    manifest = token_files.write_token_files(frame(spark, ROWS), f"file://{tmp_path}/x", public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in ROWS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sum(r.doc_id == 1 for r in got) == 3
