"""Token counts against the plain library on whole texts."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixlake.llm import token_counts as T
from helixlake.llm.common import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = [
    None, "", " ", "  ", "\n", " \n", "\n ", "\n\n  x", "a b", " a  b ", "a▁b", "▁", "a ▁ b", "<s> </s><unk>", "漢字 ☃☃\n☃", "x\x00y", "a\tb\r\nc", "café ﬁ",
    "word " * 3000 + "\n" * 50 + "end", "x" * 5000, "  ".join(["ab"] * 3000),
]


def plain(t):
    return len(PLAIN.encode(t or ""))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t▁ab1.<s>/é漢\U0001f600", max_size=60), st.integers(1, 9))
def test_cuts_are_safe(text, size):
    counter = T.counter(MODEL)
    assert counter.cuts
    assert counter.counts([text, "", text])[2] == plain(text) == counter.long(text, size)


def test_counts(spark):
    data = [(i, t, "n", "b", "o") for i, t in enumerate(ODD)] + [(None, "no id", "", "", None), (3, "twice", None, "", ""), (3, "twice", None, "", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens string, n_bytes string, `a.b` string")
    for size in (16, 1 << 20):
        got = T.count_tokens(docs, MODEL, limit=100, part_bytes=size)
        assert got.columns == ["doc_id", "text", "a.b", "n_bytes", "n_tokens", "over_limit"]
        rows = got.collect()
        assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted((str(d[0]), d[1] or "") for d in data)
        for r in rows:
            n = plain(r.text)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 100)
    assert T.count_tokens(docs.filter("false"), MODEL).count() == 0


def test_other_libraries(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in T.count_tokens(docs, file).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)


def test_unsafe_models_encode_whole_texts():
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = ModelProto()
    model.ParseFromString(PLAIN.serialized_model_proto())
    assert T.safe_to_cut(model)
    model.pieces.add(piece="of▁the", score=-1.0, type=1)
    assert not T.safe_to_cut(model)
    whole = T.PieceCounter(MODEL)
    whole.cuts = False
    assert whole.counts(["a b\nc", ""]).tolist() == [plain("a b\nc"), 0] and whole.long("a b\nc", 1) == plain("a b\nc")


def test_whole_table(spark, sf):
    got = {r.doc_id: r for r in T.op13_token_counts(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert (got[i].n_tokens, got[i].n_bytes) == (plain(t), len((t or "").encode()))


@pytest.mark.parametrize(("sizes", "want"), [([], []), ([5], [(0, 1)]), ([1, 1, 9, 1], [(0, 2), (2, 3), (3, 4)]), ([0, 0, 3, 3], [(0, 3), (3, 4)])])
def test_balanced(sizes, want):
    import numpy as np

    assert T.balanced(np.array(sizes), 3) == want
