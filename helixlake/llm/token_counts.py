"""Numbers of tokens of whole texts.

An Arrow function gets the texts and returns lengths only; every other column stays in the
JVM.  Texts of a batch are cut where no token of the vocabulary can reach across, the cuts are
dealt into parts of about the same number of bytes, whatever the texts' lengths, and a
part's new pieces are encoded by the library in one call.  A text longer than a part spans
several; its counts are added up, so no task holds more than a part's pieces at a time.

Cuts are safe where no piece of the vocabulary holds the mark of a space behind another
character (before a run of spaces) or a line break at all (before a break), the text isn't
rewritten before it is encoded, and an unknown character is counted by its bytes, never
joined to the next.  ``safe_to_cut`` reads that from the model; where it doesn't hold, whole
texts are encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import keep_cache, table, text_or_empty
from helixlake.llm.encoding import encoder

MARK = "▁"
_PIECE = re.compile(" +[^ \n]*|\n[^ \n]*")
_CUT = re.compile("(?<=[^ ])(?= )|(?=\n)")


def safe_to_cut(model) -> bool:
    """Whether texts may be cut before runs of spaces and before line breaks (``model``: the parsed model file)."""
    rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
    own = kinds - {1, 2, 3, 6}  # normal, unknown, control, byte; a user's piece could hold anything
    inner = any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in model.pieces)
    alone = any(p.piece == MARK for p in model.pieces)
    return plain and not own and not inner and alone and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix


class PieceCounter:
    """Counts tokens of a sentencepiece model; keeps the counts of ``most`` short pieces."""

    def __init__(self, file: str, most: int = 1_000_000, short: int = 64):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.processor = SentencePieceProcessor(model_file=file)
        model = ModelProto()
        model.ParseFromString(self.processor.serialized_model_proto())
        self.cuts, self.most, self.short, self.known = safe_to_cut(model), most, short, {}

    def _lengths(self, texts: list[str]) -> Iterator[int]:
        return map(len, self.processor.encode(texts, num_threads=1))

    def _learn(self, pieces: set[str]) -> None:
        """The library puts a space before each text: it stands for the one that a piece begins with, and is taken off before a break."""
        new = [p for p in pieces if p not in self.known]
        breaks = np.fromiter((p[0] == "\n" for p in new), bool, len(new))
        counts = np.fromiter(self._lengths([p.removeprefix(" ") for p in new]), np.int64, len(new)) - breaks
        self.known.update(zip(new, counts.tolist(), strict=True))
        self.known[" "] = 1

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each of the ``texts``, a part of a batch."""
        if not self.cuts:
            return np.fromiter(self._lengths(texts), np.int64, len(texts))
        split = [_PIECE.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        return self.pieces(split)

    def pieces(self, split: list[list[str]]) -> np.ndarray:
        """Sum of the counts of each list of pieces."""
        flat = list(chain.from_iterable(split))
        if len(self.known) > self.most:
            self.known = {}
        self._learn(set(flat))
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)))])
        for p in {p for p in flat if len(p) > self.short}:
            del self.known[p]
        ends = np.cumsum([len(p) for p in split])
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0, np.int64)

    def long(self, text: str, size: int) -> int:
        """Tokens of one long text, a stretch of about ``size`` characters at a time."""
        if not self.cuts or not text:
            return int(self.counts([text])[0])
        text, total, at = " " + text.replace(MARK, " "), 0, 0
        while at < len(text):
            cut = _CUT.search(text, min(at + size, len(text)))
            end = cut.start() if cut and cut.start() > at else len(text)
            total += int(self.pieces([_PIECE.findall(text, at, end)])[0])
            at = end
        return total


class WordCounter:
    """The same for a vocabulary file of the tokenizers library."""

    def __init__(self, file: str, drops_space: bool):
        self.file, self.drops_space = file, drops_space

    def counts(self, texts: list[str]) -> np.ndarray:
        return encoder(self.file, self.drops_space).batch(texts, 0)[1] - 1

    def long(self, text: str, size: int) -> int:
        return int(self.counts([text])[0])


_counters: dict = {}


def counter(file: str, drops_space: bool = False):
    """The worker's counter of a vocabulary: sentencepiece for .model files, tokenizers for .json."""
    if file.endswith(".json"):
        return WordCounter(file, drops_space)
    keep_cache("counters", _counters.clear)
    if file not in _counters:
        _counters[file] = PieceCounter(file)
    return _counters[file]


def balanced(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes; a longer row has a range to itself."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and held + n > most:
            out.append((begin, i))
            begin, held = i, 0
        held += n
    return [*out, (begin, len(sizes))] if begin < len(sizes) else out


def token_count(text: Column, vocabulary: str, part_bytes: int = 1 << 20, drops_space: bool = False) -> Column:
    """Number of tokens of a text column by the library of the ``vocabulary`` file, without any added token.

    Null counts as empty: 0.  Strings of special tokens are what the library takes them for.
    """

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.binary_length(batch).to_numpy(zero_copy_only=False)
            out = np.zeros(len(batch), np.int64)
            count = counter(vocabulary, drops_space)
            for begin, end in balanced(sizes, part_bytes):
                texts = batch.slice(begin, end - begin).to_pylist()
                if end - begin == 1 and sizes[begin] > part_bytes:
                    out[begin] = count.long(texts[0], part_bytes)
                else:
                    out[begin:end] = count.counts(texts)
            yield pa.array(out)

    return lengths(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, text: str = "text", part_bytes: int = 1 << 20, drops_space: bool = False) -> DataFrame:
    """Adds n_bytes (of the UTF-8), n_tokens and over_limit (n_tokens > ``limit``) to ``docs``, in place of columns of these names.

    A row is counted by itself, so null or repeated ids and repeated rows do no harm.  Null or
    empty texts have 0 bytes and 0 tokens.  No rows in, no rows out.
    """
    columns = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    n_bytes = F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes")
    counted = docs.select(*[F.col(f"`{c}`") for c in columns], n_bytes, token_count(F.col(text), vocabulary, part_bytes, drops_space).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLE: dict[str, str] = {}
