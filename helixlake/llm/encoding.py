"""Token ids of whole texts, by the tokenizers library, at the speed of a word list.

Both vocabularies split text at white space before any merge, so a text's ids are the
ids of its pieces in a row.  A piece is encoded by the library when a worker first meets
it, together with the other new pieces of a batch, and looked up afterwards; texts with
unusual white space, or with the string of one of the vocabulary's special tokens (which
the library gives that token's id), are encoded whole.
"""

from __future__ import annotations

import re
from itertools import chain, islice

import numpy as np

from helixlake.llm.common import keep_cache

#: White space, and characters some library counts as such, outside " \t\n\v\f\r"; and the mark used below.
_ODD = re.compile("[\x00\x01\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
#: A word with the one space before it, a lone break, a run of white space with the word behind it, a last space.
_WITH_SPACE = re.compile(" ?[^ \t-\r]+|[\t-\r](?![ \t-\r])|[ \t-\r]{2,}[^ \t-\r]*| ")
#: White space next to which pieces aren't cut at each space or break.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
_BARE = "\x01"
_SPACE_MARK = "\u0120"


def _words(text: str) -> list[str]:
    """Words by white space: all that matters where the vocabulary drops it."""
    return text.split()


def _pieces(text: str) -> list[str]:
    """Pieces where the vocabulary keeps white space.

    A word stands for itself with one space before it; one with the mark _BARE before it
    has none; "\\n" is a break.  Texts with longer runs of white space are cut by a pattern.
    """
    if text[:1] in ("", " ") or text[-1:] in (" ", "\n") or any(r in text for r in _RUNS):
        return [_BARE + p for p in _WITH_SPACE.findall(text)]
    return (_BARE + text).replace("\n", " \n " + _BARE).split(" ")


class _Numbers(dict):
    """Numbers pieces in the order in which they are first met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Encodes batches of texts; keeps about ``most`` pieces."""

    def __init__(self, file: str, drops_space: bool, most: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        # Their strings stand for themselves in a text, so it is encoded whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space, self.most = drops_space, most
        # Where the vocabulary keeps white space, a word's first token alone begins with its mark of a space.
        self.opens = np.zeros(0 if drops_space else self.tokenizer.get_vocab_size(), bool)
        if not drops_space:
            self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == _SPACE_MARK]] = True
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words without white space, encoded in one row."""
        row = " " + " ".join(words)
        if not self.drops_space:
            ids = np.array(self.tokenizer.encode_batch_fast([row], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(words) and (not len(first) or first[0] == 0):
                return ids, np.diff(first, append=len(ids))
        e = self.tokenizer.encode(row, add_special_tokens=False)
        begins = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = np.fromiter((b for _, b in e.offsets), np.int64, len(e)) - 1  # a token's last character is never a space
        return np.array(e.ids, np.uint32), np.bincount(np.searchsorted(begins, last, "right"), minlength=len(words))

    def _learn(self, pieces: list[str]) -> None:
        """Encodes the new ``pieces``: words in rows of 500, all else each by itself."""
        alone = [p[:1] == _BARE or p == "\n" for p in pieces]
        one = [i for i, a in enumerate(alone) if a]
        rest = [i for i, a in enumerate(alone) if not a]
        each = self.tokenizer.encode_batch_fast([pieces[i].removeprefix(_BARE) for i in one], add_special_tokens=False)
        found = [np.array(e.ids, np.uint32) for e in each]
        counts = [np.array([len(x) for x in found], np.int64)]
        for k in range(0, len(rest), 500):
            ids, n = self._run([pieces[i] for i in rest[k : k + 500]])
            found.append(ids)
            counts.append(n)
        place = np.array(one + rest, np.int64)
        n = np.concatenate(counts)
        order = np.argsort(np.repeat(place, n), kind="stable")
        sizes = np.zeros(len(pieces), np.int64)
        sizes[place] = n
        self.starts = np.concatenate([self.starts, np.cumsum(sizes) + self.starts[-1]])
        self.ids = np.concatenate([self.ids, np.concatenate(found)[order]])

    def batch(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with ``end_id`` behind it; number of ids of each text)."""
        if len(self.number) > self.most:
            self._forget()
        cut = _words if self.drops_space else _pieces
        split = [[_BARE + t] if _ODD.search(t) or any(s in t for s in self.special) else cut(t) for t in texts]
        counts = np.array([len(p) for p in split], np.int64)
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.number) > known:
            self._learn(list(islice(reversed(self.number), len(self.number) - known))[::-1])
        starts = self.starts
        first = starts[at]
        lengths = starts[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        sizes = ends[bounds[1:]] - ends[bounds[:-1]] + 1
        flat = np.repeat(first - ends[:-1], lengths) + np.arange(ends[-1])
        out = np.full(int(sizes.sum()), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(sizes) - 1] = False
        out[keep] = self.ids[flat]
        return out, sizes


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(file: str, drops_space: bool) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    key = (file, drops_space)
    keep_cache("encoders", _encoders.clear)
    if key not in _encoders:
        _encoders[key] = Encoder(file, drops_space)
    return _encoders[key]


def chunks(texts: list[str], most: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, so that no array grows with the batch."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((begin, i))
            begin, size = i, 0
        size += len(t)
    return [*out, (begin, len(texts))] if begin < len(texts) else out
