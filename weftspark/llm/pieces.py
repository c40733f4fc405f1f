"""Cutting texts into the pieces of a byte-level BPE, and tokenising by a memo of pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import public_tokenizers
import regex

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of these characters alone are cut by the standard library's engine, which is faster; there both agree.
_PLAIN = re.compile(rf"[\t\n\r!-~ {_LATIN}]*")
_PLAIN_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_PIECE = regex.compile(public_tokenizers.PATTERN)


def cut(text: str) -> list[str]:
    """The matches of ``public_tokenizers.PATTERN``, in order; they cover the text."""
    return _PLAIN_PIECE.findall(text) if _PLAIN.fullmatch(text) else _PIECE.findall(text)


class Memo:
    """Token ids of texts, remembering those of pieces.

    ``encode_pieces`` gets distinct pieces and returns their ids as bytes of
    type ``dtype``.  Texts are cut at the ``added`` names first (the longest where
    several fit), each of which is a piece of its own.  Beyond ``limit`` entries the memo
    forgets all but the first half, and pieces of over ``longest`` characters are not remembered:
    memory is bounded.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], Iterable[bytes]], dtype: str = "<u4", added: tuple[str, ...] = (), limit: int = 800_000, longest: int = 64) -> None:
        self.encode_pieces, self.dtype, self.added, self.limit, self.longest = encode_pieces, np.dtype(dtype), added, limit, longest
        self.splits = re.compile(f"({'|'.join(re.escape(x) for x in sorted(added, key=len, reverse=True))})") if added else None
        self.pieces: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        for name in self.added:
            if name in text:
                break
        else:
            return cut(text)
        parts = self.splits.split(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else cut(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.limit:
            # Frequent pieces come early: the first half stays.
            self.pieces = dict(islice(self.pieces.items(), self.limit // 2))
        known, get = self.pieces, self.pieces.__getitem__
        out: list[bytes] = []
        waiting: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            pieces = self.cut(text)
            try:
                out.append(b"".join(map(get, pieces)))
            except KeyError:  # some piece is new
                out.append(b"")
                waiting.append((i, pieces))
        if waiting:
            new = set().union(*(x for _, x in waiting)).difference(known)
            missing = list(new)
            known.update(zip(missing, self.encode_pieces(missing), strict=True))
            for i, pieces in waiting:
                out[i] = b"".join(map(get, pieces))
            for p in missing:
                if len(p) > self.longest:
                    del known[p]
        return out


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def largest_id(path: str) -> int:
    """The largest token id of a vocabulary."""
    return max(_library(path).get_vocab(with_added_tokens=True).values())


def library_memo(path: str) -> Memo:
    """A memo that encodes as the tokenizers library does without its post-processor.

    Added tokens (special ones too) are found in texts before anything else and
    become one id each, the longest where several fit.  Ids are unsigned 16-bit
    where the vocabulary allows, else 32-bit.  Pieces that begin with a space are
    encoded as one text, where each begins at a token that begins with a space;
    others one by one.
    """
    tok = _library(path)
    extra = list(tok.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word for t in extra):
        raise ValueError("added tokens that take in what stands beside them are not supported")
    added = tuple(t.content for t in extra if t.content)
    vocab = tok.get_vocab(with_added_tokens=True)
    dtype = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
    begins = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        begins[i] = token.startswith("Ġ")

    def encode(pieces: list[str]) -> Iterable[bytes]:
        out: dict[str, bytes] = {}
        spaced = [p for p in pieces if p.rfind(" ") == 0 and len(p) > 1 and not p[1].isspace()]
        for i in range(0, len(spaced), 2000):
            part = spaced[i : i + 2000]
            ids = np.array(tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype)
            at = np.flatnonzero(begins[ids])
            if len(at) == len(part):
                data, cuts = ids.tobytes(), (at * ids.itemsize).tolist()
                out.update(zip(part, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)])), strict=True))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, (np.array(e.ids, dtype).tobytes() for e in tok.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return map(out.__getitem__, pieces)

    return Memo(encode, dtype, added)


#: Texts that a memo takes at once, in bytes: their chunks are all held for that time.
SLICE = 2 << 20
_memos: dict[tuple, Memo] = {}


def shared_memo(make: Callable[[str], Memo], path: str) -> Memo:
    """A worker's memo for a vocabulary: it outlives tasks, and stays within its limit."""
    key = make.__module__, make.__qualname__, path
    if key not in _memos:
        _memos[key] = make(path)
    return _memos[key]
