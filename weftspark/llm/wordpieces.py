"""Cutting texts into the words of a lower-casing BPE with word ends, and tokenising by a memo of words."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

from .pieces import Memo, _library

#: Letters and signs for which the standard library lowers and cuts as the tokenizer does: one composed character each,
#: whose lower case is one character too (so not U+0130).
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(rf"[\t\n\r!-~ {_LETTERS}]*")
#: Words of lower-cased plain text: endings behind an apostrophe, letters, single digits, other signs.
_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_SPACES = re.compile(r"[\t\n\x0b\x0c\r ]+")


def words(text: str) -> list[str]:
    """Pieces of a text that the tokenizer encodes each on its own.

    What stands between white space and holds other characters than plain ones is
    one piece: the library itself normalises and cuts it.
    """
    if _PLAIN.fullmatch(text):
        return _WORD.findall(text.lower())
    out: list[str] = []
    for chunk in _SPACES.split(text):
        if _PLAIN.fullmatch(chunk):
            out += _WORD.findall(chunk.lower())
        else:
            out.append(chunk)
    return out


class WordMemo(Memo):
    """A :class:`Memo` of words instead of the pieces of a byte-level BPE."""

    def cut(self, text: str) -> list[str]:
        if not any(name in text for name in self.added):
            return words(text)
        return [p for k, part in enumerate(self.splits.split(text)) for p in ([part] if k % 2 else words(part))]


def word_memo(path: str) -> WordMemo:
    """A memo that encodes as the tokenizers library does without its post-processor; added tokens in texts are one id each."""
    tok = _library(path)
    extra = list(tok.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in extra):
        raise ValueError("added tokens that take in what stands beside them are not supported")
    dtype = "<u2" if max(tok.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4"

    def encode(pieces: list[str]) -> Iterable[bytes]:
        return (np.array(e.ids, dtype).tobytes() for e in tok.encode_batch_fast(pieces, add_special_tokens=False))

    return WordMemo(encode, dtype, tuple(t.content for t in extra if t.content))
