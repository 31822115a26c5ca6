"""Token ids of whole texts by a public ``tokenizers`` vocabulary, with a cache of words.

The vocabulary splits a lower-cased text into words before it applies merges, so the ids of a text are those of
its words in turn. For texts of plain letters, digits and punctuation the same split is done here
and each word's ids are kept; any other text goes to the library as a whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Words that one worker holds in each of two generations. A full one becomes the older one, from which
#: words that come up again move back, so frequent words stay.
CACHE_WORDS = 300_000
#: Longer words are not kept, so the cache is bounded in bytes as well.
CACHE_LETTERS = 64
#: Texts longer than this are cut at white space, which no token crosses.
CHUNK = 1 << 20

_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER, _NUMBER = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
# Plain: no control, no combining mark, no letter whose lower case leaves the range, and no special token's opening.
_OTHER = re.compile("[^\t\n\x0b\x0c\r -~\x85\xa0-įı-ſ‐-‧€]|<\\|")
_CUT = re.compile(f"[{_SPACE}]")
_LOADED: dict = {}


class WordIds(dict):
    """Word -> its ids as bytes of ``dtype``, filled as words come up."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHE_LETTERS:
            return self.whole(word)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as bytes of ``dtype``."""
        if _OTHER.search(text):
            return self.whole(text)
        if len(text) <= CHUNK:
            return b"".join(map(self.__getitem__, _WORD.findall(text.lower())))
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + CHUNK)
            end = cut.end() if cut else len(text)
            parts.append(b"".join(map(self.__getitem__, _WORD.findall(text[at:end].lower()))))
            at = end
        return b"".join(parts)


def loaded(path: str) -> WordIds:
    """The vocabulary at ``path``, read once by each worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
