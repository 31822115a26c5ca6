"""SentencePiece (merge type) encoding by a table of last tokens, and decoding.

For every prefix of a unit exactly one token can end its encoding. The table of these is filled from left to right: an
Aho-Corasick automaton gives the tokens that end at a position, and the one that is compatible with the last
token of the prefix before it goes into the table. Two tokens are compatible if merging their joined text gives just
the two. The ids are then read from the table backwards.

A text falls into units at spaces and at ASCII characters that stand in no piece: no token crosses these,
so a unit's ids do not depend on its neighbours and are kept in a cache.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from hearthgrid.llm.common import map_rows

SPACE = "▁"
#: Units and token pairs that one worker holds; a full cache starts anew.
CACHE_UNITS, CACHE_PAIRS = 800_000, 1_000_000
#: Longer units are not kept, so the cache is bounded in bytes as well.
CACHE_LETTERS = 64
_LOADED: dict = {}


class PieceModel(dict):
    """Unit -> its ids, filled as units come up.

    Pieces of a merge-type model with byte fallback and the identity normalizer.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
        ]
        if any(sp.is_unused(i) for i in plain) or not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("the model must have byte pieces and no unused pieces")
        if sp.normalize("ﬁ  x ") != f"{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}":
            raise ValueError("the model must put one space before the text and change nothing else")
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        held = set("".join(self.ids))
        foreign = "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in held)
        self.unit = re.compile(f"{SPACE}+[^{SPACE}{foreign}]*|[^{SPACE}{foreign}]+|[{foreign}]" if foreign
                               else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.merges: dict[str, tuple[list, list] | None] = {}
        self.decimal = [str(i) for i in range(sp.get_piece_size())]

    def history(self, token: str) -> tuple[list, list] | None:
        """Merges that make ``token`` of its characters, as (score, last symbol) and (score, first symbol) after each.

        The best-scored pair is merged first, the leftmost of equals. None if merging ends in several tokens.
        """
        if token not in self.merges:
            symbols, lasts, firsts = list(token), [], []
            while len(symbols) > 1:
                pairs = [self.score.get(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
                best = max((s for s in pairs if s is not None), default=None)
                if best is None:
                    break
                at = pairs.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                lasts.append((best, symbols[-1]))
                firsts.append((best, symbols[0]))
            self.merges[token] = (lasts, firsts) if len(symbols) == 1 else None
        return self.merges[token]

    def compatible(self, left: str, right: str) -> bool:
        """True if merging ``left + right`` gives these two tokens; ``left`` is empty at the start.

        The merges inside both go on in turn, the better-scored first, as long as none across their border is better.
        """
        b = self.history(right)
        a = self.history(left) if left else ([], [])
        if a is None or b is None or not left:
            return a is not None and b is not None
        score = self.score.get
        lasts, firsts = a[0], b[1]
        i, j, end, start = 0, 0, left[-1], right[0]
        while True:
            own_left = lasts[i][0] if i < len(lasts) else None
            own_right = firsts[j][0] if j < len(firsts) else None
            across = score(end + start)
            if across is not None and (own_left is None or across > own_left) and (own_right is None or across >= own_right):
                return False
            if own_left is not None and (own_right is None or own_left >= own_right):
                end, i = lasts[i][1], i + 1
            elif own_right is not None:
                start, j = firsts[j][1], j + 1
            else:
                return True

    def tokens(self, unit: str) -> list[str]:
        """Tokens of a unit by the table of last tokens; where no longer one fits, a prefix's last token is a character."""
        last, pairs = ["", *unit], self.pairs
        if len(pairs) >= CACHE_PAIRS:
            pairs.clear()
        for end, piece in self.automaton.iter(unit):
            end += 1
            if len(last[end]) == 1:
                key = last[end - len(piece)], piece
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(*key)
                if fits:
                    last[end] = piece
        out, at = [], len(unit)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids: list[int] = []
        for token in self.tokens(unit):
            i = self.ids.get(token)
            if i is None:
                ids += [self.byte[b] for b in token.encode()]
            else:
                ids.append(i)
        found = tuple(ids)
        if len(unit) <= CACHE_LETTERS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``, without begin or end ids."""
        if not text:
            return []
        units = self.unit.findall(SPACE + text.replace(" ", SPACE))
        return list(chain.from_iterable(map(self.__getitem__, units)))

    def join(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join([self.decimal[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def loaded(path: str) -> PieceModel:
    """The model at ``path``, read once by each worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row of ``docs`` (``doc_id, text``); ``model`` is the model file's path.

    A NULL text is encoded as an empty one, without ids. Repeated rows and NULL ids keep one output row
    each; an empty table gives an empty result; other columns are ignored.
    """

    def rows(ids, texts):
        pieces = loaded(model)
        for doc_id, text in zip(ids, texts, strict=True):
            found = pieces.encode(text or "")
            yield doc_id, found, pieces.decode(found)

    return map_rows(docs.select("doc_id", "text"), rows, ENCODED, rows=200)


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """As :func:`encode_documents`, with the number of ids and SHA-256 of ids and decoded text in their place."""

    def rows(ids, texts):
        pieces = loaded(model)
        for doc_id, text in zip(ids, texts, strict=True):
            found = pieces.encode(text or "")
            texts_of = pieces.join(found), pieces.decode(found)
            digests = (hashlib.sha256(x.encode()).hexdigest() for x in texts_of)
            yield doc_id, len(found), *digests

    return map_rows(docs.select("doc_id", "text"), rows, DIGESTS)
