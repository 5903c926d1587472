"""Exact token ids of whole texts with the tokenizers library, memoised per word.

Both vocabularies split a text before any merge, and some borders are always
such splits: a non-space before a space or line feed, a letter next to a
non-letter, and at byte level both sides of one or two line feeds before a
non-space.  A text is therefore the concatenation of the ids of its pieces,
and a piece met before needs no second encoding.  The borders are only used
where they are certain: texts of ASCII and Latin-1 letters without other white
space and without the string of an added token, and never behind an apostrophe
(contractions); any other text goes to the library whole.  Most distinct words
of a corpus occur once: they get no lasting entry in the memo, which would be
full of them before the frequent words of later documents are met.
``tests/llm/test_tokens.py`` compares with plain encoding.
"""

from __future__ import annotations

import os
import re
from array import array

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Most entries of a worker's memo table (memory bound; a full table is kept as it is).
MEMO = 400_000
#: Entries that any word gets; beyond them a word gets one when it is met again (by its hash, in so many bytes).
MEMO_ANY, SEEN = 50_000, 1 << 22
#: Words met lately without a lasting entry (emptied when full): copies lie close to one another.
RECENT = 8_192

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNUSUAL = re.compile(r"[^\n -~À-ÖØ-öø-ÿ]")
_WORD_UNITS = re.compile(f"[{_LETTER}]+(?:'[^ ]*)?|[^ {_LETTER}']+(?:'[^ ]*)?|'[^ ]*")
_BYTE_WORDS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_BYTE_UNITS = re.compile(f"[ \\n]*(?:[{_LETTER}]+(?:'[^ \\n]*)?|[^ \\n{_LETTER}']+(?:'[^ \\n]*)?|'[^ \\n]*)|[ \\n]+")
#: Signs that often end a word: a border with the letters before.
_MARKS = '.,;:!?)"'


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_symbols() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 0x100 + k for k, b in enumerate(rest)}


class _Memo(dict):
    """Encodes a word that it does not hold (``encode`` keeps it where there is room); found words cost one lookup."""

    def __init__(self, encode):
        self.encode = encode
        self.seen, self.recent = bytearray(SEEN), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.recent.get(word)
        if ids is None:
            ids = self.encode(word)
        elif len(self) < MEMO:  # met again
            self[word] = ids
        return ids

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) >= 40:
            return ids
        slot, size = hash(word) & SEEN - 1, len(self)
        if size < MEMO_ANY or size < MEMO and self.seen[slot]:
            self[word] = ids
        else:
            self.seen[slot] = 1
            if len(self.recent) >= RECENT:
                self.recent.clear()
            self.recent[word] = ids
        return ids


def is_usual(text: str) -> bool:
    """Only ASCII and Latin-1 letters, signs, spaces and line feeds."""
    return text.replace("\n", "").isprintable() if text.isascii() else not _UNUSUAL.search(text)


def has_space_run(text: str) -> bool:
    """Spaces at an end of the text, side by side or next to a line feed; three line feeds, or two at the end."""
    return (text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text
            or "\n\n\n" in text or text[-2:] == "\n\n")


class TextEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes, without the end id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.folds_case = self.tokenizer.normalizer is not None
        #: The library cuts added tokens out of a text before any other split.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.added_folded = [t.content.lower() for t in added if t.normalized]
        self.pieces_of = (_WORD_UNITS if self.folds_case else _BYTE_UNITS).findall
        self.symbols = _byte_symbols()
        self.space = "" if self.folds_case else chr(self.symbols[0x20])
        #: Word (byte level: with a space before it, or with the line feed that it holds) -> ids; pieces of words without that space apart.
        self.words = _Memo(self._word)
        self.inner = self.words if self.folds_case else _Memo(self._inner)

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, letters: str, space: str) -> bytes:
        """A run of letters is one split: straight to the library's merges."""
        seen = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(space + seen)]).tobytes()

    def _inner(self, piece: str) -> bytes:
        return self.inner.keep(piece, self._merge(piece, "") if piece.isalpha() else self._ids(piece))

    def _piece(self, piece: str) -> bytes:
        if self.folds_case:
            ids = self.words.get(piece)
            return self._inner(piece) if ids is None else ids
        if piece[0] == " " and piece[1:].isalpha():
            return self.words[piece[1:]]
        return self.inner[piece]

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self.words.keep(word, self._merge(word, self.space))
        letters = word.rstrip(_MARKS)
        if letters.isalpha():
            return self.words.keep(word, self.words[letters] + self._piece(word[len(letters):]))
        if word[:1] == "\n":  # the line feed is a split of its own, the word behind it has no space
            pieces = ["\n", *self.pieces_of(word[1:])]
        else:
            pieces = self.pieces_of(word if self.folds_case else " " + word)
        return self.words.keep(word, b"".join(map(self._piece, pieces)))

    def _holds_added(self, text: str) -> bool:
        if any(map(text.__contains__, self.added)):
            return True
        return bool(self.added_folded) and any(map(text.lower().__contains__, self.added_folded))

    def encode(self, text: str) -> bytes:
        if not is_usual(text) or self._holds_added(text):
            return self._ids(text)
        head = b""
        if self.folds_case:
            words = text.lower().replace("\n", " ").split(" ")
        elif has_space_run(text):  # a run of white space is split by its whole length
            return b"".join([self._piece(p) for w in _BYTE_WORDS.findall(text) for p in self.pieces_of(w)])
        else:
            words = text.replace("\n", " \n").split(" ")  # each further word carries the space or line feed before it
            head = b"".join(map(self._piece, self.pieces_of(words.pop(0))))
        return head + b"".join(map(self.words.__getitem__, words))


def encoder(path: str) -> TextEncoder:
    """The Python worker's encoder of a vocabulary file."""
    return held(path, lambda: TextEncoder(path))
