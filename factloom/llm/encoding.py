"""Whole-text encoding with a public tokenizer, for use inside tasks."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters that some regex engines count as white space and Python does not, or the other way round.
DOUBTFUL_SPACE = "\x1c\x1d\x1e\x1f\x85᠎​⁠﻿"

_encoders: dict[tuple[str, int], IdEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, else from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class IdEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    The byte-level pattern of this tokenizer never joins a character that is not white space with white space after
    it, so a text may be cut before each space that follows such a character, and the parts encoded alone give the
    same ids. Parts repeat (they are words), so their ids are kept, up to `limit` parts. A text with a space after
    white space, or with the string of an added token (which gives that token's id), is encoded as one piece.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.limit = limit
        self.line_end = self.whole("\n")
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters_ids(self, run: str, space: str) -> bytes:
        """Ids of one run of letters, which is one unit of the model, after a space or none."""
        raw = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(space + raw)]).tobytes()

    def part(self, word: str) -> bytes | None:
        """Ids of a space and then word; None if a cut before the space or after the word would not be safe."""
        return self.known(word, self.rest, self.space, " ")

    def head(self, word: str) -> bytes:
        """Ids of a part without a space before it."""
        found = self.known(word, self.first, "", "")
        return self.whole(word) if found is None else found

    def known(self, word: str, kept: dict[str, bytes], space: str, before: str) -> bytes | None:
        found = kept.get(word)
        if found is not None:
            return found
        if not word or word[-1].isspace() or word[-1] in DOUBTFUL_SPACE:
            return None
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            found = self.letters_ids(word, space)
        elif word[-1] in ".,!" and word[-2:-1].isalpha():  # a unit ends between a letter and a mark
            found = self.known(word[:-1], kept, space, before) + self.head(word[-1])
        elif (cut := word.find("\n")) > 0 and not word[cut - 1].isspace() and not word[cut + 1].isspace() and not {word[cut - 1], word[cut + 1]} & set(DOUBTFUL_SPACE):
            found = self.known(word[:cut], kept, space, before) + self.line_end + self.head(word[cut + 1 :])
            return found  # a pair of words seldom comes again
        else:
            found = self.whole(before + word)
        if len(word) < 64:
            kept[word] = found
        return found

    def one(self, text: str | None) -> bytes:
        if not text:
            return b""
        for added in self.added:
            if added in text:
                return self.whole(text)
        parts = text.split(" ")
        head = parts.pop(0)
        if parts and head and (head[-1].isspace() or head[-1] in DOUBTFUL_SPACE):
            return self.whole(text)
        tail = list(map(self.rest.get, parts))
        try:
            return self.head(head) + b"".join(tail)
        except TypeError:  # parts not met before
            pass
        if len(self.rest) > self.limit:
            self.rest.clear()
        part = self.part
        for i, ids in enumerate(tail):
            if ids is None and (found := part(parts[i])) is not None:
                tail[i] = found
        if tail[-1] is None and not parts[-1]:  # one space at the end of the text
            tail[-1] = self.head(" ")
        try:
            return self.head(head) + b"".join(tail)
        except TypeError:  # a space after white space
            return self.whole(text)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        if len(self.first) > self.limit // 10:
            self.first.clear()
        return [self.one(t) for t in texts]


def encoder(path: str) -> IdEncoder:
    """One encoder per Python worker and file."""
    key = (path, os.getpid())
    if key not in _encoders:
        _encoders[key] = IdEncoder(path)
    return _encoders[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
