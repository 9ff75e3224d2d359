"""Token ids of whole texts by the tokenizers library, one call for each new word only.

A word-level pre-tokenizer never joins across the places where the texts are cut here, so the ids of
a text are the ids of its pieces in order. Each Python worker keeps the ids of the words that it has
met, up to a fixed number of bytes, and none of very long words. A text that has white space where a cut might matter is encoded
in one call.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from sys import getsizeof

from tokenizers import Tokenizer

#: Bytes of words and ids, about, that a worker keeps for each of its two kinds of words; and letters of the longest word that it keeps.
CACHED_BYTES, LONGEST_KEPT = 72 << 20, 256
#: Bytes of an entry of a dictionary, about.
SLOT = 100
#: ASCII marks that may be cut off after a letter; the apostrophe is missing, as it starts contractions.
MARKS = ".,*%$&#!|:;?)]}"
#: Letters from here on may turn into a letter and a mark when a text is normalised.
LAST_PLAIN = "\u0130"


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class _Uncut(Exception):
    """The text has to be encoded in one call."""


class _Words(dict):
    """Ids of words as little-endian uint32 bytes, made on demand. lead stands before each word."""

    def __init__(self, tokenizer: Tokenizer, room: int, lead: str = "", bare: _Words | None = None) -> None:
        super().__init__()
        self.tokenizer, self.room, self.lead, self.held = tokenizer, room, lead, 0
        self.bare = self if bare is None else bare
        self.model, self.folded = tokenizer.model, False

    def __missing__(self, word: str) -> bytes:
        if self.lead and (not word or word[0].isspace()):
            raise _Uncut
        core = word.rstrip(MARKS)
        if word.isalpha() and max(word) < LAST_PLAIN:
            # letters only: one pre-token, which goes to the vocabulary's model at once
            if self.folded and (low := word.lower()) != word:
                found = self[low]
            else:
                letters = (self.lead + word).encode().decode("latin-1").translate(BYTE_LETTERS)
                found = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
        elif core != word and core and core[-1].isalpha() and core[-1] < LAST_PLAIN:
            found = self[core] + self.bare[word[len(core) :]]
        elif word.count("\n") == 1 and 0 < (at := word.index("\n")) < len(word) - 1 and not word[at - 1].isspace() and not word[at + 1].isspace():
            found = self[word[:at]] + self.bare["\n"] + self.bare[word[at + 1 :]]
        else:
            found = array("I", self.tokenizer.encode(self.lead + word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST_KEPT:
            size = getsizeof(word) + getsizeof(found) + SLOT
            if self.held + size > self.room:
                self.clear()
                self.held = 0
            self.held += size
            self[word] = found
        return found


class TextEncoder:
    """encode(text): the ids of a whole text as little-endian uint32 bytes."""

    def __init__(self, path: str, cached_bytes: int = CACHED_BYTES) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = _Words(self.tokenizer, cached_bytes)
        self.spaced = _Words(self.tokenizer, cached_bytes, " ", self.bare)
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        steps = [step.get("type") for step in before.get("pretokenizers", [before])]
        normal = parts["normalizer"] or {}
        if normal == {} and steps == ["ByteLevel"] and before.get("use_regex") and not before.get("add_prefix_space"):
            self.by_words = self._before_spaces
        elif [step.get("type") for step in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]:
            self.by_words = self._at_white_space
            self.bare.folded = True
        else:
            self.by_words = self._whole
        self._rare_space = re.compile(r"[^\S \n\t\r]|[\x1c-\x1f]").search

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _before_spaces(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def _at_white_space(self, text: str) -> bytes:
        if self._rare_space(text):
            raise _Uncut
        return b"".join(map(self.bare.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        try:
            return self.by_words(text) if text else b""
        except _Uncut:
            return self._whole(text)


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker."""
    return TextEncoder(path)
