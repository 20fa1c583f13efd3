"""Normalised words: A-Z lower-cased, everything in ASCII but letters and digits between words, other characters kept."""

from __future__ import annotations

import re
from itertools import repeat

import ahocorasick

#: Byte for byte, so that offsets in the normalised text are offsets in the original UTF-8.
FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class WordAutomaton:
    """One Aho-Corasick automaton over sequences of words; every occurrence is reported, overlapping ones too."""

    def __init__(self, phrases: dict[tuple[bytes, ...], object]):
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, value in phrases.items():
            key = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in phrase)
            self.automaton.add_word(key, (len(key), value))
        if phrases:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> list[tuple[int, int, object]]:
        """(first word, word after the last, value) of each occurrence."""
        if not self.vocabulary or not words:
            return []
        ids = tuple(map(self.vocabulary.get, words, repeat(0)))
        return [(end + 1 - n, end + 1, value) for end, (n, value) in self.automaton.iter(ids)]


def offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points of the original text."""
    bounds = [m.span() for m in _WORD.finditer(text.translate(FOLD))]
    out, at, chars = [], 0, 0
    for byte in sorted({b for a, z in spans for b in (bounds[a][0], bounds[z - 1][1])}):
        chars += len(text[at:byte].decode("utf-8", "replace"))
        at = byte
        out.append((byte, chars))
    of = dict(out)
    return [(of[bounds[a][0]], of[bounds[z - 1][1]]) for a, z in spans]
