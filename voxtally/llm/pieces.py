"""Cut texts for byte-level tokenizers, with a memory of the pieces already seen.

A space before a character that is no white space always starts a match of the splitting pattern,
whatever stands around it. So a text is first cut there, by fast string methods; the pattern runs on
distinct cuts only. A memory is bounded in bytes: long cuts (a text without spaces is one) are worked out each
time, and when half the room is used the older half is forgotten.
"""

from __future__ import annotations

import base64
import re

import public_tokenizers
import regex

#: Bytes that a memory may take in a worker, and the characters of the longest string it keeps.
ROOM = 128 << 20
LONGEST = 64
#: Bytes of an entry besides its contents (key and value objects and their place in a table), and of a number in a tuple.
ENTRY, NUMBER = 160, 36
MARK = "\x00"

_not_before_word = re.compile(r" (?:\s|$)")
_before_word = re.compile(r"(?= \S)")


def cuts(text: str) -> list[str]:
    """Parts of the text, each but the first starting with the space before a word."""
    if not text:
        return []
    if MARK in text or _not_before_word.search(text):
        return [x for x in _before_word.split(text) if x]
    parts = text.replace(" ", MARK + " ").split(MARK)
    return parts if parts[0] else parts[1:]


class Memory(dict):
    """Remembers what a function gave for short strings, within a bound of bytes."""

    def __init__(self, function=None, room: int = ROOM):
        super().__init__()
        self.function, self.room, self.used, self.old = function, room, 0, {}

    def __missing__(self, part: str):
        value = self.old.get(part)
        if value is None:
            value = self.function(part)
        self.keep(part, value)
        return value

    def keep(self, part: str, value) -> None:
        """Remember a value; long strings are not."""
        if len(part) <= LONGEST:
            self[part] = value
            self.used += ENTRY + len(part) + len(value) * (1 if type(value) is bytes else NUMBER)
            if self.used > self.room // 2:
                self.old, self.used = dict(self), 0
                self.clear()


def splitter(pattern: str):
    """The pattern's matches in a string, with Unicode's white space.

    For the public pattern, letters with or without a space before them are one match.
    """
    spaces = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
    find = regex.compile(spaces.replace(r"\S", r"\P{White_Space}")).findall
    if pattern != public_tokenizers.PATTERN:
        return find

    def split(part: str) -> list[str]:
        return [part] if part.isalpha() or part[:1] == " " and part[1:].isalpha() else find(part)

    return split


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
