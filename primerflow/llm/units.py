"""Cuts texts where every byte-level BPE of this kind cuts them, and keeps what each cut-out encodes to.

The public pre-token pattern always starts a pre-token at a space that a non-space follows, whatever
stands before. Text between two such places (a unit: a space, a word, its punctuation) therefore encodes
on its own, and units repeat, so that a library is called once per unit and not once per occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space in any library's reading; cutting at fewer places is always right.
_SPACE = r"\s\u0085᠎​⁠﻿"
_ODD = re.compile(f" (?:[{_SPACE}]|\\Z)")
_CUT = re.compile(f"(?= [^{_SPACE}])")
#: Units kept by each of the two generations of a memo.
KEEP = 300_000


class Memo(dict):
    """unit -> value of ``encode(list of units)``. Two generations bound its memory; units in use survive."""

    def __init__(self, encode: Callable[[list[str]], list], prefix: str = "", keep: int = KEEP):
        super().__init__()
        self.encode, self.prefix, self.keep, self.old = encode, prefix, keep, {}

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.encode([self.prefix + unit])[0]
        self[unit] = value
        return value

    def turn(self) -> None:
        """Called between texts: the older half goes once the younger is full."""
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()

    def learn(self, units: set[str]) -> None:
        """Encodes the units that are not known yet in one call."""
        new = [u for u in units if u not in self and u not in self.old]
        if new:
            self.update(zip(new, self.encode([self.prefix + u for u in new])))


def units(text: str) -> list[str]:
    """The units of a text, joined again the text."""
    if _ODD.search(text):
        return _CUT.split(text)
    head, *rest = text.split(" ")
    return [head, *(" " + r for r in rest)]


class Encoder:
    """Values of the units of a text, in order."""

    def __init__(self, encode: Callable[[list[str]], list], keep: int = KEEP):
        self.whole, self.tail = Memo(encode, keep=keep), Memo(encode, " ", keep)

    def __call__(self, text: str) -> list:
        self.whole.turn()
        self.tail.turn()
        if _ODD.search(text):
            parts = _CUT.split(text)
            return [self.whole[u] for u in parts]
        head, *rest = text.split(" ")
        return [self.whole[head], *map(self.tail.__getitem__, rest)]

    def learn(self, texts: list[str]) -> None:
        """Encodes the new units of many texts in one call of the library."""
        tail: set[str] = set()
        for text in texts:
            if not _ODD.search(text):
                tail.update(text.split(" ")[1:])
        self.tail.learn(tail)
