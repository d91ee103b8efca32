"""Ids of the ``tokenizers`` library for many texts, asked once for each distinct stretch of text.

Two kinds of file let a text be cut without changing its ids, and the cuts are where ASCII white space is:

* byte-level BPE behind the public pattern, which starts a pre-token at a space that a non-space follows (``units``). It also
  starts one at an ASCII mark behind a letter and at a line end behind a mark or letter, and behind a line end that stands
  alone, so a word is one stretch whatever follows it;
* BPE with word ends, whose words never hold white space. Normal form C neither joins nor reorders anything across
  white space, and lower case is taken letter by letter, so stretches between ASCII white space stand alone. Nor does a
  word or what normal form joins go from a letter to an ASCII mark behind it, so marks are cut off ASCII and Latin-1 letters.

Every id comes from the library: new stretches go to it in one text, a special token between every two, at which the
library itself cuts, except where these cost more than the words:

* byte-level stretches that begin with a space need nothing between them, those that neither begin nor end with white space
  a line end, for the pattern cuts there; the bytes that tokens stand for show where each stretch ends;
* of the other kind, those of lower-case ASCII and Latin-1 letters alone, or of marks alone, are what they are in normal form
  and lower case, and one word each; they go, with spaces, to a copy of the tokenizer without these steps, and the ends of
  words show in the ids.

Stretches that hold the string of a special token, and files of any other kind, go to it as they are.

What it said is kept in a table with a slot for each of ``2**SLOT_BITS`` hashes (known by 128 bits, no object for a stretch)
and a row of up to ``STORE`` ids; when that is full all is forgotten, so memory is bounded. A worker keeps it from task to task,
until it gets a task that does not ask (``common.mapped``).
"""

from __future__ import annotations

import json
import re
import string
from functools import lru_cache

import numpy as np

from .common import DROPS
from .vocab import ids_of, tokenizer

SLOT_BITS, STORE = 20, 1 << 22
#: Bytes of text that are cut at once, about.
_TEXT = 250_000
#: A place at which a long text may be cut for either kind.
_SAFE = re.compile(" (?=[A-Za-z])")
#: Marks that are cut off letters, and stretches that normal form and lower case leave alone and that are one word.
_MARKS = ",.;:!?%$#*&"
_PLAIN = re.compile(f"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[{_MARKS}]+")
_BYTES = np.arange(256)
_IS_MARK = np.isin(_BYTES, [ord(c) for c in _MARKS])
_IS_LETTER = (_BYTES | 32 >= ord("a")) & (_BYTES | 32 <= ord("z"))
#: Second bytes of Latin-1 letters, which follow 0xC3.
_IS_SECOND = (_BYTES >= 0x80) & (_BYTES < 0xC0) & ~np.isin(_BYTES, [0x97, 0xB7])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that may not follow a space where a unit starts: white space, and first bytes of white space beyond ASCII.
_NO_START = _SPACE | np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
#: ASCII characters that are neither white space nor control characters.
_GRAPHIC = (_BYTES > 0x20) & (_BYTES < 0x7F)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _kind(spec: dict) -> str:
    """How texts for this file may be cut: "units", "words" or "" for not at all."""
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
    if any(t[k] != v for t in spec["added_tokens"] for k, v in plain.items()) or not spec["added_tokens"]:
        return ""
    if any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
        return ""
    before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if not normal and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "units" if _has_all_bytes(spec["model"]) else ""
    steps = [n.get("type") for n in normal.get("normalizers", [])]
    split = (before.get("pretokenizers") or [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", ""):
        return "words"
    return ""


def _has_all_bytes(model: dict) -> bool:
    """Whether tokens are strings of bytes and every byte has one, so that the tokens of a text hold all of it."""
    from tokenizers.pre_tokenizers import ByteLevel

    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    return all(byte in model["vocab"] for byte in ByteLevel.alphabet())


def _hashes(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each of some stretches that follow one another in ``flat``."""
    if not size.size:
        return np.zeros((2, 0), np.uint64)
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        term = (np.arange(1, flat.size + 1) - np.repeat(first, size)).astype(np.uint64) << np.uint64(8)
        term = (term | flat) * _MIX[0]
        term = (term ^ (term >> np.uint64(29))) * _MIX[1]
        term ^= term >> np.uint64(32)
        other = term * _MIX[2]
        other ^= other >> np.uint64(31)
        return np.stack([np.add.reduceat(term, first), np.add.reduceat(other, first)])


def _slices(text: str) -> list[str]:
    """A long text in parts whose ids are those of the whole."""
    out, at = [], 0
    while len(text) - at > 2 * _TEXT and (cut := _SAFE.search(text, at + _TEXT)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Library:
    def __init__(self, path: str):
        tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.kind = path, _kind(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.mark, self.mark_id = (self.special[0], spec["added_tokens"][0]["id"]) if self.kind else ("", -1)
        most = tokenizer(path).get_vocab_size(with_added_tokens=True)
        if self.kind == "words":  # the last id of a word alone ends one
            self.ends = np.zeros(most, bool)
            self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
            self.plain = _without_steps(path)
        if self.kind == "units":  # a character of a byte-level token is a byte
            vocab = spec["model"]["vocab"]
            self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.bytes[list(vocab.values())] = [len(token) for token in vocab]
            self.marks = np.isin(_BYTES, [ord(c) for c in set(string.punctuation).difference(*self.special)])
        self.key, self.n = np.zeros((2, 2**SLOT_BITS), np.uint64), np.zeros(2**SLOT_BITS, np.int32)  # no ids: a free slot
        self.at, self.used = np.zeros(2**SLOT_BITS, np.int32), 0
        self.store = np.zeros(STORE, np.uint16 if most <= 2**16 else np.uint32)

    def _cut(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes, start and size of each stretch, number of stretches of each text, hashes of the stretches)."""
        between = b" " if self.kind == "words" else b""
        raw = between.join(texts) + between
        flat = np.frombuffer(raw, np.uint8)
        first = np.cumsum([0, *[len(t) + len(between) for t in texts]])
        if between:
            inside = np.append(~_SPACE[flat], False)
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            letter = _IS_LETTER[flat]
            letter[1:] |= _IS_SECOND[flat[1:]] & (flat[:-1] == 0xC3)
            opens[1:-1] |= _IS_MARK[flat[1:]] & letter[:-1]
            closes = inside[:-1] & (opens[1:] | ~inside[1:])
            start, size = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            size, flat = size - start, flat[inside[:-1]]
        else:
            opens = np.zeros(flat.size + 1, bool)
            opens[:-2] = (flat[:-1] == 32) & ~_NO_START[flat[1:]]
            opens[np.maximum(first - 1, 0)] = False  # a space that ends a text starts nothing
            seen = _GRAPHIC[flat]
            letter = _IS_LETTER[flat]
            letter[1:] |= _IS_SECOND[flat[1:]] & (flat[:-1] == 0xC3)
            line = flat[1:] == 10
            line &= seen[:-1] | letter[:-1]  # a line end behind a mark or letter
            opens[1:-1] |= line | (self.marks[flat[1:]] & letter[:-1])
            opens[2:-1] |= line[:-1] & ~_NO_START[flat[2:]]
            opens[first] = True
            start = np.flatnonzero(opens)
            start, size = start[:-1], np.diff(start)
        number = np.bincount(np.searchsorted(first, start, side="right") - 1, minlength=len(texts))[: len(texts)]
        return raw, start, size, number, _hashes(flat, size)

    def _ask_units(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``_ask`` for byte-level stretches."""
        size = np.array([len(p) for p in parts])
        joined = b"".join(parts)
        flat, at = np.frombuffer(joined, np.uint8), np.cumsum(size) - size
        first, last = flat[at], flat[at + size - 1]
        second, before = flat[at + np.minimum(1, size - 1)], flat[at + np.maximum(size - 2, 0)]
        spaced = (first == 32) & ~_NO_START[second]
        lined = ~_NO_START[first] & (_GRAPHIC[last] | (_IS_SECOND[last] & (before == 0xC3)))
        for s in (s.encode() for s in self.special):
            if s in joined:
                without = np.array([s not in p for p in parts])
                spaced, lined = spaced & without, lined & without
        a, b, c = np.flatnonzero(lined), np.flatnonzero(spaced), np.flatnonzero(~(lined | spaced))
        text = b"".join([parts[k] + b"\n" for k in a.tolist()] + [parts[k] for k in b.tolist()])
        ids = np.array(ids_of(self.path, [text.decode()])[0], "<u4")
        wide = np.append(size[a] + 1, size[b])
        start = np.cumsum(wide) - wide
        ends = np.cumsum(self.bytes[ids])  # where in the text each token ends
        others, counts = self._ask([parts[k].decode() for k in c.tolist()])
        n, place = np.zeros(size.size, np.int64), np.zeros(size.size, np.int64)
        asked = np.append(a, b)
        place[asked] = np.searchsorted(ends, start, side="right")
        n[asked] = np.searchsorted(ends, start + size[asked], side="right") - place[asked]
        n[c], place[c] = counts, ids.size + np.cumsum(counts) - counts
        return _gather(np.append(ids, others), place, n), n

    def _ask(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What the library says to each of some stretches: all ids in a row, and how many each has."""
        out = [b""] * len(parts)
        plain, alone, others = [], [], []
        for k, p in enumerate(parts):
            if self.kind == "words" and _PLAIN.fullmatch(p):
                plain.append(k)
            else:
                (alone if any(s in p for s in self.special) else others).append(k)
        for k, ids in zip(alone, ids_of(self.path, [parts[k] for k in alone]) if alone else []):
            out[k] = np.array(ids, "<u4").tobytes()
        if others:
            ids = np.array(ids_of(self.path, [self.mark.join([parts[k] for k in others])])[0], "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            _deal(out, others, ids, np.append(0, cuts + 1), np.append(cuts, ids.size))
        if plain:
            ids = np.array(self.plain.encode_batch_fast([" ".join([parts[k] for k in plain])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            _deal(out, plain, ids, np.append(0, ends[:-1]), ends)
        return np.frombuffer(b"".join(out), "<u4"), np.array([len(x) // 4 for x in out], np.int64)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.kind:
            return [np.array(x, "<u4").tobytes() for x in ids_of(self.path, texts)]
        cut = [_slices(t) for t in texts]
        flat = [part for parts in cut for part in parts]
        made: list[bytes] = []
        start = size = 0
        for k, part in enumerate([*flat, None]):
            if part is None or size >= _TEXT:
                made += self._some(flat[start:k])
                start, size = k, 0
            size += len(part or "")
        ends = np.cumsum([len(parts) for parts in cut]).tolist()
        return [made[e - 1] if len(parts) == 1 else b"".join(made[e - len(parts) : e]) for e, parts in zip(ends, cut)]

    def _lower(self, text: bytes) -> bytes:
        """An ASCII text in lower case, unless that would make the string of a special token."""
        low = text.lower()
        return text if any(s.encode() in low for s in self.special) else low

    def _some(self, texts: list[str]) -> list[bytes]:
        coded = [t.encode() for t in texts]
        if self.kind == "words":
            coded = [self._lower(t) if t.isascii() else t for t in coded]
        raw, start, size, number, key = self._cut(coded)
        slot = (key[0] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        n, at, source, full = self.n[slot].astype(np.int64), self.at[slot].astype(np.int64), self.store, False
        new = np.flatnonzero((n == 0) | (self.key[0][slot] != key[0]) | (self.key[1][slot] != key[1]))
        if new.size:
            _, first, of = np.unique(key[0][new], return_index=True, return_inverse=True)
            unlike = np.flatnonzero(key[1][new] != key[1][new[first]][of])  # each of these on its own
            of[unlike] = first.size + np.arange(unlike.size)
            chosen = new[np.append(first, unlike)]
            parts = [raw[a : a + s] for a, s in zip(start[chosen].tolist(), size[chosen].tolist())]
            ids, counts = self._ask_units(parts) if self.kind == "units" else self._ask([p.decode() for p in parts])
            places = self.used + np.cumsum(counts) - counts
            full = self.used + ids.size > self.store.size
            if full:
                source = np.concatenate([self.store[: self.used], ids])
            else:
                self.store[self.used : self.used + ids.size] = ids
                self.used += ids.size
                taken, last = np.unique(slot[chosen], return_index=True)
                self.key[:, taken], self.n[taken], self.at[taken] = key[:, chosen[last]], counts[last], places[last]
            n[new], at[new] = counts[of], places[of]
        if full:
            self.n[:], self.used = 0, 0
        out = _gather(source, at, n).astype("<u4").tobytes()
        bounds = 4 * np.append(0, np.cumsum(n))[np.append(0, np.cumsum(number))]
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _gather(source: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` values of ``source`` from each place ``at``, one after another."""
    ends = np.cumsum(n)
    return source[np.repeat(at - (ends - n), n) + np.arange(int(n.sum()))]


def _deal(out: list[bytes], chosen: list[int], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Gives each chosen stretch its part of ``ids``."""
    packed = ids.tobytes()
    for k, a, b in zip(chosen, starts.tolist(), ends.tolist()):
        out[k] = packed[4 * a : 4 * b]


def _without_steps(path: str):
    """The tokenizer of a "words" file for words between spaces that its normal form, lower case and pattern leave alone."""
    from tokenizers import Tokenizer
    from tokenizers import pre_tokenizers as pre

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.normalizer = None
    out.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@lru_cache(maxsize=4)
def library(path: str) -> Library:
    return Library(path)


DROPS += [library.cache_clear, tokenizer.cache_clear]
