"""A linear model on hashed word and character n-grams: features by the batch, fitting, calibration.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text. Features of a text are its words, pairs of neighbouring
words (those of a word with itself share one place), and runs of 3 and 4 characters inside words (word ends marked),
each hashed to one of ``2**BITS`` places; the score is the mean weight over all of them, so length alone does not move
it. All sums run over whole texts. An empty text has no features and score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 18
_MASK = np.uint64(2**BITS - 1)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Words of a batch that are counted at once.
_WORDS = 16_000


def _place(h: np.ndarray) -> np.ndarray:
    """A place for each 64-bit number."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * _P[0]
        return ((h ^ (h >> np.uint64(32))) & _MASK).astype(np.int64)


def _counted(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some lengths."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start and size of each word there, number of words of each text, a hash of each word's bytes and places)."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    start, size = edge[::2], edge[1::2] - edge[::2]
    first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    words = np.bincount(np.searchsorted(first, start, side="right") - 1, minlength=len(texts))[: len(texts)]
    with np.errstate(over="ignore"):
        term = (_counted(size).astype(np.uint64) << np.uint64(8) | flat[inside]) * _P[0]
        term = (term ^ (term >> np.uint64(29))) * _P[1]
        term ^= term >> np.uint64(32)
        own = np.add.reduceat(term, np.cumsum(size) - size) if size.size else np.zeros(0, np.uint64)
    return flat, start, size, words, own


def _grams(flat: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of some words' own features, and the word that each is of. A space, which no word has, marks word ends."""
    marked = np.full(int(size.sum()) + size.size + 1, 32, np.uint8)
    marked[np.arange(int(size.sum())) + np.repeat(np.arange(1, size.size + 1), size)] = flat[np.repeat(start, size) + _counted(size)]
    flat = np.frombuffer(marked.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    edge = np.flatnonzero(flat == 32)
    size = np.diff(edge)
    owner = np.repeat(np.arange(size.size), size)  # of each place but the last, the mark before a word included
    room = np.repeat(edge[1:], size) - np.arange(owner.size)
    places, owners = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(flat.size, np.uint64)
        for n in range(4):
            h[: flat.size - n] = h[: flat.size - n] * _P[1] + flat[n:] + np.uint64(1) if flat.size > n else 0
            if n >= 2:
                ok = np.flatnonzero(room >= n)
                places.append(_place(h[ok] + _P[2] * np.uint64(n)))
                owners.append(owner[ok])
    return np.concatenate([*places, _place(own)]), np.concatenate([*owners, np.arange(size.size)])


def _pairs(own: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each pair of neighbouring words, and the text that it is in."""
    text = np.repeat(np.arange(words.size), words)
    same = np.flatnonzero(text[:-1] == text[1:]) if text.size else np.zeros(0, np.int64)
    left, right = own[same], own[same + 1]
    with np.errstate(over="ignore"):
        h = left * _P[1] + right * _P[2]
    h[left == right] = 0
    return _place(h), text[same]


def _per_text(per_word: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sum over the words of each text."""
    total, ends = np.concatenate([[0], np.cumsum(per_word)]), np.cumsum(words)
    return total[ends] - total[ends - words]


class Words:
    """The words of some texts, numbered: ``ids`` of all texts in a row, ``ends`` of each text, ``hash`` by number. Equal
    words are found by 64-bit hashes of their bytes and places; no object is made for a word."""

    def __init__(self, texts: list[bytes]):
        flat, start, size, self.size, self.own = _cut(texts)
        self.ends = np.cumsum(self.size)
        self.hash, at, self.ids = np.unique(self.own, return_index=True, return_inverse=True)
        self.places, self.owners = _grams(flat, start[at], size[at], self.hash)
        self.grams = np.bincount(self.owners, minlength=self.hash.size)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, share of the text's features), one entry a text and place."""
        order = np.argsort(self.owners, kind="stable")
        places, first = self.places[order], np.concatenate([[0], np.cumsum(self.grams)])
        text = np.repeat(np.arange(self.size.size), self.size)
        reps = self.grams[self.ids]
        at = np.repeat(first[self.ids] - np.concatenate([[0], np.cumsum(reps)])[:-1], reps) + np.arange(int(reps.sum()))
        pair, pair_text = _pairs(self.own, self.size)
        key = np.concatenate([np.repeat(text, reps), pair_text]) << BITS | np.concatenate([places[at], pair])
        key, n = np.unique(key, return_counts=True)
        row = key >> BITS
        return row, key & (2**BITS - 1), n / np.maximum(1, self.total())[row]

    def total(self) -> np.ndarray:
        return _per_text(self.grams[self.ids], self.size) + np.maximum(0, self.size - 1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight over each text's features, 0 without any."""
        own = np.bincount(self.owners, weights[self.places], minlength=self.hash.size)
        pair, text = _pairs(self.own, self.size)
        return (_per_text(own[self.ids], self.size) + np.bincount(text, weights[pair], minlength=self.size.size)) / np.maximum(1, self.total())


class Scorer:
    """What ``Words.scores`` gives, for many texts and one set of weights: the sum and the number of a word's own features
    are kept in a slot that its hash names, until another word takes it, so frequent words are worked out once."""

    def __init__(self, weights: np.ndarray, slot_bits: int = 19):
        self.weights, self.shift = weights, np.uint64(64 - slot_bits)
        self.key, self.sum, self.n = np.zeros(2**slot_bits, np.uint64), np.zeros(2**slot_bits), np.zeros(2**slot_bits, np.int32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        flat, start, size, words, own = _cut(texts)
        slot = (own >> self.shift).astype(np.int64)
        total, n = self.sum[slot], self.n[slot].astype(np.int64)
        new = np.flatnonzero((self.key[slot] != own) | (n == 0))
        if new.size:
            word, at, of = np.unique(own[new], return_index=True, return_inverse=True)
            places, owners = _grams(flat, start[new[at]], size[new[at]], word)
            sums_, n_ = np.bincount(owners, self.weights[places], minlength=word.size), np.bincount(owners, minlength=word.size)
            total[new], n[new] = sums_[of], n_[of]
            slot = (word >> self.shift).astype(np.int64)  # ascending, as the words are; the first of those that share one
            first = np.flatnonzero(np.diff(slot, prepend=-1))
            self.key[slot[first]], self.sum[slot[first]], self.n[slot[first]] = word[first], sums_[first], n_[first]
        pair, text = _pairs(own, words)
        whole = _per_text(n, words) + np.maximum(0, words - 1)
        return (_per_text(total, words) + np.bincount(text, self.weights[pair], minlength=words.size)) / np.maximum(1, whole)


def in_parts(texts: list[bytes]):
    """(offset, texts) with about ``_WORDS`` words each, so that long texts don't add up; a text is never cut."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 5
        if size >= _WORDS:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


@dataclass
class Linear:
    """Weights, and the line (``slope``, ``shift``) from a score to the log-odds."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, scores: np.ndarray) -> np.ndarray:
        return self.slope * scores + self.shift

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(scores), -60, 60)))


#: Features that are summed at once while fitting.
_FEATURES = 1 << 16
#: (row, place, value) of features, some arrays each.
Parts = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def sums(row: np.ndarray, place: np.ndarray, value: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """Each row's sum of weights times values."""
    z = np.zeros(size)
    for k in range(0, row.size, _FEATURES):
        part = slice(k, k + _FEATURES)
        z += np.bincount(row[part], w[place[part]] * value[part], minlength=size)
    return z


class Fit:
    """A logistic regression, by full-batch gradients with per-weight step sizes; no randomness. It can go on with rows that
    come later: ``rounds`` of a further call start where the last one ended."""

    def __init__(self, size: int, rate: float = 8.0, shrink: float = 1e-6):
        self.weights, self.seen, self.bias, self.seen_bias = np.zeros(size), np.full(size, 1e-10), 0.0, 1e-10
        self.rate, self.shrink = rate, shrink

    def run(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
        return self.run_parts([(row, place, value)], y, weight, rounds)

    def run_parts(self, parts: Parts, y: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
        """``run`` on features in several arrays, which are never joined."""
        w, size = self.weights, self.weights.size
        for _ in range(rounds):
            z = sum(sums(*p, w, y.size) for p in parts) + self.bias
            g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / weight.sum()
            grad = self.shrink * w
            for row, place, value in parts:
                for k in range(0, row.size, _FEATURES):
                    part = slice(k, k + _FEATURES)
                    grad += np.bincount(place[part], g[row[part]] * value[part], minlength=size)
            self.seen += grad**2
            self.seen_bias += g.sum() ** 2
            w -= self.rate * grad / np.sqrt(self.seen)
            self.bias -= 0.1 * g.sum() / np.sqrt(self.seen_bias)
        return w.copy()


def fit(row: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, rounds: int = 120) -> np.ndarray:
    """Weights of a logistic regression."""
    return Fit(size).run(row, place, value, y, weight, rounds)


def calibrate(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the scores log-odds (Platt's smoothed targets, Newton steps); slope 0 where scores tell
    nothing or the wrong way."""
    up, down = (weight * y).sum(), (weight * (1 - y)).sum()
    if not up or not down:
        return 0.0, float(np.log((up + 1) / (down + 1)))
    flat = 0.0, float(np.log(up / down))
    if scores.std() <= 1e-6 * max(1.0, abs(float(scores.mean()))):
        return flat
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = scores.std()
    x = np.stack([(scores - scores.mean()) / spread, np.ones_like(scores)], 1)
    b = np.array([1.0, np.log(up / down)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-3 * b * [1, 0]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = float(b[0] / spread)
    return (slope, float(b[1] - slope * scores.mean())) if slope > 0 else flat
