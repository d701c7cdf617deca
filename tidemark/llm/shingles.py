"""Weighted word shingles of many texts at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words of a shingle.
WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = np.multiply.accumulate(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))
#: Bytes of words: letters, digits and all beyond ASCII; the rest separates.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Shingles:
    """Distinct shingles of a slice of texts, ordered by text: ``hashes[starts[k]:starts[k + 1]]``."""

    hashes: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    digests: np.ndarray


def shingles(texts: list[str]) -> Shingles:
    """Shingles of five lower-case words (runs of letters, digits and characters beyond ASCII) of each
    whole text; a text of one to four words is one shingle, one without words has none. The digest is
    a 64-bit hash of the sequence of words, 0 without words."""
    raw = np.frombuffer(("\n".join(texts) + "\n").lower().encode(), np.uint8)
    # lower() may change the number of characters, never that of line breaks: cut texts at their own breaks
    per_text = [t.count("\n") + 1 for t in texts]
    lines = np.flatnonzero(raw == 10)
    text_end = lines[np.cumsum(per_text) - 1] if texts else np.empty(0, np.int64)
    inside = _IN_WORD[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    chars = np.flatnonzero(inside)
    n_words = len(start)
    if not n_words:
        zero = np.zeros(len(texts), np.uint64)
        return Shingles(zero[:0], np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64), zero)
    first_char = np.cumsum(size) - size
    at = np.arange(len(chars)) - np.repeat(first_char, size)
    word = mix(np.add.reduceat(_BYTES[raw[chars]] * _POWERS[at % 4096], first_char) + size.astype(np.uint64))
    of_text = np.searchsorted(text_end, start)
    words = np.bincount(of_text, minlength=len(texts))
    ends = np.cumsum(words)
    begin = ends - words
    # windows: words - 4 of each text, 1 for a short one, which hashes what it has
    n_win = np.where(words >= WIDTH, words - WIDTH + 1, (words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(texts)), n_win)
    w0 = np.repeat(begin - (np.cumsum(n_win) - n_win), n_win) + np.arange(n_win.sum())
    last = np.repeat(ends, n_win)
    h = np.zeros(len(w0), np.uint64)
    for k in range(WIDTH):
        i = w0 + k
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(i < last, word[np.minimum(i, n_words - 1)], np.uint64(k)))
    place = np.arange(n_words) - np.repeat(begin, words)
    digest = np.zeros(len(texts), np.uint64)
    some = words > 0
    digest[some] = np.add.reduceat(mix(word + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begin[some]) + np.uint64(1)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    firsts = np.flatnonzero(new)
    counts = np.diff(firsts, append=len(h))
    starts = np.searchsorted(text[firsts], np.arange(len(texts) + 1))
    return Shingles(h[firsts], counts, starts, digest)
