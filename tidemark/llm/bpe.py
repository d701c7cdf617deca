"""Byte-level BPE for many words at once.

A text is cut into words, every new word of a slice of texts is merged together with the others in
rounds over one flat symbol array, and texts are put together from the words' ids. The ids equal
those of the ``tokenizers`` library for the same vocabulary file.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The pre-tokenizer's pattern for texts of characters up to U+024F; others go to the library's own.
_WORD = re.compile(rf" ?[{_LETTER}]++|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]++| ?[^{_SPACE}{_LETTER}{_NUMBER}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WIDE = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class WordBPE:
    """Encoder and decoder of one vocabulary file, with a bounded cache of words' ids.

    ``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str = DEFAULT_TOKENIZER, cache_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.token_bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self._special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        first = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            first[b] = vocab[c]
        self._first = first
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys = keys[order]
        self._ranks = order.astype(np.int32)
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int32)[order]
        left, right = np.divmod(np.arange(65_536), 256)
        rank, made = self._look_up(first[left], first[right])
        self._byte_rank, self._byte_made = rank.astype(np.int32).reshape(256, 256), made.reshape(256, 256)
        self._path, self._library, self._cache, self._limit = path, None, {}, cache_words

    def split(self, text: str) -> list[str]:
        if not _WIDE.search(text):
            return _WORD.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair, by binary search over the sorted pair keys."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._ranks[at], _NONE), self._made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words in one array, and each word's number of ids.

        Each round merges all places of every word's lowest-ranked adjacent pair and looks up the
        pairs this made; words without a pair to merge leave the array."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self._first[raw]
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym):
            rank[:-1], made[:-1] = self._byte_rank[raw[:-1], raw[1:]], self._byte_made[raw[:-1], raw[1:]]
            rank[:-1][word[1:] != word[:-1]] = _NONE
        out_word, out_sym = [], []
        while len(sym):
            new = np.empty(len(sym), bool)
            new[0], new[1:] = True, word[1:] != word[:-1]
            starts = np.flatnonzero(new)
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(sym)))
            keep = best != _NONE
            if not keep.all():
                out_word.append(word[~keep])
                out_sym.append(sym[~keep])
            merged = keep & (rank == best)
            chosen = np.flatnonzero(merged)
            if not len(chosen):
                break
            if (touch := np.diff(chosen, prepend=-9) == 1).any():  # as in "aaa": every second place
                run = np.maximum.accumulate(np.where(touch, 0, np.arange(len(chosen))))
                odd = (np.arange(len(chosen)) - run) % 2 == 1
                merged[chosen[odd]] = False
                chosen = chosen[~odd]
            sym[chosen] = made[chosen]
            keep[chosen + 1] = False
            sym, word, rank, made, merged = sym[keep], word[keep], rank[keep], made[keep], merged[keep]
            fresh = merged.copy()
            fresh[:-1] |= merged[1:]
            pair = np.flatnonzero(fresh[:-1])
            fresh_rank, made[pair] = self._look_up(sym[pair], sym[pair + 1])
            rank[pair] = np.where(word[pair] == word[pair + 1], fresh_rank, _NONE)
            rank[-1] = _NONE
        word, sym = np.concatenate(out_word or [np.empty(0, np.int32)]), np.concatenate(out_sym or [np.empty(0, np.int32)])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _learn(self, missing: list[str]) -> None:
        for at in range(0, len(missing), 16_384):
            part = missing[at : at + 16_384]
            ids, counts = self.merge([w.encode() for w in part])
            raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            self._cache.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends))))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._cache) > self._limit:
            self._cache.clear()
        parts: list[list] = []
        for text in texts:
            words: list = []
            at = 0
            for m in self._special_re.finditer(text) if self.special else ():
                words += self.split(text[at : m.start()]) if m.start() > at else []
                words.append(m[0])
                at = m.end()
            words += self.split(text[at:]) if at else self.split(text)
            parts.append(words)
        cache = self._cache
        for s, i in self.special.items():
            cache[s] = int(i).to_bytes(4, "little")
        self._learn(list(set().union(*parts).difference(cache)))
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """One encoder for each vocabulary in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def slices(texts: list[str | None], chars: int = 1_000_000):
    """(first, texts) of consecutive slices of about ``chars`` characters; null is empty."""
    first, part, size = 0, [], 0
    for k, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= chars:
            yield first, part
            first, part, size = k + 1, [], 0
    if part:
        yield first, part
