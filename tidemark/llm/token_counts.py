"""Token counts without tokens (operator 9): a linear longest-match automaton over a vocabulary trie.

Greedy word-piece tokenization takes, at each place of a word, the longest vocabulary piece that
starts there. The trie's failure links say where to go on when no longer match exists, and each link
carries how many pieces it completes, so a word's count is one walk over its characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import slices
from tidemark.llm.common import table

DEFAULT_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: What marks the start of a word in the vocabulary.
WORD_START = "▁"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(path: str = DEFAULT_VOCABULARY) -> list[str]:
    """The written pieces of a sentencepiece model, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class LongestMatch:
    """Counts greedy longest-match pieces of words. A character that starts no piece falls back to
    its UTF-8 bytes and counts as many tokens."""

    def __init__(self, pieces: Iterable[str], cache_words: int = 400_000):
        children: list[dict[str, int]] = [{}]
        token = [0]  # tokens that a node's own string counts as; 0: it is no piece
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    token.append(0)
                node = nxt
            token[node] = 1
        for c, node in children[0].items():  # a lone character that is no piece
            token[node] = token[node] or len(c.encode())
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = [(0, c, node) for c, node in children[0].items()]
        for parent, c, node in queue:  # breadth first: links of shorter strings are known
            if token[node]:
                fail[node], popped[node] = 0, token[node]
            else:
                z, n = fail[parent], popped[parent]
                while c not in children[z] and z:
                    n += popped[z]
                    z = fail[z]
                if c in children[z]:
                    fail[node], popped[node] = children[z][c], n
                else:  # it starts no piece: its bytes
                    fail[node], popped[node] = 0, n + len(c.encode())
            queue += [(node, x, child) for x, child in children[node].items()]
        self._children, self._fail, self._popped = children, fail, popped
        self._cache: dict[str, int] = {}
        self._limit = cache_words

    def word(self, word: str) -> int:
        children, fail, popped = self._children, self._fail, self._popped
        node, n = 0, 0
        for c in word:
            while (nxt := children[node].get(c)) is None and node:
                n += popped[node]
                node = fail[node]
            if nxt is None:
                n += len(c.encode())
            else:
                node = nxt
        while node:
            n += popped[node]
            node = fail[node]
        return n

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text; each new word is walked once."""
        if len(self._cache) > self._limit:
            self._cache.clear()
        parts = [_WORD.findall(t) for t in texts]
        cache = self._cache
        for w in set().union(*parts).difference(cache):
            cache[w] = self.word(WORD_START + w)
        get = cache.__getitem__
        return [(len(words), sum(map(get, words))) for words in parts]


_LOADED: dict[str, LongestMatch] = {}


def token_counts(docs: DataFrame, vocab: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    Null and empty texts have 0 of both, null doc_ids stay null, repeated rows each give a row, an
    empty table gives none. Only the two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocab not in _LOADED:
            _LOADED[vocab] = LongestMatch(vocabulary(vocab))
        for batch in batches:
            found = [x for _, part in slices(batch.column(1).to_pylist()) for x in _LOADED[vocab].counts(part)]
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
