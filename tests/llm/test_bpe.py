import random

import numpy as np
import pytest

from tidemark.llm.bpe import DEFAULT_TOKENIZER, WordBPE, slices

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    return WordBPE(cache_words=50), tokenizers.Tokenizer.from_file(DEFAULT_TOKENIZER)


def test_ids_and_texts_equal_the_library(both):
    ours, library = both
    random.seed(1)
    parts = [*"aaaabbb  \n\t'sré1²  é\x1c 漢ß\U0001f600\x85\xa0 ½.,", "<|endoftext|>", "aaaaaaaa", "the ", "'ll", "Straße "]
    texts = ["", "a" * 5000, " " * 3000, "ab" * 2000] + ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(1500)]
    for first, part in slices(texts, 2000):
        for text, raw in zip(texts[first:], ours.encode(part)):
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids, repr(text)
            assert ours.decode(raw) == library.decode(ids, skip_special_tokens=False)


def test_slices_cover_all_rows_in_order():
    texts = ["ab", None, "c" * 10, "", "d"]
    got = {}
    for first, part in slices(texts, 3):
        got |= {first + k: t for k, t in enumerate(part)}
    assert got == {k: t or "" for k, t in enumerate(texts)}
