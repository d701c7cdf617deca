"""BPE encoding and decoding of whole texts (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import DEFAULT_TOKENIZER, loaded, slices
from tidemark.llm.common import table


def encode(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every whole text.

    Null is empty and has no ids; rows stay as they are, repeated or with a null id; an empty table
    gives an empty result. Other columns are not read, so their names cannot clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, part in slices(texts):
                raw = bpe.encode(part)
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), ids], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, text) of what ``encode`` gave; bytes that are no UTF-8 become U+FFFD; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256. Nulls, repeats and empty tables as in ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        decimal = [str(i) for i in range(len(bpe.token_bytes))].__getitem__
        token = bpe.token_bytes.__getitem__
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for _, part in slices(batch.column(1).to_pylist()):
                for raw in bpe.encode(part):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    counts.append(len(ids))
                    of_ids.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                    of_text.append(sha(b"".join(map(token, ids)).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
