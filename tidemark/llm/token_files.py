"""Binary token files with Elias-Fano document boundaries (operator 8).

A shard file holds, in this order: the ids of its documents one after another (unsigned, 16 or 32
bits, little-endian), the Elias-Fano coded ends of the documents, the Elias-Fano coded doc_ids less
the smallest one, and a tail of fixed size. Nothing keeps a 64-bit table of offsets.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import eliasfano
from tidemark.llm.bpe import DEFAULT_TOKENIZER, loaded, slices
from tidemark.llm.common import materialize, scratch, table

_TAIL = struct.Struct("<8sqQQQQB7x")  # magic, smallest doc_id, null doc_ids, bytes of ends, bytes of doc_ids, tokens, width
_MAGIC = b"TMKTOK01"
MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"


#: Documents whose boundaries are looked up at once.
BLOCK_DOCS = 4 * eliasfano.SAMPLE
#: Bytes of text that a shard file holds, about.
SHARD_BYTES = 256 << 20


def arrow_uri(path: str) -> str:
    """``path`` as Arrow's file systems name it; Hadoop's names for the same stores differ."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        return f"s3://{rest}"
    return "/dbfs/" + path.removeprefix("dbfs:").lstrip("/") if path.startswith("dbfs:") else path


def write_shard(path: str, docs: Iterator[tuple[list[int | None], list[bytes]]], width: int, end_id: int | None) -> tuple[int, int, int]:
    """Write one shard from (doc_ids, ids as 32-bit bytes) slices in ascending doc_id order, nulls
    first. The file appears under its name when whole, so a task that runs again does no harm."""
    fs, place = pafs.FileSystem.from_uri(arrow_uri(path))
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    doc_ids, lengths, nulls = [], [], 0
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    own = f"{place}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for ids, raw in docs:
            nulls += sum(i is None for i in ids)
            doc_ids += [i for i in ids if i is not None]
            lengths += [(len(r) + len(tail)) // 4 for r in raw]
            out.write(np.frombuffer(b"".join(r + tail for r in raw), "<u4").astype(f"<u{width}").tobytes())
        base = doc_ids[0] if doc_ids else 0
        ends = eliasfano.encode(np.cumsum(np.array(lengths, np.int64)))
        names = eliasfano.encode(np.array(doc_ids, np.int64) - base)
        total = sum(lengths)
        out.write(ends + names + _TAIL.pack(_MAGIC, base, nulls, len(ends), len(names), total, width))
    fs.move(own, place)
    return len(lengths), total, total * width + len(ends) + len(names) + _TAIL.size


class ShardReader:
    """Random and sequential access to a shard file."""

    def __init__(self, path: str):
        fs, place = pafs.FileSystem.from_uri(arrow_uri(path))
        size = fs.get_file_info(place).size
        self._file = fs.open_input_file(place)
        magic, base, self.nulls, ends, names, self.n_tokens, self.width = _TAIL.unpack(self._file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token file")
        raw = self._file.read_at(ends + names, size - _TAIL.size - ends - names)
        self.ends, self._names, self._base = eliasfano.EliasFano(raw[:ends]), eliasfano.EliasFano(raw[ends:]), base

    def __len__(self) -> int:
        return len(self.ends)

    def bounds(self, k: int) -> tuple[int, int]:
        """Where document ``k`` of the shard starts and ends, by two selects."""
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def _doc_ids(self, i: int, j: int) -> list[int | None]:
        """Ids of documents i to j - 1; those without an id come first."""
        named = self._names.stretch(max(0, i - self.nulls), max(0, j - self.nulls)) + self._base
        return [None] * (j - i - len(named)) + named.tolist()

    def documents(self, tokens: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of all documents, read about ``tokens`` ids at a time. Their
        boundaries come from selects of BLOCK_DOCS documents each; no table of all is made."""
        at = 0
        for i in range(0, len(self), BLOCK_DOCS):
            j = min(i + BLOCK_DOCS, len(self))
            ends, names, k = self.ends.stretch(i, j), self._doc_ids(i, j), 0
            while k < j - i:
                start = at
                last = max(k + 1, int(np.searchsorted(ends, start + tokens, "right")))
                block = self.ids(start, int(ends[last - 1]))
                for n in range(k, last):
                    yield names[n], at, block[at - start : int(ends[n]) - start]
                    at = int(ends[n])
                k = last


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = DEFAULT_TOKENIZER, end_id: int | None = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shard files under ``folder`` in ascending
    doc_id order over all shards. Returns the manifest, one row per shard.

    Null texts are empty, null doc_ids come first, repeated rows are written as often as they occur,
    an empty table gives no documents, and other columns are not read. The texts are dealt by ranges
    of doc_id and a hash of the text, so neither a source nor rows without an id crowd one shard; only
    rows that repeat both stay together. Shards are as many as the bytes of the texts ask for."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    if not shards:
        n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(-(-n_bytes // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        source.withColumn("hash", F.xxhash64("text"))
        .repartitionByRange(shards, "doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        width = 2 if len(bpe.token_bytes) <= 1 << 16 else 4
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        shard = head.column(0)[0].as_py()

        def encoded():
            for batch in (b for bs in ([head], batches) for b in bs):
                ids = batch.column(1).to_pylist()
                for first, part in slices(batch.column(2).to_pylist()):
                    yield ids[first : first + len(part)], bpe.encode(part)

        path = f"{folder}/shard-{shard:06d}.tok"
        n_docs, n_tokens, n_bytes = write_shard(path, encoded(), width, end_id)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": n_docs, "n_tokens": n_tokens, "n_bytes": n_bytes}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return materialize(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (over all shards), n_tokens, ids_crc32."""
    # The window sums one short row per shard file, never documents.
    placed = manifest.select("shard", "path", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                for doc_id, start, ids in ShardReader(row["path"]).documents():
                    out.append((doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 50_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
