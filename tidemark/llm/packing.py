"""Best-fit packing of documents into fixed-length sequences (operator 2): hierarchical residual packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import DEFAULT_TOKENIZER, loaded, slices
from tidemark.llm.common import materialize, table

#: A piece inside a bin: 32 bytes, so that bins travel between rounds as one binary column.
PIECE = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("crc", "<u4"), ("null_id", "<u4")])
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
BINS = "closed boolean, fill int, sequence_id bigint, members binary"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole if it fits, else a shorter first piece and
    full ones, so that only the first has to find a place."""
    if n <= size:
        return [(0, n)]
    head = n % size
    return [(0, head)] * (head > 0) + [(at, size) for at in range(head, n, size)]


def pieces(docs: DataFrame, size: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One single-piece bin (fill, members) per piece of every tokenized document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tail = loaded(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            names = batch.column(0).to_pylist()
            fills, members = [], []
            for first, part in slices(batch.column(1).to_pylist()):
                for name, raw in zip(names[first:], bpe.encode(part)):
                    raw += tail
                    for k, (start, n) in enumerate(cut(len(raw) // 4, size)):
                        crc = zlib.crc32(memoryview(raw)[4 * start : 4 * (start + n)])
                        members.append(np.array([(name or 0, start, k, n, crc, name is None)], PIECE).tobytes())
                        fills.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(fills, pa.int32()), pa.array(members, pa.binary())], ["fill", "members"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "fill int, members binary")


def best_fit(fills: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that has room. A bit per free space
    says which spaces some open bin has, so each item costs a few operations."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for k in sorted(range(len(fills)), key=lambda k: -fills[k]):
        need = fills[k]
        if fits := rooms >> need:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(k)
        if left := room - need:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def pack(items: DataFrame, size: int = 2048, slack: int = 4, items_per_task: int = 20_000) -> DataFrame:
    """Place the pieces of ``items`` (fill, members): every partition packs its own by best fit and
    emits bins with at most ``slack`` ids free. Of the others, those whose room is less than the least
    fill of any open bin can take nothing more and are emitted too; the rest go, as items, into the next
    round, which deals them anew over fewer partitions, down to the root of one. A task sees about
    ``items_per_task`` items in every round, whatever the input; only if more than that are left and a
    round joins none of them do rounds end before the root."""
    spark = items.sparkSession
    done: list[DataFrame] = []
    level, count = 0, items.count()
    while count:
        parts = -(-count // items_per_task)

        def run(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            fills: list[int] = []
            members: list[bytes] = []
            for batch in batches:
                fills += batch.column(0).to_pylist()
                members += batch.column(1).to_pylist()
            base = level << 56 | TaskContext.get().partitionId() << 32
            bins = best_fit(fills, size)
            for at in range(0, len(bins), 10_000):
                part = bins[at : at + 10_000]
                sums = [sum(fills[k] for k in b) for b in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s >= size - slack for s in sums]), pa.array(sums, pa.int32()), pa.array(range(base + at, base + at + len(part)), pa.int64()), pa.array([b"".join(members[k] for k in b) for b in part], pa.binary())],
                    ["closed", "fill", "sequence_id", "members"],
                )

        # Dealt by a hash of each row's content and place in its written table, so that a lost task's rerun
        # sees the same items and equal rows do not meet in one task.
        dealt = items.select("fill", "members").withColumn("deal", F.xxhash64(F.lit(level), "members", F.monotonically_increasing_id()))
        bins = materialize(dealt.repartition(parts, "deal").select("fill", "members").mapInArrow(run, BINS), f"bins{level}")
        least = bins.where("not closed").agg(F.min("fill")).first()[0]
        open_ = f"not closed and {size} - fill >= {least or 0}"
        left = bins.where(open_).count()
        if parts == 1 or left == count:
            done.append(bins)
            break
        done.append(bins.where(f"not ({open_})"))
        items, count, level = bins.where(open_), left, level + 1
    out = done[0] if done else spark.createDataFrame([], BINS)
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def placed(bins: DataFrame) -> DataFrame:
    """One row per piece, with its sequence and its gapless offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if not raw:
                continue
            rows = np.frombuffer(b"".join(raw), PIECE)
            counts = np.array([len(r) // PIECE.itemsize for r in raw])
            ends = np.cumsum(rows["length"].astype(np.int64))
            before = ends - rows["length"]
            first = np.repeat(before[np.cumsum(counts) - counts], counts)
            columns = [pa.array(rows["doc_id"], mask=rows["null_id"] > 0), rows["piece"], rows["start"], rows["length"].astype(np.int64), rows["crc"].astype(np.int64), np.repeat(batch.column(0).to_numpy(), counts), before - first]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) if isinstance(c, np.ndarray) else c for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return bins.select("sequence_id", "members").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece.

    A null text is empty: one piece holding ``end_id`` alone. Null doc_ids stay null, repeated rows
    are separate documents, an empty table gives no sequences, longer documents are cut and nothing
    is dropped. Only doc_id and text are read, so other columns cannot clash."""
    return placed(pack(materialize(pieces(docs, size, tokenizer, end_id), "pieces"), size))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
