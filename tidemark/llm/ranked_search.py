"""Ranked lexical search (operator 13): documents reordered by recursive graph bisection, an index of
shards of neighbouring documents, and shards visited by their bound until no other can matter.

A tree of bisections is fitted on a bounded sample of documents and routes all others; documents of a leaf
are then bisected further, by all of their terms, in tasks of bounded size. Each shard holds postings with
the integer impact of every term in every document and each term's greatest impact. A query's bound for a
shard is the weighted sum of those; shards are visited from the greatest bound down, in rounds, until
every bound left is below the tenth best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, discard, materialize, table

#: Bytes of terms: letters, digits and all beyond ASCII; the rest separates.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A to Z lower-cased, nothing else.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
TOP = 10
#: The sample that the tree is fitted on: documents, and the terms of it that are kept (the most frequent).
SAMPLE, SAMPLE_TERMS = 2048, 1 << 16
#: Levels of the tree, and rounds of swaps of one bisection.
LEVELS, SWAPS = 6, 10
#: Documents and bytes of texts that a task bisects at once, and documents of a shard.
CHUNK, CHUNK_BYTES, SHARD = 1024, 4 << 20, 128
#: Bytes of a row group of the index, whose rows are large: a reader holds a whole one.
ROW_GROUP = str(4 << 20)
#: Each leaf is dealt into one part for so many documents of the whole table.
SALT = 1 << 15
#: Shards that a query's first round visits, and how much more each further round does.
FIRST, MORE = 8, 8
#: Shards named in a broadcast, at most.
WANTED = 1_000_000
#: Terms of queries that are answered together.
QUERY_TERMS = 500_000
#: Bytes of texts that are cut into terms at once.
SLICE = 2 << 20
#: Size of the batches of texts and shards that Python gets: a shard's row has some 200 KB.
BATCH = "4m"


def released(run):
    """``run`` for mapInArrow, which gives back what Arrow holds when its task is done: workers go on to other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """The column of texts in runs of about ``size`` bytes (or one text), each with its first row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + size, "right")))
        yield first, column.slice(first, last - first)
        first = last


def _spots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' bytes: the bytes, which are in a term, where terms begin, and where each text does."""
    filled = pc.fill_null(texts.cast(pa.string()), "")
    raw = filled.buffers()
    ends = np.frombuffer(raw[1], np.int32)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    data = np.frombuffer(raw[2] or b"", np.uint8)[ends[0] : ends[-1]]
    offsets, inside = ends - ends[0], _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    return data, inside, np.flatnonzero(begins), offsets


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code) of every term in order, and the terms that the codes stand for."""
    data, inside, begins, offsets = _spots(texts)
    kept = _LOWER[data[inside]]
    ends = np.append(np.cumsum(inside, dtype=np.int32)[begins] - 1, len(kept)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    coded = terms.dictionary_encode()
    return np.searchsorted(offsets, begins, "right") - 1, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def counted(text: np.ndarray, code: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code), sorted, with how often each occurs."""
    keys, times = np.unique(text.astype(np.int64) * max(n_codes, 1) + code, return_counts=True)
    return keys // max(n_codes, 1), keys % max(n_codes, 1), times


def lengths(docs: DataFrame) -> DataFrame:
    """n, the number of terms with repeats, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(0)):
                _, _, begins, offsets = _spots(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(np.searchsorted(begins, offsets)), pa.int64())], ["n"])

    return docs.select("text").mapInArrow(released(run), "n bigint")


def _cost(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Bits of the gaps of terms that ``left`` and ``right`` documents of the two halves hold."""
    return left * np.log2(n_left / (left + 1.0)) + right * np.log2(n_right / (right + 1.0))


def bisect(starts: np.ndarray, terms: np.ndarray, docs: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """``docs`` in two halves, of which documents are swapped in rounds as long as that saves bits: document
    d has the terms ``terms[starts[d]:starts[d + 1]]``."""
    sizes = starts[docs + 1] - starts[docs]
    at = np.repeat(starts[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    doc, term = np.repeat(np.arange(len(docs)), sizes), terms[at]
    right = np.arange(len(docs)) >= len(docs) // 2
    n_left, n_right = int((~right).sum()), int(right.sum())
    for _ in range(SWAPS):
        on_right = right[doc]
        dr = np.bincount(term[on_right], minlength=n_terms)
        dl = np.bincount(term[~on_right], minlength=n_terms)
        now = _cost(dl, dr, n_left, n_right)
        to_right, to_left = now - _cost(np.maximum(dl - 1, 0), dr + 1, n_left, n_right), now - _cost(dl + 1, np.maximum(dr - 1, 0), n_left, n_right)
        gain = np.bincount(doc, weights=np.where(on_right, to_left[term], to_right[term]), minlength=len(docs))
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swaps = int((gain[a[:m]] + gain[b[:m]] > 0).sum())
        if not swaps:
            break
        right[a[:swaps]], right[b[:swaps]] = True, False
    return docs[~right], docs[right]


def reordered(starts: np.ndarray, terms: np.ndarray, n_terms: int, size: int) -> list[np.ndarray]:
    """All documents in runs of at most ``size``, by recursive bisection; neighbours in the list are alike."""
    todo, out = [np.arange(len(starts) - 1)], []
    while todo:
        docs = todo.pop()
        if len(docs) <= size:
            out.append(docs)
        else:
            left, right = bisect(starts, terms, docs, n_terms)
            todo += [right, left]
    return out


@dataclass
class Tree:
    """For each node of LEVELS bisections (1 is the root, 2k and 2k + 1 are below k) what a term tells for
    going left, and the sum above which a text does: the sample's median, so that leaves are about equal."""

    terms: pa.Array
    lean: np.ndarray
    cut: np.ndarray

    def leaf(self, text: np.ndarray, code: np.ndarray, dictionary: pa.Array, n: int) -> np.ndarray:
        """The leaf of each of ``n`` texts with the distinct terms (text, code)."""
        known = pc.fill_null(pc.index_in(dictionary, self.terms), -1).to_numpy(zero_copy_only=False)[code]
        text, known = text[known >= 0], known[known >= 0]
        node = np.ones(n, np.int64)
        for _ in range(LEVELS):
            sums = np.bincount(text, weights=self.lean[node[text], known], minlength=n)
            node = node * 2 + (sums <= self.cut[node])
        return node - (1 << LEVELS)


def fit(texts: pa.Array) -> Tree:
    """The tree of a sample of texts."""
    text, code, dictionary = terms_of(texts)
    text, code, _ = counted(text, code, len(dictionary))
    df = np.bincount(code, minlength=len(dictionary))
    kept = np.sort(np.lexsort((np.arange(len(df)), -df))[:SAMPLE_TERMS])
    kept = kept[df[kept] > 1]  # a term of one document tells nothing of others
    place = np.full(len(dictionary), -1)
    place[kept] = np.arange(len(kept))
    text, code = text[place[code] >= 0], place[code[place[code] >= 0]]
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    lean, cut = np.zeros((1 << LEVELS, len(kept)), np.float32), np.zeros(1 << LEVELS)
    nodes = {1: np.arange(len(texts))}
    for k in range(1, 1 << LEVELS):
        docs = nodes.pop(k, np.arange(0))
        if len(docs) < 2:
            continue
        left, right = bisect(starts, code, docs, len(kept))
        share = [(np.bincount(np.concatenate([code[starts[d] : starts[d + 1]] for d in half] or [code[:0]]), minlength=len(kept)) + 0.5) / (len(half) + 1) for half in (left, right)]
        lean[k] = np.log2(share[0] / share[1])
        sums = np.array([lean[k][code[starts[d] : starts[d + 1]]].sum(dtype=np.float64) for d in docs])
        cut[k] = np.median(sums)
        nodes[2 * k], nodes[2 * k + 1] = docs[sums > cut[k]], docs[sums <= cut[k]]
    return Tree(dictionary.take(pa.array(kept)), lean, cut)


def _fitted(docs: DataFrame, rows: int) -> Tree:
    """The tree of at most SAMPLE rows that a hash of their ids and lengths draws; in one task, of bounded size."""
    of = 1 << 20
    share = min(of, -(-SAMPLE * of // max(rows, 1)) * 5 // 4)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(of)) < share).select("text").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = fit(pa.concat_arrays([pa.array([], pa.string()), *(b.column(0).cast(pa.string()) for b in batches)]))
        yield pa.RecordBatch.from_arrays([pa.array([tree.terms.to_pylist()], pa.list_(pa.string())), pa.array([tree.lean.tobytes()], pa.binary()), pa.array([tree.cut.tolist()], pa.list_(pa.float64()))], ["terms", "lean", "cut"])

    row = drawn.repartition(1).mapInArrow(released(run), "terms array<string>, lean binary, cut array<double>").first()
    return Tree(pa.array(row.terms, pa.string()), np.frombuffer(row.lean, np.float32).reshape(1 << LEVELS, -1), np.array(row.cut))


def _shards(ids: list, texts: pa.Array, rows: int, total: int) -> Iterator[dict]:
    """The shards of one chunk of documents, in the order of its bisection."""
    text, code, dictionary = terms_of(texts)
    sizes, n_terms = np.bincount(text, minlength=len(ids)), len(dictionary)
    doc, code, tf = counted(text, code, n_terms)
    starts = np.searchsorted(doc, np.arange(len(ids) + 1))
    edge = np.bincount(code, minlength=n_terms)[code] > 1  # a term of one document draws it nowhere
    edge_starts = np.searchsorted(doc[edge], np.arange(len(ids) + 1))
    rank = pc.rank(dictionary, sort_keys="ascending").to_numpy(zero_copy_only=False).astype(np.int64) - 1  # terms sorted
    m = 100 - 90 + 90 * sizes.astype(np.int64) * rows // total
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    for docs in reordered(edge_starts, code[edge], n_terms, SHARD):
        docs = np.array(sorted(docs.tolist(), key=lambda d: (ids[d] is None, ids[d] or 0, d)))  # ties of scores go by id
        at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
        local = np.repeat(np.arange(len(docs)), np.diff(starts)[docs])
        order = np.lexsort((local, rank[code[at]]))
        own = code[at][order]
        firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        held = dictionary.take(pa.array(own[firsts])).buffers()  # a fresh array: its buffers start at its first term
        offsets = np.frombuffer(held[1], np.int32)[: len(firsts) + 1]
        yield {
            "doc_ids": [ids[d] for d in docs], "terms": held[2].to_pybytes()[: offsets[-1]], "cuts": offsets.tobytes(), "ends": np.append(firsts[1:], len(own)).astype(np.int32).tobytes(),
            "docs": local[order].astype(np.uint16).tobytes(), "impacts": impact[at][order].astype(np.int32).tobytes(), "tops": np.maximum.reduceat(impact[at][order], firsts).astype(np.int32).tobytes(),
        }


_SHARD_KIND = "shard bigint, doc_ids array<bigint>, terms binary, cuts binary, ends binary, docs binary, impacts binary, tops binary"
_SHARD_SCHEMA = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("terms", "cuts", "ends", "docs", "impacts", "tops"))])


def build_index(docs: DataFrame, rows: int, total: int) -> DataFrame:
    """One row per shard: its documents by id, its terms in order (their bytes and where they are cut) with the ends of
    their postings and their greatest impacts, and each posting's document and impact, for ``rows`` documents with terms and ``total`` terms in all.

    Every document goes to its leaf and a salt, so a leaf that many documents go to, such as copies of one text, is
    many tasks; a task takes CHUNK documents at a time, so its memory does not depend on a leaf's size."""
    spark = docs.sparkSession
    tree = spark.sparkContext.broadcast(_fitted(docs, rows))  # 64 nodes by SAMPLE_TERMS terms at most: 16 MB
    salts = max(1, rows // SALT)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1)):
                text, code, dictionary = terms_of(part)
                some = np.bincount(text, minlength=len(part)) > 0
                text, code, _ = counted(text, code, len(dictionary))
                leaf = tree.value.leaf(text, code, dictionary, len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), part, pa.array(leaf, pa.int32())], ["doc_id", "text", "leaf"]).filter(pa.array(some))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leaf, room, n, made = [], None, CHUNK_BYTES, 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, room, n, made
            chunk = pa.Table.from_batches(held).combine_chunks()
            for s in _shards(chunk.column("doc_id").to_pylist(), chunk.column("text").combine_chunks(), rows, total):
                yield pa.RecordBatch.from_pylist([s | {"shard": made}], schema=_SHARD_SCHEMA)
                made += 1
            held, room, n = [], CHUNK_BYTES, 0

        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            weights = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                if held and leaves[first] != leaf:
                    yield from flush()
                leaf, before = leaves[first], weights[first - 1] if first else 0
                same = int(np.searchsorted(leaves, leaf, "right"))
                last = max(first + 1, min(same, first + CHUNK - n, int(np.searchsorted(weights, before + room, "right"))))
                held.append(batch.slice(first, last - first))
                n, room = n + last - first, room - int(weights[last - 1] - before)
                first = last
                if n >= CHUNK or room <= 0:
                    yield from flush()
        if held:
            yield from flush()

    # the texts themselves go to their leaves: they are shorter than their terms
    routed = docs.mapInArrow(released(route), "doc_id bigint, text string, leaf int")
    dealt = routed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).repartition("leaf", "salt").sortWithinPartitions("leaf")
    index = materialize(dealt.select("doc_id", "text", "leaf").mapInArrow(released(shard), _SHARD_KIND), "index", **{"parquet.block.size": ROW_GROUP})
    tree.unpersist()
    return index


class Queries:
    """Queries that are answered together: query q has the terms ``term[starts[q]:starts[q + 1]]``, numbers of
    ``words``, each of which has a weight."""

    def __init__(self, by_query: list[list[str]]) -> None:
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in by_query])]).astype(np.int64)
        coded = pa.array([t for q in by_query for t in q], pa.string()).dictionary_encode()
        self.words, self.term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = np.zeros(len(self.words), np.int64)
        self.query = np.repeat(np.arange(len(by_query)), np.diff(self.starts))

    def found(self, terms: pa.Array) -> np.ndarray:
        """The place of each of ``words`` in a shard's terms, -1 for none."""
        return pc.fill_null(pc.index_in(self.words, terms), -1).to_numpy(zero_copy_only=False)

    def bounds(self, at: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """Each query's greatest possible score in a shard."""
        most = np.where(at >= 0, tops[at], 0) * self.weight
        return np.add.reduceat(most[self.term], self.starts[:-1])  # a query has a term at least


def _numbers(raw: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind)


def _terms(batch: pa.RecordBatch, k: int) -> pa.Array:
    """The terms of a batch's shard ``k``."""
    cuts = batch.column("cuts")[k].as_buffer()
    return pa.Array.from_buffers(pa.string(), cuts.size // 4 - 1, [None, cuts, batch.column("terms")[k].as_buffer()])


def document_frequencies(index: DataFrame, queries) -> dict[str, int]:
    """Documents that hold each word of the queries, over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        df = np.zeros(len(q.words), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at, ends = q.found(_terms(batch, k)), _numbers(batch.column("ends")[k], np.int32).astype(np.int64)
                df += np.where(at >= 0, np.diff(ends, prepend=0)[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some])], ["word", "df"])

    found = index.select("terms", "cuts", "ends").mapInArrow(released(run), "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    return {r.word: r.df for r in found.collect()}  # words of a block of queries


def shard_bounds(index: DataFrame, queries) -> DataFrame:
    """(query, shard, bound) of every shard that holds a term of the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        for batch in batches:
            for k in range(batch.num_rows):
                bound = q.bounds(q.found(_terms(batch, k)), _numbers(batch.column("tops")[k], np.int32).astype(np.int64))
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), batch.column("shard")[k].as_py()), pa.int64()), pa.array(bound[some])], ["query", "shard", "bound"])

    return index.select("shard", "terms", "cuts", "tops").mapInArrow(released(run), "query int, shard bigint, bound bigint")


def visit(index: DataFrame, queries, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> DataFrame:
    """(query, doc_id, score): of every shard whose bound for a query is from ``low`` to below ``high``, the TOP
    documents with a score of ``least`` or more."""
    state = index.sparkSession.sparkContext.broadcast((low, high, least))  # three numbers per query

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (lo, hi, floor) = queries.value, state.value
        for batch in batches:
            for k in range(batch.num_rows):
                at, tops = q.found(_terms(batch, k)), _numbers(batch.column("tops")[k], np.int32).astype(np.int64)
                bound = q.bounds(at, tops)
                now = np.flatnonzero((bound > 0) & (bound >= lo) & (bound < hi))
                if not len(now):
                    continue
                place = np.full(len(lo), -1)
                place[now] = np.arange(len(now))
                entry = np.flatnonzero((place[q.query] >= 0) & (at[q.term] >= 0))
                ends, docs, impacts = (_numbers(batch.column(c)[k], t).astype(np.int64) for c, t in (("ends", np.int32), ("docs", np.uint16), ("impacts", np.int32)))
                begins, where = np.concatenate([[0], ends[:-1]]), at[q.term[entry]]
                sizes = ends[where] - begins[where]
                posting = np.repeat(begins[where] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                ids = batch.column("doc_ids")[k].values
                score = np.zeros(len(now) * len(ids), np.int64)
                np.add.at(score, np.repeat(place[q.query[entry]], sizes) * len(ids) + docs[posting], np.repeat(q.weight[q.term[entry]], sizes) * impacts[posting])
                score = score.reshape(len(now), len(ids))
                row, doc = np.nonzero(score >= np.maximum(floor[now], 1)[:, None])
                order = np.lexsort((doc, -score[row, doc], row))  # a shard's documents are in order of their ids
                row, doc = row[order], doc[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, doc = row[nth < TOP], doc[nth < TOP]
                yield pa.RecordBatch.from_arrays([pa.array(now[row], pa.int32()), ids.take(pa.array(doc)), pa.array(score[row, doc])], ["query", "doc_id", "score"])

    return index.mapInArrow(released(run), "query int, doc_id bigint, score bigint")


def _answer(index: DataFrame, queries, n: int) -> DataFrame:
    """(query, rank, doc_id, score) for ``n`` queries."""
    spark = index.sparkSession
    bounds = materialize(shard_bounds(index, queries), "shard-bounds")
    high, least, count = np.full(n, np.iinfo(np.int64).max), np.ones(n, np.int64), FIRST
    best, done = spark.createDataFrame([], "query int, doc_id bigint, score bigint, rank int"), []
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    while True:
        states = spark.createDataFrame([(k, int(h), int(x)) for k, (h, x) in enumerate(zip(high, least))], "query int, high bigint, least bigint")
        open_ = bounds.join(F.broadcast(states), "query").where("bound < high and bound >= least")  # an equal score may have a smaller id
        first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound")))
        cuts = open_.withColumn("nth", first).where(F.col("nth") <= count).groupBy("query").agg(F.min("bound").alias("low")).collect()  # a row per query
        if not cuts:
            break
        low = high.copy()
        for r in cuts:
            low[r.query] = r.low
        lows = spark.createDataFrame([(r.query, r.low) for r in cuts], "query int, low bigint")
        wanted = materialize(open_.join(F.broadcast(lows), "query").where("bound >= low").select("shard").distinct(), "wanted")
        # without the broadcast every shard's row is looked at, which changes nothing but the time
        some = len(wanted.select(F.lit(1)).take(WANTED + 1)) <= WANTED
        seen = visit(index.join(F.broadcast(wanted), "shard", "left_semi") if some else index, queries, low, high, least)
        best = materialize(best.select("query", "doc_id", "score").unionByName(seen).withColumn("rank", ranked).where(F.col("rank") <= TOP), "best")
        done += [wanted, best]
        for r in best.where(F.col("rank") == TOP).collect():
            least[r.query] = max(least[r.query], r.score)
        high, count = low, count * MORE
    discard(bounds, *(x for x in done if x is not best))
    return best.select("query", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's TOP best documents (all with a score, if fewer).

    Null and empty texts have no terms, so such documents are never found and such items find none. Equal
    scores go by the smaller doc_id, a null one last; rows that repeat an id are documents of their own. Rows of
    one item_id, also of null, are one item with the terms of all of them. Texts of any length are read whole. An empty table
    on either side gives no rows. Only the named columns are read, so others cannot clash."""
    with arrow_batches(docs.sparkSession, BATCH):
        return _search(docs, items, id_col, text_col, item_col, item_text_col)


def _search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    stats = lengths(source).where("n > 0").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).first()
    kind = f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id bigint, score bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, code, dictionary = terms_of(batch.column(1))
            text, code, _ = counted(text, code, len(dictionary))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), dictionary.take(pa.array(code))], ["item_id", "term"])

    asked = items.select(items[item_col].alias("item_id"), items[item_text_col].cast("string").alias("text"))
    asked = materialize(asked.mapInArrow(released(run), f"{kind.split(',')[0]}, term string").distinct(), "query-terms")
    n_terms = asked.count()
    if not n_terms or not stats.rows:
        return spark.createDataFrame([], kind)
    index, parts = build_index(source, stats.rows, stats.total), []
    blocks = -(-n_terms // QUERY_TERMS)
    for block in range(blocks):  # each block of queries against all rows
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        by_item: dict = {}
        for r in part.collect():  # about QUERY_TERMS rows
            by_item.setdefault(r.item_id, []).append(r.term)
        if not by_item:
            continue
        q = Queries(list(by_item.values()))
        plain = spark.sparkContext.broadcast(q)
        df = document_frequencies(index, plain)
        known = spark.createDataFrame([(k, v) for k, v in df.items()], "word bigint, df bigint")
        for r in known.select("word", F.floor(1000 * F.log((2.0 * stats.rows + 2) / (2.0 * F.col("df") + 1))).cast("bigint").alias("w")).collect():
            q.weight[r.word] = r.w
        weighted = spark.sparkContext.broadcast(q)
        names = spark.createDataFrame(list(enumerate(by_item)), f"query int, {kind.split(',')[0]}")
        parts.append(_answer(index, weighted, len(by_item)).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    discard(index, asked)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, nn),
sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10
"""
