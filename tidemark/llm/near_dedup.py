"""MinHash near-dedup (operator 5): improved consistent weighted sampling over TF-IDF shingles, banded,
verified by weighted Jaccard similarity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.batches import groups
from tidemark.llm.bpe import slices
from tidemark.llm.common import discard, materialize, table
from tidemark.llm.graph import components
from tidemark.llm.shingles import mix, shingles

SIMILARITY = 0.8
#: Bands of rows: a pair at the similarity meets in some band with probability 1 - (1 - 0.8 ** 4) ** 14 = 0.9994.
BANDS, ROWS = 14, 4
#: How much the rarest shingle outweighs one that all documents have. Document frequency is as high
#: inside a large group of near copies as in boilerplate, so a strong idf would hide such groups.
IDF = 0.1
#: Document frequencies are counted in so many cells by hash (a shingle's is at most its cell's), so
#: that the table has a fixed size however many shingles there are.
CELL_BITS, SLICES = 20, 64
#: Requests for texts up to this number are broadcast to the scan, more are joined by shuffle.
REQUESTS_BROADCAST = 300_000
#: Members compared with one copy of a pivot's text.
MEMBERS = 256
#: Rounds of comparisons with drawn members ahead of the passes over all; they save work and change no result.
ROUNDS = 2
#: Members of a bucket's two sides that one key of the last pass holds.
BLOCK = 1024
#: Standard deviations by which a pair at the similarity may differ in more bins of its sketches than
#: on average and still has its texts compared.
SIGMAS = 4
#: Bins of a sketch, of four bits each.
BINS = 512
_POOL_BITS = 14


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per cell, and the number of documents, over all rows. Tasks add up their own texts
    and send 64 compressed slices; the slices are added one by one where they meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << CELL_BITS, np.uint32), 0
        for batch in batches:
            for _, part in slices(batch.column(1).to_pylist()):
                found = shingles(part)
                # a text's shingles in one cell may count more than once; cells are an upper bound anyway
                where, times = np.unique(_cells(found.hashes), return_counts=True)
                cells[where] += times.astype(np.uint32)
                n += len(part)
        if n:
            raw = [zlib.compress(s.tobytes(), 1) for s in np.split(cells, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(raw, pa.binary())], ["slice", "n", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                more = np.frombuffer(zlib.decompress(row["cells"]), np.uint32).astype(np.uint64)
                sums[row["slice"]] = sums.get(row["slice"], 0) + more
                n[row["slice"]] = n.get(row["slice"], 0) + row["n"]
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k]], pa.int64()), pa.array([zlib.compress(s.tobytes(), 1)], pa.binary())], ["slice", "n", "cells"])

    kind = "slice int, n bigint, cells binary"
    rows = texts.mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect()  # 64 rows of fixed size
    cells, n = np.zeros(1 << CELL_BITS, np.uint64), 0
    width = (1 << CELL_BITS) // SLICES
    for row in rows:
        cells[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["cells"]), np.uint64)
        n = row["n"]
    return cells, n


def cell_weights(cells: np.ndarray, n: int, idf: float = IDF) -> np.ndarray:
    """idf of each cell, from 1 (in every document) to 1 + ``idf`` (in one)."""
    share = np.log(np.clip(cells, 1, max(n, 1)).astype(np.float64)) / max(np.log(max(n, 2)), 1e-9)
    return (1 + idf * (1 - share)).astype(np.float32)


def term_frequency(counts: np.ndarray) -> np.ndarray:
    """1 for one occurrence and 1 more with each doubling, so that one line repeated many times does not
    outweigh all else that two texts have."""
    return np.frexp(counts)[1].astype(np.int64)


def _pool(seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) r and ln c, and uniform beta, for 2 ** 14 hash values; multipliers of the samples."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = 1 << _POOL_BITS
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    return np.maximum(r, 1e-3).astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32), rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS * ROWS consistent weighted samples of each text that has shingles (rows).

    For a shingle of weight w and a sample's r, c, beta: t = floor(ln w / r + beta) and
    ln a = ln c - r (t - beta + 1); the least ln a wins. The sample is that value with the shingle."""
    r, ln_c, beta, multipliers = _pool()
    ln_w, low = np.log(weights.astype(np.float32)), hashes & np.uint64(0xFFFFFFFF)
    out = np.empty((len(starts), len(multipliers)), np.uint64)
    for k, m in enumerate(multipliers):
        at = (hashes * m >> np.uint64(64 - _POOL_BITS)).astype(np.intp)
        own = r[at]
        b = beta[at]
        ln_a = ln_c[at] - own * (np.floor(ln_w / own + b) - b + np.float32(1))
        # positive floats are ordered as their bits are
        bits = np.maximum(ln_a + np.float32(256), np.float32(0)).view(np.uint32).astype(np.uint64)
        out[:, k] = np.minimum.reduceat(bits << np.uint64(32) | low, starts)
    return out


def sketches(hashes: np.ndarray, tf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A sketch of each text that has shingles, as BINS / 16 numbers: of every shingle, each
    unit of its term frequency is an element of its own, elements are dealt into BINS by hash, and a bin
    keeps four bits of its least element (1 to 15; 0 if it is empty). The share of equal bins follows
    the weighted Jaccard similarity without idf."""
    n = len(starts)
    firsts = np.cumsum(tf) - tf
    nth = np.arange(tf.sum()) - np.repeat(firsts, tf)
    elements = mix(np.repeat(hashes, tf) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ends = np.append(firsts, len(elements))[np.append(starts, len(hashes))]
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(ends))
    least = np.full(n * BINS, np.iinfo(np.uint64).max)
    np.minimum.at(least, (text * np.uint64(BINS) + (elements >> np.uint64(32)) % np.uint64(BINS)).astype(np.intp), elements)
    bits = np.where(least == np.iinfo(np.uint64).max, np.uint64(0), least % np.uint64(15) + np.uint64(1)).reshape(n, BINS // 16, 16)
    return np.bitwise_or.reduce(bits << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def signatures(texts: DataFrame, weights) -> DataFrame:
    """doc_id, digest of the words (null without words), one hash per band, a sketch and the weight of
    all shingles, and ``mark``, a digest of these two: texts are one node if both digests are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        for batch in batches:
            for first, part in slices(batch.column(1).to_pylist(), 400_000):
                found = shingles(part)
                some = np.flatnonzero(np.diff(found.starts))
                bands, sketch = np.zeros((len(some), BANDS), np.uint64), np.zeros((len(some), BINS // 16), np.uint64)
                total = np.zeros(len(part))
                if len(some):
                    starts = found.starts[some]
                    tf = term_frequency(found.counts)
                    w = tf * idf[_cells(found.hashes)]
                    total[some] = np.add.reduceat(w.astype(np.float64), starts)
                    own = samples(found.hashes, w, starts)
                    for band in range(BANDS):
                        h = np.full(len(some), band + 1, np.uint64)
                        for k in range(ROWS):
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[:, band * ROWS + k])
                        bands[:, band] = h
                    sketch = sketches(found.hashes, tf, starts)
                counts = np.zeros(len(part), np.int32)
                counts[some] = 1
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                buckets = pa.ListArray.from_arrays(pa.array(ends * BANDS), pa.array(bands.ravel().view(np.int64)))
                packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends * np.int32(BINS // 2)), pa.py_buffer(sketch)])
                digest = pa.array(found.digests.view(np.int64), mask=np.diff(found.starts) == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), digest, buckets, packed, pa.array(total)], ["doc_id", "digest", "bands", "sketch", "weight"])

    marks = texts.mapInArrow(run, "doc_id bigint, digest bigint, bands array<bigint>, sketch binary, weight double")
    return marks.withColumn("mark", F.xxhash64("sketch", "weight"))


def _filled(x: np.ndarray) -> np.ndarray:
    """How many groups of four bits are not zero, over the last axis."""
    x = x | x >> np.uint64(1)
    x = x | x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int32)


def alike(x: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether texts of the sketches ``x``, ``y`` and weights ``w``, ``v`` can be of the similarity, and
    the share of bins that differ. They can if the lesser weight is at least this share of the other
    and at most one bin more differs than SIGMAS allow.

    Sketches leave out the idf, so the least similarity without it is taken. Bins draw from a finite
    set without returning: of few elements they hold nearly all, and the count is nearly exact."""
    plain = similarity / (1 + IDF * (1 - similarity))
    differ, used = _filled(x ^ y), np.maximum(_filled(x | y), 1)
    elements = -BINS * np.log1p(-np.minimum(used, BINS - 0.5) / BINS)
    spread = used * plain * (1 - plain) * np.maximum(0, elements - used) / np.maximum(1, elements - 1)
    can = (np.minimum(w, v) >= (similarity - 1e-6) * np.maximum(w, v)) & (differ <= 1 + used * (1 - plain) + SIGMAS * np.sqrt(spread))
    return can, differ / used


def _sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BINS // 16)


def similar(texts: DataFrame, pairs: DataFrame, weights, similarity: float) -> DataFrame:
    """Those of ``pairs`` (pivot, node) whose texts have a weighted Jaccard similarity of ``similarity``
    or more, from whole texts. Each pivot's members are dealt in groups of about MEMBERS, each with
    one copy of the pivot's text ahead of them, so a pivot of many members is no single task."""
    per_pivot = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    dealt = pairs.join(per_pivot, "pivot")
    member = dealt.select(F.col("node").alias("doc"), "pivot", F.pmod(F.xxhash64("node", "pivot"), "salts").cast("int").alias("salt"), F.lit(1).alias("member"))
    pivot = per_pivot.select(F.col("pivot").alias("doc"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    requests = member.unionByName(pivot)
    small = 2 * pairs.count() <= REQUESTS_BROADCAST  # at most one pivot for each member
    asked = texts.join(F.broadcast(requests) if small else requests, texts.doc_id == requests.doc)
    asked = asked.select("doc", "pivot", "salt", "member", "text").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        group, ph, pw = None, None, None
        for batch in batches:
            docs, pivots, salts, members = (batch.column(k).to_pylist() for k in range(4))
            a, b = [], []
            for first, part in slices(batch.column(4).to_pylist(), 400_000):
                found = shingles(part)
                w = term_frequency(found.counts) * idf[_cells(found.hashes)]
                for k in range(len(part)):
                    row = first + k
                    h, own = found.hashes[found.starts[k] : found.starts[k + 1]], w[found.starts[k] : found.starts[k + 1]]
                    if not members[row]:
                        group, ph, pw = (pivots[row], salts[row]), h, own
                    elif group == (pivots[row], salts[row]) and len(h) and len(ph):
                        at = np.minimum(np.searchsorted(ph, h), len(ph) - 1)
                        both = ph[at] == h
                        common = float(np.minimum(pw[at[both]], own[both]).sum(dtype=np.float64))
                        if common >= similarity * (float(pw.sum(dtype=np.float64)) + float(own.sum(dtype=np.float64)) - common):
                            a.append(docs[row])
                            b.append(pivots[row])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return asked.mapInArrow(run, "a bigint, b bigint")


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, component) after links between some of their nodes."""
    own = classes.select(F.col("node").alias("n"), F.col("component").alias("c"))
    for end in ("a", "b"):
        links = links.join(own, links[end] == own.n, "left").withColumn(end, F.coalesce("c", end)).drop("n", "c")
    joined = materialize(components(links.select("a", "b")), "joined")
    moved = classes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = joined.join(classes, "node", "left_anti").select("node", "component")
    merged = materialize(moved.unionByName(fresh), "classes")
    discard(joined, classes)
    return merged


def _pairs(found: DataFrame, a: str, b: str) -> DataFrame:
    return found.select(F.least(a, b).alias("pivot"), F.greatest(a, b).alias("node")).distinct()


def draw(now: DataFrame, rnd: int, similarity: float) -> DataFrame:
    """For every node of ``now`` (rows with component) at most one pair to try: of the members that a
    hash draws in each of its buckets, the most alike one of another component, if it can be alike."""
    own = F.struct("node", "component", "sketch", "weight")
    drawn = now.groupBy("bucket").agg(F.min_by(own, F.xxhash64(F.lit(rnd), "bucket", "node")).alias("p"), F.min("component").alias("least"), F.max("component").alias("most"))
    drawn = drawn.where("least <> most").select("bucket", "p.*")
    met = now.alias("a").join(drawn.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.component") != F.col("b.component")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, v = (batch.column(k).to_numpy() for k in (4, 5))
            can, differ = alike(_sketches_of(batch.column(2)), _sketches_of(batch.column(3)), w, v, similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(differ)], ["node", "pivot", "differ"]).filter(pa.array(can))

    met = met.select("a.node", F.col("b.node").alias("pivot"), "a.sketch", F.col("b.sketch").alias("other"), "a.weight", F.col("b.weight").alias("w"))
    one = met.mapInArrow(run, "node bigint, pivot bigint, differ double").groupBy("node").agg(F.min_by("pivot", F.struct("differ", "pivot")).alias("pivot"))
    return _pairs(one, "node", "pivot")


def untried(now: DataFrame, tried: DataFrame, similarity: float, nearest: bool, done: list[DataFrame]) -> DataFrame:
    """Every pair (pivot, node) of two components that share a bucket, can be alike and is not in ``tried``;
    with ``nearest`` only the most alike of each node outside its buckets' largest components. A
    table made on the way is added to ``done``.

    Members outside a bucket's largest component meet all its members, so a bucket that one component
    fills is linear work. Both sides are dealt in blocks of about BLOCK members, and each pair of
    blocks is a key of its own, so no bucket is a single task. A task compares the sketches of
    two blocks in numpy and emits only pairs that can be alike, each in the first bucket that it shares."""
    held = now.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    held = held.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("all")).where("most.m < all")
    parts = lambda n, name: F.ceil(n / BLOCK).cast("int").alias(name)
    sides = held.select("bucket", F.col("most.component").alias("main"), parts(F.col("all") - F.col("most.m"), "lefts"), parts(F.col("all"), "rights"))
    now = materialize(now.join(sides, "bucket").withColumn("minor", F.col("component") != F.col("main")), "mixed")
    done.append(now)
    dealt = lambda parts: F.pmod(F.xxhash64("node"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    columns = ["bucket", "i", "j", "side", "node", "component", "minor", "weight", "sketch", "bands"]
    left = now.where("minor").withColumns({"side": F.lit(0), "i": dealt(F.col("lefts"))}).withColumn("j", every("rights"))
    right = now.withColumns({"side": F.lit(1), "j": dealt(F.col("rights"))}).withColumn("i", every("lefts"))
    sides = left.select(columns).unionByName(right.select(columns)).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")

    def compared(rows: pa.Table) -> pa.RecordBatch:
        first = rows.column("side").to_numpy() == 0
        node, component, minor, weight = (rows.column(c).to_numpy() for c in ("node", "component", "minor", "weight"))
        sketch, bucket = _sketches_of(rows.column("sketch")), rows.column("bucket")[0].as_py()
        bands = rows.column("bands").chunk(0).flatten().to_numpy().reshape(len(node), BANDS)
        which = np.argmax(bands == bucket, axis=1)  # the bucket's band
        earlier = np.arange(BANDS) < which[:, None]
        out = [(node[:0], node[:0], np.empty(0))]
        for k in np.flatnonzero(first):
            # two members of the minor side meet twice: once is enough
            at = np.flatnonzero(~first & (component != component[k]) & (~minor | nearest | (node > node[k])))
            at = at[~((bands[at] == bands[k]) & earlier[at]).any(axis=1)]
            can, differ = alike(sketch[k], sketch[at], weight[k], weight[at], similarity)
            found, differ = node[at[can]], differ[can]
            if nearest and len(found):
                best = np.lexsort((found, differ))[:1]
                found, differ = found[best], differ[best]
            out.append((np.full(len(found), node[k]), found, differ))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "other", "differ"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["bucket", "i", "j"]):
            yield compared(rows)

    found = sides.mapInArrow(run, "node bigint, other bigint, differ double")
    if nearest:
        found = found.groupBy("node").agg(F.min_by("other", F.struct("differ", "other")).alias("other"))
    return _pairs(found, "node", "other").join(tried, ["pivot", "node"], "left_anti")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id of every row: the smallest doc_id of those it is linked with, step by step.

    Texts of the same words are one node (by two digests of 64 bits each, of the words and of the sketch and weight of
    their shingles, so unlike texts would have to agree in both). Two nodes that share a bucket of some band are linked if the
    weighted Jaccard similarity of their whole texts is ``similarity`` or more; sketches and weights
    tell beforehand which pairs cannot be. In ROUNDS, each node is compared with one member drawn in
    its buckets, which joins most of a large bucket at linear cost, then with its most alike one; at last every
    pair of a bucket's nodes that are still in different classes is tried, in buckets of any size
    alike. So the classes do not depend on the draws.

    A text without words (null, empty, only marks) and a row with a null id are classes of their own
    (class_id is doc_id). Repeated rows and ties are in one class; texts of any length are read whole.
    An empty table gives no rows. Only the two columns are read, so others cannot clash."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    weights = spark.sparkContext.broadcast(cell_weights(*document_frequencies(texts)))  # 4 MB whatever the input
    marks = materialize(signatures(texts, weights), "signatures")
    nodes = marks.where("doc_id is not null and digest is not null").groupBy("digest", "mark").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("weight").alias("weight"))
    nodes = materialize(nodes, "nodes")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    rows = materialize(rows.join(shared, "bucket").join(nodes.select("node", "sketch", "weight", "bands"), "node"), "buckets")
    texts = texts.where("doc_id is not null")
    classes = spark.createDataFrame([], "node bigint, component bigint")
    tried = spark.createDataFrame([], "pivot bigint, node bigint")
    done: list[DataFrame] = []
    for rnd in range(ROUNDS + 2):
        now = rows.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs = draw(now, rnd, similarity).join(tried, ["pivot", "node"], "left_anti") if rnd < ROUNDS else untried(now, tried, similarity, rnd == ROUNDS, done)
        pairs = materialize(pairs, "pairs")
        done.append(pairs)
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        found = materialize(similar(texts, pairs, weights, similarity), "links")
        done.append(found)
        if not found.isEmpty():
            classes = _merged(classes, found)
    discard(rows, *done)
    by_digest = nodes.select("digest", "mark", "node").join(classes, "node", "left").select("digest", "mark", F.coalesce("component", "node").alias("node"))
    # Copies of one text are not joined with each other but with their node, and Spark splits a skewed side.
    return marks.join(by_digest, ["digest", "mark"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("class_id"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
